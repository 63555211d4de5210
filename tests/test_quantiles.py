import numpy as np

from ledgerlake.functions.quantiles import exact_percentiles


def test_exact_percentiles_match_numpy_small_and_narrowed(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(100, 30, 5000), np.full(3000, 42.0), rng.exponential(10, 2000)])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    want = [float(np.quantile(vals, p)) for p in (0.25, 0.5, 0.75)]
    for max_hist in (100_000, 50):  # direct histogram, then forced narrowing passes
        got = exact_percentiles(df, "v", [0.25, 0.5, 0.75], accuracy=100, max_hist=max_hist)
        assert np.allclose(got, want, rtol=0, atol=1e-9), (max_hist, got, want)


def test_exact_percentiles_empty_and_nulls(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert exact_percentiles(df, "v", [0.25]) == [None]
