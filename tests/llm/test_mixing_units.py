"""Mixing with many equal rows, many sources, and columns with clashing names."""

from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import common as C, mixing

ROWS = "doc_id long, text_key long, sources array<string>, size long"


@pytest.mark.parametrize("seed", range(5))
def test_copies_are_taken_row_by_row(spark, seed):
    """600 equal rows among 1,000: within one document of the target."""
    C.prepare(spark)
    rows = [(1, 1, ["a"], 70)] * 600 + [(i, i, ["a"], 20 + i % 30) for i in range(2, 402)]
    out, sizes, goal = mixing.mix(spark.createDataFrame(rows, ROWS), seed=seed)
    got = out.collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], r[3]) for r in rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    assert 0 <= round(goal["a"]) - sum(r.taken for r in got) <= 70


def test_large_units_are_written_in_pieces(spark, monkeypatch):
    C.prepare(spark)
    monkeypatch.setattr(mixing, "CHUNK", 7)
    out, _, goal = mixing.mix(spark.createDataFrame([(1, 1, ["a"], 10)] * 100 + [(None, 2, [None], 3)] * 9, ROWS))
    got = out.collect()
    assert Counter(r.doc_id for r in got) == {1: 100, None: 9}
    taken = defaultdict(int)
    for r in got:
        taken[r.sources[0]] += r.taken
    assert all(0 <= goal[s] - taken[s] <= 10 for s in goal)


def test_many_sources(spark):
    """20,000 sources, null among them: targets equal the list form, and each source comes near its own."""
    C.prepare(spark)
    n = 20_000
    source = F.when(F.col("id") == n - 1, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id").cast("string")))
    rows = spark.range(n).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(3)))).select(
        (F.col("id") * 3 + F.col("x")).alias("doc_id"), F.col("x").cast("long").alias("text_key"), F.array(source).alias("sources"), (F.col("id") % 50 + F.col("x")).cast("long").alias("size")
    )
    units, sources = mixing.mix_units(rows)
    found = {r.source: r for r in sources.collect()}
    goal = mixing.targets({s: r.source_size for s, r in found.items()}, mixing.weights_by_order(list(found)), Fraction(3, 2), 2)
    assert len(found) == n and all(abs(found[s].target - float(goal[s])) < 1e-6 for s in found)
    taken = defaultdict(int)
    for r in mixing.taken_rows(units).collect():
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.sources[0]] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 53 for s in found)


def test_groups_of_overlapping_sources_are_solved_apart(spark):
    C.prepare(spark)
    rows = [(100 * g + i, i, [f"{g}a", f"{g}b"] if i % 3 == 0 else [f"{g}a"] if i % 3 == 1 else [f"{g}b"], 10) for g in range(20) for i in range(60)]
    out, sizes, goal = mixing.mix(spark.createDataFrame(rows, ROWS), share=1, weights=lambda s: dict.fromkeys(s, 1))
    assert set(sizes.values()) == {400}
    taken = Counter()
    for r in out.collect():
        taken[r.sources[0][:-1]] += r.taken
    assert all(abs(taken[str(g)] - goal[f"{g}a"] - goal[f"{g}b"]) <= 10 for g in range(20))


def test_stage_keeps_columns_of_clashing_names(spark):
    rows = [(1, "one two three", "a", "mine", 5, 6, 7)] * 10 + [(2, "four five six", "a", "yours", 8, 9, 10), (3, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _key string, key int, n int, times int")
    out = mixing.mix_stage(spark, df, "")
    assert out.columns == df.columns
    got = Counter(tuple(r) for r in out.collect())
    assert set(got) <= set(rows) and 15 <= sum(got.values()) <= 17  # 33 words, 150 % of them are asked for


def test_empty_texts_are_taken_no_times(spark):
    rows = [(i, t, "a") for i, t in enumerate(["", None, " \n", "one", "two words", "", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    units, _ = mixing.mix_units(mixing.sized(df))
    assert all(u.times == u.extra == 0 for u in units.collect() if u.size == 0)
    assert {r.doc_id for r in mixing.mix_stage(spark, df, "").collect()} <= {3, 4}
