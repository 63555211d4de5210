"""From a raw file to gold, log and report; warehouse months and the rollup after an append."""

import json
import re

import pytest
from pyspark.sql import functions as F

from ledgerlake import reference_data as R
from ledgerlake.operators import audit as A
from ledgerlake.operators import metrics as M
from ledgerlake.operators import rollup as RU
from ledgerlake.plans import metric_catalog as MC
from ledgerlake.plans import pipeline as PL
from ledgerlake.sources import files as IO
from ledgerlake.sources import tables as T
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("run"))
    IO.write_csv(T.raw_sales(spark, SF_SMALL), f"{out}/raw_sales.csv")
    return PL.run_files(spark, [f"{out}/raw_sales_master.csv", f"{out}/raw_sales.csv"], out)


def test_the_observed_report_equals_the_counted_one(spark, ran):
    res = PL.run(T.raw_sales(spark, SF_SMALL), checkpoint=True)
    assert ran.source.endswith("raw_sales.csv")
    assert ran.report.collect() == PL.report(res).collect()
    assert ran.reasons.collect() == A.reason_counts(res.error_log).collect()
    assert {tuple(r) for r in ran.severities.collect()} == {tuple(r) for r in A.severity_counts(res.error_log).collect()}
    assert "FileScan" not in ran.report._jdf.queryExecution().executedPlan().toString()
    gold = IO.read_csv_typed(spark, ran.gold, res.gold.schema)
    assert sorted(map(str, gold.collect())) == sorted(map(str, res.gold.collect()))
    res.close()


def test_gold_and_log_are_compressed_and_read_back_whole(spark, ran, monkeypatch, tmp_path):
    from pathlib import Path

    res = PL.run(T.raw_sales(spark, SF_SMALL), checkpoint=True)
    for path in (ran.gold, ran.error_log):
        assert {f.suffix for f in Path(path).glob("part-*")} == {".gz"}
    log = IO.read_csv_typed(spark, ran.error_log, res.error_log.schema).drop("source_pos")
    assert log.count() == res.error_log.count() and log.exceptAll(res.error_log.drop("source_pos")).isEmpty()
    monkeypatch.setattr(IO, "GZIP_ROWS", 100)  # such files are not split: many small ones
    IO.write_gold(res.gold.coalesce(1), f"{tmp_path}/gold")
    assert len(list((tmp_path / "gold").glob("part-*"))) == -(-res.gold.count() // 100)
    res.close()


def test_report_file_has_all_sections(spark, ran):
    report = json.loads(spark.read.text(ran.report_json).first().value)
    flat = ran.report.first()
    assert list(report) == ["report_metadata", "summary_counts", "data_quality_dimensions", "severity_breakdown", "rejection_reason_breakdown"]
    assert report["summary_counts"]["raw_total_rows"] == flat.raw_total_rows == T.raw_sales(spark, SF_SMALL).count()
    assert report["data_quality_dimensions"]["completeness_score"] == f"{flat.completeness_score}%"


def test_unknown_reasons_are_left_to_a_scan(spark):
    log = spark.createDataFrame([("CRITICAL", "UNKNOWN_CURRENCY; NEW_CODE"), ("CRITICAL", "UNKNOWN_CURRENCY")], "severity string, failure_reason string")
    counters = log.agg(*A.log_counters()).first().asDict()
    assert counters["reason:UNKNOWN_CURRENCY"] == 2 and A.observed_report(spark, {"n": 2}, {"n": 0}, counters) is None


def test_counters_equal_patterns_and_need_none(spark):
    codes = [*A.reason_codes(), "NULL_X", "DISCREPANCY", "NO CODE", ""]
    log = spark.createDataFrame([("CRITICAL", "; ".join(c)) for i in range(len(codes)) for c in ([codes[i]], [codes[i - 1], codes[i]], [codes[i - 2], codes[i], codes[0]])], "severity string, failure_reason string")
    counted = log.agg(*A.log_counters())
    assert "RLIKE" not in counted._jdf.queryExecution().optimizedPlan().toString().upper()
    got, reasons = counted.first().asDict(), [r.failure_reason for r in log.collect()]
    for name, rx in R.QUALITY_DIMENSIONS.items():
        assert got[name.replace("_score", "_failures")] == sum(bool(re.search(rx, r)) for r in reasons)
    for code in A.reason_codes():
        assert got[f"reason:{code}"] == sum(code in r.split("; ") for r in reasons)


def test_no_candidate_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        PL.run_files(spark, [f"{tmp_path}/a.csv"], str(tmp_path))


def test_only_changed_months_are_rewritten(spark, tmp_path):
    warehouse, path = f"{tmp_path}/orders", f"{tmp_path}/rollup"
    sales = T.sales(spark, SF_SMALL)
    early = sales.where(~((F.col("order_year") == 1997) & (F.col("order_month") == 3) & (F.col("order_id") > "3")))
    IO.load_warehouse(early.where("order_year <> 1998 OR order_month <> 1"), warehouse)
    RU.write_rollup(spark.read.parquet(warehouse), path)
    months = [(1997, 3), (1998, 1)]
    changed = {f"order_year={y}/order_month={m}" for y, m in months}

    def files(folder):
        return {str(f): f.stat().st_mtime_ns for f in (tmp_path / folder).rglob("*.parquet") if not any(c in str(f) for c in changed)}

    before = files("orders"), files("rollup")
    IO.load_warehouse(sales, warehouse, months=months)
    RU.refresh_rollup(spark, warehouse, path, months)
    assert (files("orders"), files("rollup")) == before
    rolled = spark.read.parquet(path)
    assert rolled.agg(F.sum("orders")).first()[0] == sales.count()
    for metric in ("revenue_total_usd", "profit_margin_pct", "revenue_growth_pct"):
        req = MC._req(metric)
        for part in (M.metric_series, M.metric_comparison, lambda d, r: M.metric_breakdown(d, r, "country")):
            got = part(rolled, req)
            assert got.collect() == part(sales, req).collect()
            assert "l_orderkey" not in got._jdf.queryExecution().executedPlan().toString()
    IO.load_warehouse(sales.where("order_year <> 1998 OR order_month <> 1"), warehouse + "2")
    RU.refresh_rollup(spark, warehouse + "2", path, [(1998, 1)])  # a month without rows any more
    assert (1998, 1) not in RU.months_of(spark.read.parquet(path))
