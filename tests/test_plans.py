from ledgerlake.operators import metrics as M
from ledgerlake.plans import metric_catalog as MC
from ledgerlake.plans import pipeline as PL
from ledgerlake.sources import tables as T
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_metric_scan_pushes_filters_and_prunes(spark):
    plan = _plan(M.metric_comparison(T.sales(spark, SF_SMALL), MC.REQ))
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan or "GreaterThanOrEqual(o_orderdate" in plan
    assert "o_orderpriority" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_no_python_udf_anywhere(spark):
    for df in (M.metric_series(T.sales(spark, SF_SMALL), MC.REQ), PL.run(T.raw_sales(spark, SF_SMALL), anomaly=False).gold):
        p = _plan(df)
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p


def test_dedup_is_aggregate_not_window(spark):
    p = _plan(PL.run(T.raw_sales(spark, SF_SMALL), anomaly=False).audited)
    assert "Aggregate" in p and "Window" not in p  # partial (map-side) aggregate, no per-key sort of all rows


def test_single_split_scan_is_spread_over_task_slots(spark):
    from ledgerlake.sources.partitioning import spread_scan, task_slots

    one = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").coalesce(1)
    spread = spread_scan(one, "l_orderkey")
    assert spread.rdd.getNumPartitions() >= task_slots(one)
    assert "Exchange hashpartitioning(l_orderkey" in _plan(spread)
    wide = spark.range(0, 1000, numPartitions=task_slots(one))
    assert spread_scan(wide, "id") is wide  # already parallel: no extra shuffle


def test_staged_split_reads_a_plain_predicate(spark):
    from ledgerlake.operators import cleaning as C
    from ledgerlake.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    kept, rejected = C.reject_missing(PL.staged_standardize(T.raw_sales(spark, SF_SMALL)))
    p = _plan(rejected)
    # the split filters the staged table, it does not re-run the date parser
    assert "to_timestamp" not in p and "regexp_replace" not in p
    assert rejected.count() + kept.count() == T.raw_sales(spark, SF_SMALL).count()


def test_warehouse_write_is_range_partitioned_by_date(spark):
    from ledgerlake.sources import files as IO

    p = _plan(IO.warehouse_layout(T.sales(spark, SF_SMALL)))
    assert "rangepartitioning(order_date" in p and "order_id" in p.split("rangepartitioning(")[1].split(")")[0]
    assert "hashpartitioning(order_year" not in p


def test_metric_response_reads_each_table_once(spark):
    from dataclasses import replace

    for metric, grain in (("profit_margin_pct", "month"), ("revenue_growth_pct", "week"), ("revenue_total_usd", "day")):
        req = replace(MC.REQ, metric_id=metric, time_grain=grain, group_by="country")
        p = _plan(M.metric_query_rows(T.sales(spark, SF_SMALL), req))
        assert p.count("FileScan parquet [o_") == 1
        assert p.count("FileScan parquet [l_") == (metric == "profit_margin_pct")  # revenue needs no costs


def test_metric_plans_are_built_without_jobs(spark):
    sc = spark.sparkContext
    sc.setJobGroup("plan-only", "no action")
    try:
        sales = T.sales(spark, SF_SMALL)
        M.metric_query_rows(sales, MC.REQ), M.metric_series(sales, MC.REQ), M.growth_breakdown(sales, MC.REQ)
        assert list(sc.statusTracker().getJobIdsForGroup("plan-only")) == []
    finally:
        sc._jsc.clearJobGroup()
