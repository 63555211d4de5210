import datetime as dt

from pyspark.sql import functions as F

from ledgerlake.operators import cleaning as C
from ledgerlake.operators import enrichment as E
from ledgerlake.operators import validation as V
from ledgerlake.plans import pipeline as PL
from ledgerlake.sources import tables as T
from tests.conftest import SF_SMALL

HEAD = ["_source_pos", "OrderID", "OrderDate", "Amount", "Currency", "Region", "OrderStatus", "Customer", "Product"]


def _raw(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{h} string" for h in HEAD))


def test_reject_missing_reasons(spark):
    raw = _raw(spark, [
        ("1", "A", "2024-01-01", "10", "USD", "EMEA", "DONE", "c1", "Rack Cabinet"),
        ("2", "B", "bad", "10", "USD", "EMEA", "DONE", "c1", "Rack Cabinet"),
        ("3", "C", "bad", "N/A", "USD", "EMEA", "DONE", "c1", "Rack Cabinet"),
        ("4", None, None, "", None, "EMEA", "DONE", "c1", "Rack Cabinet"),
    ])
    kept, rej = C.reject_missing(C.standardize(raw))
    assert [r[0] for r in kept.select("_source_pos").collect()] == ["1"]
    got = {r["_source_pos"]: r["failure_reason"] for r in rej.collect()}
    assert got == {
        "2": "UNPARSEABLE_OR_MISSING_ORDER_DATE",
        "3": "UNPARSEABLE_OR_MISSING_AMOUNT_ORDER_DATE",
        "4": "UNPARSEABLE_OR_MISSING_ORDER_ID_AMOUNT_ORDER_DATE_CURRENCY",
    }
    assert {r["severity"] for r in rej.collect()} == {"CRITICAL"}
    assert rej.select("_raw.amount").where("_source_pos = '3'").first()[0] is None  # 'N/A' read as missing


def test_dedup_keeps_fullest_then_earliest(spark):
    raw = _raw(spark, [
        ("1", "A", "2024-01-01", "10", "USD", None, "DONE", None, None),
        ("2", "A", "2024-01-01", "10", "USD", "EMEA", "DONE", "c1", None),   # fullest -> kept
        ("3", "B", "2024-01-01", "10", "USD", "EMEA", "DONE", "c1", None),   # tie -> earliest kept
        ("4", "B", "2024-01-01", "10", "USD", "EMEA", "DONE", "c1", None),
        ("5", "C", "2024-01-01", "10", "USD", "EMEA", "DONE", "c1", None),
    ])
    std = C.standardize(raw)
    kept, dropped = C.dedup_keep_fullest(std, score_cols=C.data_columns(std))
    assert sorted(r[0] for r in kept.select("_source_pos").collect()) == ["2", "3", "5"]
    assert sorted(r[0] for r in dropped.select("_source_pos").collect()) == ["1", "4"]
    assert {r["failure_reason"] for r in dropped.collect()} == {"REDUNDANT_DUPLICATE_ORDER_ID"}
    dup = {r["_source_pos"]: r["is_duplicate"] for r in C.detect_duplicates(std).collect()}
    assert dup == {"1": True, "2": True, "3": True, "4": True, "5": False}


def test_dedup_hot_key_is_exact(spark):
    # one key holding most rows: the aggregate + join path must still keep exactly one
    rows = [(f"{i:06d}", "HOT", "2024-01-01", "10", "USD", "EMEA" if i == 777 else None, "DONE", "c", None) for i in range(3000)]
    rows += [(f"x{i}", f"K{i}", "2024-01-01", "10", "USD", None, "DONE", "c", None) for i in range(100)]
    std = C.standardize(_raw(spark, rows))
    kept, dropped = C.dedup_keep_fullest(std, score_cols=C.data_columns(std))
    hot = kept.filter(F.col("order_id") == "HOT").collect()
    assert len(hot) == 1 and hot[0]["_source_pos"] == "000777"
    assert kept.count() == 101 and dropped.count() == 2999


def _validated(spark, rows):
    schema = "amount_usd double, cost_usd double, order_status string, product string, currency string"
    df = spark.createDataFrame(rows, schema)
    df = E.margin_flags(E.profit_margin_columns(df))
    return [(r["validation_issues"], r["severity"]) for r in V.validate_rules(df).collect()]


def test_validate_rules_each_and_combined(spark):
    got = _validated(spark, [
        (1000.0, 100.0, "COMPLETED", "Thunderbolt Dock", "USD"),    # margin 90 -> unrealistic
        (100.0, 500.0, "COMPLETED", "Thunderbolt Dock", "USD"),     # -400 -> loss + out of range
        (-5.0, None, "PENDING", None, "USD"),                       # invalid amount
        (60000.0, None, "PENDING", None, "USD"),                    # excessive
        (900.0, None, "PENDING", "MacBook Pro M3", "USD"),          # floor
        (10.0, None, "PENDING", None, "XYZ"),                       # unknown currency
        (1000.0, None, "COMPLETED", "Gadget", "USD"),               # null cost -> null margin -> OK
        (0.0, 800.0, "COMPLETED", "Rack Cabinet", "EUR"),           # zero revenue with cost
        (500.0, 400.0, "COMPLETED", "Rack Cabinet", "USD"),         # clean
    ])
    assert got == [
        ("UNREALISTIC_PROFIT_MARGIN", "SUSPICIOUS"),
        ("SUSPICIOUS_LOSS_MARGIN; MARGIN_OUT_OF_RANGE", "CRITICAL"),
        ("INVALID_REVENUE_AMOUNT", "CRITICAL"),
        ("EXCESSIVE_TRANSACTION_VALUE", "SUSPICIOUS"),
        ("UNIT_PRICE_LOW_MACBOOK_PRO_M3", "SUSPICIOUS"),
        ("UNKNOWN_CURRENCY", "CRITICAL"),
        ("", "OK"),
        ("INVALID_REVENUE_AMOUNT; SUSPICIOUS_LOSS_MARGIN; MARGIN_OUT_OF_RANGE; UNIT_PRICE_LOW_RACK_CABINET", "CRITICAL"),
        ("", "OK"),
    ]


def test_pipeline_reconciles_and_report(spark):
    from tests.conftest import SF_SMALL
    from ledgerlake.operators import audit as A
    from ledgerlake.sources import tables as T

    res = PL.run(T.raw_sales(spark, SF_SMALL), checkpoint=True)
    rec = A.reconcile_counts(res.raw, res.gold, res.error_log).first()
    assert rec["mismatch_delta"] == 0 and rec["checksum_status"] == "VERIFIED"
    assert res.gold.select("order_id").distinct().count() == res.gold.count()
    audit = {r["check"]: r["failures"] for r in A.gold_audit(res.gold, res.error_log).collect()}
    assert audit["duplicate_order_ids"] == 0 and audit["profit_calculation"] == 0 and audit["error_log_columns"] == 0
    rep = PL.report(res).first()
    assert rep["raw_total_rows"] == rep["valid_rows_gold"] + rep["rejected_rows_total"]
    sev = {r["severity"]: r["count"] for r in A.severity_counts(res.error_log).collect()}
    assert set(sev) >= {"CRITICAL", "HIGH", "MEDIUM", "LOW", "WARNING", "SUSPICIOUS"} and sev["HIGH"] == 0


def test_report_percentages_round_like_python(spark):
    # the stored sample report's counts, plus exact decimal ties (x.xx5),
    # where rounding from the shortest decimal text would differ
    pairs = [(5101 - 1002, 5101), (5101 - 82, 5101), (5101 - 675, 5101), (3342, 5101),
             (3, 60000), (9, 60000), (1, 32), (2675, 100000), (1, 8), (0, 7), (7, 7)]
    df = spark.createDataFrame(pairs, "part long, whole long")
    got = [r[0] for r in df.select(V.pct_2dp("part", "whole")).collect()]
    assert got == [round((p / w) * 100, 2) for p, w in pairs]
    assert got[:4] == [80.36, 98.39, 86.77, 65.52]
    assert dt.date(2024, 1, 1).weekday() == 0


def test_tagged_report_equals_three_table_report(spark):
    from ledgerlake.operators import audit as A
    from ledgerlake.sources import tables as T
    from tests.conftest import SF_SMALL

    res = PL.run(T.raw_sales(spark, SF_SMALL), anomaly=False)
    tagged = PL.report(res).first().asDict()
    separate = A.audit_report(res.raw, res.gold, res.error_log).first().asDict()
    assert tagged == separate
    assert tagged["checksum_status"] == "VERIFIED" and tagged["mismatch_delta"] == 0


def test_presence_from_raw_text_matches_typed_columns(spark):
    from ledgerlake.sources import tables as T
    from tests.conftest import SF_SMALL

    std = C.standardize(T.raw_sales(spark, SF_SMALL))
    cols = [c for c in C.data_columns(std) if c not in C.PARSED_COLUMNS]
    bad = std.agg(*[F.count_if(F.col(c).isNull() != F.col(f"{C.RAW}.{c}").isNull()).alias(c) for c in cols]).first()
    assert all(v == 0 for v in bad.asDict().values()), bad


def test_winners_join_on_the_position(spark):
    std = C.standardize(_raw(spark, [("1", "A", "2024-01-01", "10", "USD", None, "DONE", "c", None), ("2", None, "2024-01-01", "10", "USD", None, "DONE", "c", None),
                                     ("3", None, "2024-01-01", "10", "USD", None, "DONE", "c", None)]))
    marked = C.mark_duplicates(std, score_cols=C.data_columns(std))
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter, (_source_pos" in plan  # no key of many rows meets in a join
    assert {r["_source_pos"]: r["_keep"] for r in marked.collect()} == {"1": True, "2": True, "3": True}  # no key: all stay


def test_a_run_leaves_no_staged_table(spark):
    import os

    from ledgerlake.session import checkpoint_dir

    before = set(os.listdir(checkpoint_dir(spark)))
    res = PL.run(T.raw_sales(spark, SF_SMALL), checkpoint=True)
    assert res.gold.count() > 0 and len(set(os.listdir(checkpoint_dir(spark))) - before) == 1
    res.close()
    assert set(os.listdir(checkpoint_dir(spark))) <= before
