"""The staged form of the cleaning pipeline: rows are parsed and judged once, and stay where they are."""

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import cleaning as C
from ledgerlake.plans import pipeline as PL
from ledgerlake.session import new_table
from ledgerlake.sources import tables as T

FIELDS = dict.fromkeys(T.RAW_HEADERS) | {"OrderDate": "2024-05-06", "Currency": "USD", "OrderStatus": "done", "Product": "Generic x", "Customer": "c"}


def _raw(spark, rows):
    """(position, order id, amount, region) -> raw sales rows."""
    made = [(pos, *(FIELDS | {"OrderID": key, "Amount": amount, "Region": region}).values()) for pos, key, amount, region in rows]
    return spark.createDataFrame(made, ", ".join(f"{c} string" for c in ("_source_pos", *T.RAW_HEADERS)))


@pytest.fixture
def raw(spark):
    rows = [(f"h{i:04d}", "HOT", str(100 + i), "EMEA" if i >= 300 else None) for i in range(900)]  # a key of most rows
    rows += [(f"u{i:03d}", f"K{i}", str(50 + i % 7), " emea") for i in range(200)]
    rows += [("t1", "TWICE", "12", None), ("t1", "TWICE", "12", None), ("t0", "TWICE", "bad", None), ("n1", None, "5", None), ("n2", "N/A", "x", None)]
    return _raw(spark, rows).repartition(7)


def _sorted(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("buckets", [C.BROADCAST_BUCKETS, 0])
def test_staged_rows_give_what_the_lazy_plan_gives(spark, raw, monkeypatch, buckets):
    monkeypatch.setattr(C, "BROADCAST_BUCKETS", buckets)
    staged, lazy = PL.run(raw, checkpoint=True), PL.run(raw)
    assert _sorted(staged.audited) == _sorted(lazy.audited)
    assert _sorted(staged.gold) == _sorted(lazy.gold) and _sorted(staged.error_log) == _sorted(lazy.error_log)
    kept = staged.audited.where("stage IS NULL OR stage = 'VALIDATE'")
    assert [r.source_pos for r in kept.where("order_id = 'HOT'").collect()] == ["h0300"]  # the fullest, then the first
    assert kept.where("order_id = 'TWICE'").count() == 2  # a position that comes twice stays twice
    staged.close()


def test_wide_rows_are_neither_shuffled_nor_judged_again(spark, raw):
    res = PL.run(raw, checkpoint=True)
    for df in (res.gold, res.error_log):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
        assert "INVALID_REVENUE_AMOUNT" not in plan
    res.close()


def test_stage_outputs_read_the_staged_rows(spark, raw):
    out = PL.stage_outputs(raw)
    plan = out["validate_rejects"]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "try_make_timestamp" not in plan
    assert out["clean_rejects"].count() == 3 and out["deduped"].count() == 203 and out["dedup_drops"].count() == 899


def test_row_numbers_are_unique(spark, raw):
    rows = C.stage_rows(raw, new_table(spark, "rows"))
    assert rows.select(C.ROW).distinct().count() == rows.count() == 1105
    names = C.data_columns(C.standardize(raw))
    want = C.standardize(raw)
    assert _sorted(C.restore(rows, names).select(*want.columns)) == _sorted(want)
    assert rows.where(F.col(C.MISSING)).count() == 3


def _placed(spark, rows):
    """(position, order id, fullness) -> staged rows, numbered from 0."""
    return spark.createDataFrame([(p, (k,), s, i) for i, (p, k, s) in enumerate(rows)], f"{C.SOURCE_POS} string, {C.RAW} struct<order_id:string>, {C.SCORE} int, {C.ROW} long")


def _kept(rows):
    return sorted(r[C.ROW] for r in C.kept_rows(rows).collect())


def test_winners_need_one_shuffle_where_positions_are_unique(spark):
    rows = _placed(spark, [("a", "K", 3), ("b", "K", 5), ("c", "K", 5), ("d", "L", 1), ("e", None, 9), (None, "M", 2), (None, None, 1)])
    plan = C.kept_rows(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning") == 1
    assert _kept(rows) == [1, 3]  # the fullest, then the first; a winner without a position is not found


def test_every_row_at_a_winners_position_stays(spark):
    rows = _placed(spark, [("a", "K", 5), ("a", "K", 5), ("a", "K", 2), ("a", "L", 1), ("b", "L", 4), ("a", None, 1), ("c", "N", 1), ("c", "N", 1), ("d", "K", 9), ("d", "O", 1)])
    by_position = C.dedup_winners(rows.select(F.col(f"{C.RAW}.order_id").alias("order_id"), C.SOURCE_POS, C.SCORE).where("order_id IS NOT NULL"))
    want = rows.join(by_position, F.col(C.SOURCE_POS) == F.col("_keep_pos"), "left_semi")
    assert _kept(rows) == sorted(r[C.ROW] for r in want.collect()) == [4, 6, 7, 8, 9]


def test_only_rows_that_pass_the_duplicates_get_a_name(spark, raw):
    for res in (PL.run(raw, checkpoint=True), PL.run(raw)):
        named = F.col("customer_name").isNotNull() & F.col("customer_type").isNotNull()
        survivor = F.col("stage").isNull() | (F.col("stage") == "VALIDATE")
        assert res.audited.where(survivor & ~named).count() == 0 and res.audited.where(~survivor & named).count() == 0
        res.close()


def test_keep_flags_are_words_of_32_bits(spark):
    numbers = [0, 7, 8, 31, 32, 63, 32766, 32767, 32768, 65567, (1 << 33) + 31, (5 << 33) + 4095]
    rows = spark.createDataFrame([(n + d,) for n in numbers for d in range(-1, 3) if n + d >= 0], f"{C.ROW} long").distinct()
    bits = C.keep_bits(spark.createDataFrame([(n,) for n in numbers], f"{C.ROW} long"))
    assert {len(r._words) for r in bits.collect()} == {1024}
    assert sorted(r[C.ROW] for r in C.join_keep(rows, bits).where("_keep").collect()) == numbers


def test_only_rows_that_pass_the_duplicates_get_region_and_country(spark, raw):
    for res in (PL.run(raw, checkpoint=True), PL.run(raw)):
        went = F.coalesce(F.col("stage").isin("CLEAN", "DEDUP"), F.lit(False))
        assert res.audited.where(went & (F.col("region").isNotNull() | F.col("country").isNotNull())).count() == 0
        assert res.audited.where(~went & F.col("region").isNotNull()).count() > 0
        res.close()
