"""Digests against planted differences, and pages against offset and limit."""

import datetime as dt
from collections import Counter

import pytest

from ledgerlake.operators import metrics as M
from ledgerlake.operators import parity as P
from ledgerlake.sources import tables as T
from tests.conftest import SF_SMALL

SCHEMA = "order_id string, a string, b string, x double"
ROWS = [(str(i), "u", None if i % 5 == 0 else "v", float(i)) for i in range(200)]


@pytest.mark.parametrize("change, want", [
    (lambda r: r, {}),
    (lambda r: r[::-1], {}),
    (lambda r: r[1:], {(ROWS[0], "left_only"): 1}),
    (lambda r: [*r, r[7], r[7]], {(ROWS[7], "right_only"): 2}),
    (lambda r: [("0", None, "u", 0.0), *r[1:]], {(ROWS[0], "left_only"): 1, (("0", None, "u", 0.0), "right_only"): 1}),  # nulls change places
    (lambda r: [*r, (None, None, None, None)], {((None, None, None, None), "right_only"): 1}),
    (lambda r: [], {(x, "left_only"): 1 for x in ROWS}),
])
@pytest.mark.parametrize("buckets", [1, 64])
def test_planted_differences(spark, change, want, buckets):
    a, b = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(change(ROWS), SCHEMA)
    got = Counter(((r.order_id, r.a, r.b, r.x), r.side) for r in P.digest_diff(a, b, ["order_id"], buckets).collect())
    assert got == want


def test_only_unequal_buckets_are_compared(spark):
    a = spark.createDataFrame(ROWS, SCHEMA)
    b = spark.createDataFrame(ROWS[1:], SCHEMA)
    (r,) = P.unequal_buckets(a, b, ["order_id"], 64).collect()
    assert r.left_rows == r.right_rows + 1 < 20


def test_any_page(spark):
    df = T.sales(spark, SF_SMALL).select("order_id", "order_date", "revenue_usd")
    df = df.unionAll(spark.createDataFrame([(str(-i), None, 1.0) for i in range(45)], df.schema))
    directory, listing = P.page_directory(df).cache(), [tuple(r) for r in M.orders_listing(df).collect()]
    for page in (1, 2, 3, 4, 17, len(listing) // 20, len(listing) // 20 + 1, len(listing) // 20 + 2):
        assert [tuple(r) for r in P.page_at(df, directory, page, 20).collect()] == listing[(page - 1) * 20 : page * 20]


def test_page_filters_the_scan(spark):
    df = T.sales(spark, SF_SMALL)
    plan = P.page_at(df, P.page_directory(df), 40, 20)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan
    assert P.page_at(df.where("false"), P.page_directory(df.where("false")), 1, 20).count() == 0


def test_one_date(spark):
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(f"{i:03d}", day) for i in range(100)], "order_id string, order_date date")
    assert [r.order_id for r in P.page_at(df, P.page_directory(df), 4, 20).collect()] == [f"{i:03d}" for i in range(60, 80)]
