"""Metrics by product on the line grain; staged tables that no result reads."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import metrics as M
from ledgerlake.plans import catalog
from ledgerlake.session import drop_tables, drop_unread, materialize, staged_tables
from ledgerlake.sources import tables as T
from tests.conftest import SF_SMALL


def request(metric, **kw):
    return M.MetricRequest(metric, dt.date(1997, 1, 1), dt.date(1998, 12, 31), **kw)


def test_products_add_up_to_the_total(spark):
    lines = T.sales_lines(spark, SF_SMALL)
    parts = M.metric_breakdown(lines, request("revenue_total_usd"), "product")
    total = M.metric_value(lines, request("revenue_total_usd")).first().value
    assert parts.count() > 50 and abs(parts.agg(F.sum("value")).first()[0] - total) < 1e-3
    assert lines.count() == T.read_table(spark, SF_SMALL, "lineitem").count()


def test_costs_of_the_lines_are_those_of_the_orders(spark):
    lines = T.sales_lines(spark, SF_SMALL).groupBy("order_id").agg(F.sum("cost_usd").alias("of_lines"))
    both = T.sales(spark, SF_SMALL).join(lines, "order_id")
    assert both.count() > 1000 and both.where("abs(cost_usd - of_lines) > 1e-4").isEmpty()


def test_order_grain_has_no_product(spark):
    with pytest.raises(ValueError):
        M.metric_breakdown(T.sales(spark, SF_SMALL), request("revenue_total_usd"), "product")


def test_breakdown_by_product_reads_only_its_columns(spark):
    plan = M.metric_breakdown(T.sales_lines(spark, SF_SMALL), request("revenue_total_usd"), "product")._jdf.queryExecution().executedPlan().toString()
    assert "c_name" not in plan and "l_quantity" not in plan and "GreaterThanOrEqual(o_orderdate" in plan


def test_only_staged_tables_that_are_read_stay(spark):
    before = staged_tables()
    kept, gone = materialize(spark.range(5).toDF("a"), "kept"), materialize(spark.range(5).toDF("b"), "gone")
    assert gone.count() == 5
    result = drop_unread(kept.where("a > 1"), before)
    new = [p for p in staged_tables() if p not in before]
    assert [os.path.basename(p).split("-")[0] for p in new] == ["kept"] and result.count() == 3
    drop_tables(spark, new)
    assert not os.path.exists(new[0]) and staged_tables() == before


@pytest.mark.parametrize("key", ["write_gold", "load_warehouse", "observed_report"])
def test_queries_that_write_their_result_leave_no_staged_table(spark, key):
    before = staged_tables()
    assert catalog.queries()[key](spark, SF_SMALL).count() > 0
    assert staged_tables() == before
