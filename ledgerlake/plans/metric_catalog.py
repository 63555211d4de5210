"""Registered metric-layer queries over the ``sales`` view and their oracles.

Parameters are fixed request values (date windows, region lists); every
query runs over the whole tables.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from .. import reference_data as R
from ..functions import scalars as S
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import parity as P
from ..operators import rollup as RU
from ..operators import search as X
from ..session import ensure_checkpoint_dir
from ..sources import files as IO
from ..sources import tables as T
from . import sql_text as Q

START, END = dt.date(1997, 1, 1), dt.date(1998, 12, 31)
PREV_START, PREV_END = M.previous_period(START, END)
REGIONS = ("North America", "Europe, Middle East and Africa")
STATUSES = ("COMPLETED", "CANCELED")
BOOL_TEXTS = ("no", "Yes ", "TRUE", "t", " y", "0", "1", "false", "", "truely")

REQ = M.MetricRequest("revenue_total_usd", START, END)


def _sales(spark, sf):
    return T.sales(spark, sf)


def _req(metric_id, **kw):
    return replace(REQ, metric_id=metric_id, **kw)


W_CUR = Q.metric_where(START, END)
W_ALL = Q.metric_where(PREV_START, END)
IN_CUR = f"order_date >= DATE '{START}'"
IN_PREV = f"order_date <= DATE '{PREV_END}'"


def _value_sql(metric_id):
    return Q.with_sales() + f"SELECT COALESCE({Q.metric_agg(metric_id)}, 0.0) AS value FROM sales WHERE {W_CUR}"


def _comparison_sql(metric_id, region=()):
    w = Q.metric_where(PREV_START, END, region)
    tail = f", DATE '{PREV_START}' AS comparison_start, DATE '{PREV_END}' AS comparison_end"
    if metric_id == "revenue_growth_pct":
        g = Q.growth("cur", "prev")
        return Q.with_sales() + (
            f"SELECT '{metric_id}' AS metric_id, {g} AS value, CAST(NULL AS DOUBLE) AS comparison_value, {g} AS delta, "
            f"'PCT' AS delta_unit, CAST(NULL AS DOUBLE) AS delta_pct{tail} FROM ("
            f"SELECT COALESCE({Q.msum('revenue_usd', IN_CUR)}, 0.0) AS cur, COALESCE({Q.msum('revenue_usd', IN_PREV)}, 0.0) AS prev "
            f"FROM sales WHERE {w})"
        )
    unit = "pp" if metric_id == "profit_margin_pct" else R.METRICS[metric_id][1]
    dpct = "CAST(NULL AS DOUBLE)" if metric_id == "profit_margin_pct" else \
        "(CASE WHEN comparison_value <> 0 THEN (value - comparison_value) / comparison_value * 100.0 END)"
    return Q.with_sales() + (
        f"SELECT '{metric_id}' AS metric_id, value, comparison_value, value - comparison_value AS delta, "
        f"'{unit}' AS delta_unit, {dpct} AS delta_pct{tail} FROM ("
        f"SELECT COALESCE({Q.metric_agg(metric_id, IN_CUR)}, 0.0) AS value, "
        f"COALESCE({Q.metric_agg(metric_id, IN_PREV)}, 0.0) AS comparison_value FROM sales WHERE {w})"
    )


def _series_sql(metric_id, grain, region=()):
    w = Q.metric_where(START, END, region)
    b = Q.bucket("order_date", grain)
    base = f"SELECT {b} AS period_start, {Q.metric_agg(metric_id)} AS value FROM sales WHERE {w} GROUP BY 1"
    if metric_id == "revenue_growth_pct":
        return Q.with_sales() + (
            f"SELECT period_start, {Q.growth('value', 'prev')} AS value FROM ("
            f"SELECT period_start, value, LAG(value) OVER (ORDER BY period_start) AS prev FROM ({base}))"
        )
    return Q.with_sales() + base


def _breakdown_sql(metric_id, dim):
    return Q.with_sales() + (
        f"SELECT {dim} AS key, {Q.metric_agg(metric_id)} AS value FROM sales WHERE {W_CUR} GROUP BY 1"
    )


def _period_totals_sql(dim, region=()):
    w = Q.metric_where(PREV_START, END, region)
    return (
        f"SELECT {dim} AS key, COALESCE({Q.msum('revenue_usd', IN_CUR)}, 0.0) AS cur_value, "
        f"COALESCE({Q.msum('revenue_usd', IN_PREV)}, 0.0) AS prev_value FROM sales WHERE {w} GROUP BY 1"
    )


def _box_sql(grain):
    series = (
        f"SELECT {Q.bucket('order_date', grain)} AS period_start, {Q.metric_agg('profit_margin_pct')} AS value "
        f"FROM sales WHERE {W_CUR} GROUP BY 1"
    )

    def qa(p):
        h = f"(CAST(n - 1 AS DOUBLE) * {p})"
        lo = f"xs[CAST(floor({h}) AS BIGINT) + 1]"
        hi = f"xs[CAST(ceil({h}) AS BIGINT) + 1]"
        return f"({lo} + ({h} - floor({h})) * ({hi} - {lo}))"

    return Q.with_sales() + (
        "SELECT count, q1, median, q3, iqr, whisker_low, whisker_high, outliers FROM ("
        "SELECT CAST(n AS BIGINT) AS count, q1, median, q3, iqr, "
        "list_min(list_filter(xs, lambda x: x >= lo AND x <= hi)) AS whisker_low, "
        "list_max(list_filter(xs, lambda x: x >= lo AND x <= hi)) AS whisker_high, "
        f"list_filter(xs, lambda x: x < lo OR x > hi) AS outliers FROM ("
        "SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM ("
        f"SELECT xs, n, {qa(0.25)} AS q1, {qa(0.5)} AS median, {qa(0.75)} AS q3 FROM ("
        f"SELECT list_sort(list(value)) AS xs, count(value) AS n FROM ({series}) WHERE value IS NOT NULL AND NOT isnan(value)"
        ")) WHERE n >= 3)) WHERE whisker_low IS NOT NULL"
    )


SALES_COLS = (
    "order_id, order_date, order_year, order_month, order_status, customer_id, customer_name, region, "
    "region_group, country, category, payment_method, revenue_usd, cost_usd, profit_usd, margin_pct"
)


def build():
    q, o = {}, {}

    # A6 / flagship: monthly completed revenue
    q["metric_series"] = lambda s, sf: M.metric_series(_sales(s, sf), REQ)
    o["metric_series"] = _series_sql("revenue_total_usd", "month")
    q["profit_series_daily"] = lambda s, sf: M.metric_series(_sales(s, sf), _req("profit_total_usd", time_grain="day"))
    o["profit_series_daily"] = _series_sql("profit_total_usd", "day")
    q["margin_series_weekly"] = lambda s, sf: M.metric_series(_sales(s, sf), _req("profit_margin_pct", time_grain="week"))
    o["margin_series_weekly"] = _series_sql("profit_margin_pct", "week")
    # W1: growth over the previous present bucket
    q["series_growth"] = lambda s, sf: M.metric_series(_sales(s, sf), _req("revenue_growth_pct", region=REGIONS[:1]))
    o["series_growth"] = _series_sql("revenue_growth_pct", "month", REGIONS[:1])

    # A5, A6, A4 on a rollup that is refreshed after an append to the warehouse
    def _rolled(s, sf):
        shared = ensure_checkpoint_dir(s)
        warehouse, path = (f"{shared}/{n}-{uuid.uuid4().hex}" for n in ("rollup-orders", "rollup"))
        sales, cut = _sales(s, sf), F.col("order_id").cast("bigint") % 7 != 0
        IO.load_warehouse(sales.where(cut), warehouse)
        RU.write_rollup(s.read.parquet(warehouse), path)
        late = [(y, m) for y in (1997, 1998) for m in (2, 5, 11)]
        kept = sales.where(cut | RU.in_months(late))  # late orders of six months arrive
        IO.load_warehouse(kept, warehouse, months=late)
        RU.refresh_rollup(s, warehouse, path, late)
        return s.read.parquet(path)

    arrived = "(CAST(order_id AS BIGINT) % 7 <> 0 OR (order_year IN (1997, 1998) AND order_month IN (2, 5, 11)))"

    def on_rollup(sql):
        return sql.replace("FROM sales WHERE", f"FROM sales WHERE {arrived} AND")

    q["rollup_series"] = lambda s, sf: M.metric_series(_rolled(s, sf), _req("profit_margin_pct"))
    o["rollup_series"] = on_rollup(_series_sql("profit_margin_pct", "month"))
    q["rollup_comparison"] = lambda s, sf: M.metric_comparison(_rolled(s, sf), _req("revenue_total_usd", region=REGIONS))
    o["rollup_comparison"] = on_rollup(_comparison_sql("revenue_total_usd", REGIONS))
    q["rollup_growth"] = lambda s, sf: M.metric_value(_rolled(s, sf), _req("revenue_growth_pct"))
    o["rollup_growth"] = f"SELECT value FROM ({on_rollup(_comparison_sql('revenue_growth_pct'))})"

    # A1-A4 scalar metrics
    q["revenue_total"] = lambda s, sf: M.metric_value(_sales(s, sf), REQ)
    o["revenue_total"] = _value_sql("revenue_total_usd")
    q["profit_total"] = lambda s, sf: M.metric_value(_sales(s, sf), _req("profit_total_usd"))
    o["profit_total"] = _value_sql("profit_total_usd")
    q["profit_margin"] = lambda s, sf: M.metric_value(_sales(s, sf), _req("profit_margin_pct"))
    o["profit_margin"] = _value_sql("profit_margin_pct")
    q["revenue_growth"] = lambda s, sf: M.metric_value(_sales(s, sf), _req("revenue_growth_pct"))
    o["revenue_growth"] = f"SELECT value FROM ({_comparison_sql('revenue_growth_pct')})"

    # A5 comparisons (F5 previous period inside)
    q["metric_comparison"] = lambda s, sf: M.metric_comparison(_sales(s, sf), REQ)
    o["metric_comparison"] = _comparison_sql("revenue_total_usd")
    q["margin_comparison"] = lambda s, sf: M.metric_comparison(_sales(s, sf), _req("profit_margin_pct", region=REGIONS))
    o["margin_comparison"] = _comparison_sql("profit_margin_pct", REGIONS)
    q["growth_comparison"] = lambda s, sf: M.metric_comparison(_sales(s, sf), _req("revenue_growth_pct"))
    o["growth_comparison"] = _comparison_sql("revenue_growth_pct")

    # A7 breakdowns
    q["metric_breakdown"] = lambda s, sf: M.metric_breakdown(_sales(s, sf), REQ, "region")
    o["metric_breakdown"] = _breakdown_sql("revenue_total_usd", "region")
    q["margin_by_country"] = lambda s, sf: M.metric_breakdown(_sales(s, sf), _req("profit_margin_pct"), "country")
    o["margin_by_country"] = _breakdown_sql("profit_margin_pct", "country")
    q["profit_by_category"] = lambda s, sf: M.metric_breakdown(_sales(s, sf), _req("profit_total_usd"), "category")
    o["profit_by_category"] = _breakdown_sql("profit_total_usd", "category")

    # A7, A8, A13 by product, on the line grain
    def by_line(sql):
        return Q.with_sales_lines() + sql[len(Q.with_sales()):]

    q["sales_lines"] = lambda s, sf: T.sales_lines(s, sf).drop("customer_name")
    o["sales_lines"] = Q.with_sales_lines() + "SELECT * FROM sales"
    q["revenue_by_product"] = lambda s, sf: M.metric_breakdown(T.sales_lines(s, sf), REQ, "product")
    o["revenue_by_product"] = by_line(_breakdown_sql("revenue_total_usd", "product"))
    q["margin_by_product"] = lambda s, sf: M.metric_breakdown(T.sales_lines(s, sf), _req("profit_margin_pct"), "product")
    o["margin_by_product"] = by_line(_breakdown_sql("profit_margin_pct", "product"))
    q["growth_by_product"] = lambda s, sf: M.growth_breakdown(T.sales_lines(s, sf), _req("revenue_growth_pct", region=REGIONS), "product")
    o["growth_by_product"] = Q.with_sales_lines() + (
        f"SELECT key, {Q.growth('cur_value', 'prev_value')} AS value FROM ({_period_totals_sql('product', REGIONS)})"
    )
    q["metric_query_product"] = lambda s, sf: M.metric_query_rows(T.sales_lines(s, sf), _req("revenue_total_usd", group_by="product"))
    pcmp, pseries, pbreak = (x[len(Q.with_sales()):] for x in (
        _comparison_sql("revenue_total_usd"), _series_sql("revenue_total_usd", "month"), _breakdown_sql("revenue_total_usd", "product")))
    o["metric_query_product"] = Q.with_sales_lines() + " UNION ALL ".join(
        [f"SELECT '{c}' AS part, CAST(NULL AS VARCHAR) AS key, {c} AS value FROM ({pcmp})" for c in ("value", "comparison_value", "delta", "delta_pct")]
        + [f"SELECT 'series', period_start, value FROM ({pseries})", f"SELECT 'breakdown', key, value FROM ({pbreak})"]
    )

    # A8 growth breakdown; J2 the outer-joined period totals behind it
    q["growth_breakdown"] = lambda s, sf: M.growth_breakdown(_sales(s, sf), _req("revenue_growth_pct"), "region")
    o["growth_breakdown"] = Q.with_sales() + (
        f"SELECT key, {Q.growth('cur_value', 'prev_value')} AS value FROM ({_period_totals_sql('region')})"
    )
    q["period_outer_join"] = lambda s, sf: J.period_outer_join(*M.period_values(_sales(s, sf), _req("revenue_growth_pct"), "country"))
    o["period_outer_join"] = Q.with_sales() + _period_totals_sql("country")
    q["period_totals"] = lambda s, sf: M.period_totals(_sales(s, sf), _req("revenue_growth_pct"), "category")
    o["period_totals"] = Q.with_sales() + _period_totals_sql("category")

    # A9 box statistics of the margin series; T4 the capped outlier list
    q["margin_box"] = lambda s, sf: M.margin_box(_sales(s, sf), _req("profit_margin_pct", time_grain="week"))
    o["margin_box"] = _box_sql("week")
    q["cap_outliers"] = lambda s, sf: (
        M.margin_box(_sales(s, sf), _req("profit_margin_pct", time_grain="day"))
        .select(F.posexplode("outliers").alias("pos", "outlier"))
    )
    o["cap_outliers"] = (
        f"SELECT CAST(pos AS INTEGER) AS pos, outlier FROM (SELECT generate_subscripts(outliers, 1) - 1 AS pos, "
        f"unnest(outliers) AS outlier FROM ({_box_sql('day')}))"
    )

    q["cap_outliers_at_20"] = lambda s, sf: (
        M.box_stats(M.metric_series(_sales(s, sf), _req("profit_margin_pct", time_grain="day")), max_outliers=20)
        .select(F.posexplode("outliers").alias("pos", "outlier"))
    )
    o["cap_outliers_at_20"] = f"SELECT * FROM ({o['cap_outliers']}) WHERE pos < 20"

    # A10-A12 metadata, dimensions, customers; U2 distinct pairs
    q["dataset_meta"] = lambda s, sf: M.dataset_meta(_sales(s, sf))
    o["dataset_meta"] = Q.with_sales() + "SELECT count(*) AS rows, min(order_date) AS date_min, max(order_date) AS date_max FROM sales"
    q["dimension_values"] = lambda s, sf: M.dimension_values(_sales(s, sf))
    o["dimension_values"] = Q.with_sales() + " UNION ALL ".join(
        f"SELECT DISTINCT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value FROM sales WHERE {d} IS NOT NULL"
        for d in ("region", "region_group", "order_status")
    )
    q["customer_dimension"] = lambda s, sf: M.customer_dimension(_sales(s, sf))
    o["customer_dimension"] = Q.with_sales() + "SELECT DISTINCT customer_id, customer_name FROM sales"
    q["distinct_dims"] = lambda s, sf: _sales(s, sf).select("region", "region_group").distinct()
    o["distinct_dims"] = Q.with_sales() + "SELECT DISTINCT region, region_group FROM sales"

    # F4 customer search (limit is the feature: a search box answer)
    def _search_indexed(s, sf):
        path = os.path.join(ensure_checkpoint_dir(s), f"customer-index-{uuid.uuid4().hex}")
        X.write_search_index(_sales(s, sf), path)
        return X.search_indexed(s, path, "R#0000001")

    q["customer_search_indexed"] = _search_indexed
    o["customer_search_indexed"] = Q.with_sales() + (
        "SELECT DISTINCT customer_id, customer_name FROM sales WHERE contains(lower(customer_name), 'r#0000001') "
        f"ORDER BY customer_name, customer_id LIMIT {R.SEARCH_LIMIT}"
    )
    q["customer_search"] = lambda s, sf: M.customer_search(_sales(s, sf), "#00000012")
    o["customer_search"] = Q.with_sales() + (
        "SELECT DISTINCT customer_id, customer_name FROM sales WHERE customer_name ILIKE '%#00000012%' "
        f"ORDER BY customer_name, customer_id LIMIT {R.SEARCH_LIMIT}"
    )

    # F1 / F2 / F3 / F6 / J6 filters
    q["filter_date_range"] = lambda s, sf: M.filter_date_range(_sales(s, sf), START, END)
    o["filter_date_range"] = Q.with_sales() + f"SELECT {SALES_COLS} FROM sales WHERE order_date BETWEEN DATE '{START}' AND DATE '{END}'"
    q["filter_dimensions"] = lambda s, sf: M.filter_dimensions(_sales(s, sf), region=REGIONS, order_status=("completed", "canceled"))
    o["filter_dimensions"] = Q.with_sales() + (
        f"SELECT {SALES_COLS} FROM sales WHERE {Q.in_list('region', REGIONS)} AND order_status IN ('COMPLETED', 'CANCELED')"
    )
    q["locked_completed"] = lambda s, sf: M.locked_completed(M.filter_dimensions(_sales(s, sf), order_status=STATUSES))
    o["locked_completed"] = Q.with_sales() + f"SELECT {SALES_COLS} FROM sales WHERE order_status = 'COMPLETED'"
    q["in_list_semi"] = lambda s, sf: J.in_list_semi(_sales(s, sf), "country", ["NATION_1", "NATION_7", "NATION_19"]).select("order_id", "country")
    o["in_list_semi"] = Q.with_sales() + "SELECT order_id, country FROM sales WHERE country IN ('NATION_1', 'NATION_7', 'NATION_19')"
    # a list too long to inline: a semi join
    wanted = [str(i) for i in range(1, 9000, 4)]
    q["in_list_semi_join"] = lambda s, sf: J.in_list_semi(_sales(s, sf), "customer_id", wanted).select("order_id", "customer_id")
    o["in_list_semi_join"] = Q.with_sales() + "SELECT order_id, customer_id FROM sales WHERE CAST(customer_id AS INT) < 9000 AND CAST(customer_id AS INT) % 4 = 1"
    q["default_date_range"] = lambda s, sf: M.default_date_range(_sales(s, sf))
    o["default_date_range"] = Q.with_sales() + "SELECT min(order_date) AS start, max(order_date) AS \"end\" FROM sales"
    q["previous_period"] = lambda s, sf: (
        M.default_date_range(_sales(s, sf))
        .select("start", "end", *[c.alias(n) for c, n in zip(M.previous_period_columns(F.col("start"), F.col("end")), ("prev_start", "prev_end"))])
    )
    o["previous_period"] = Q.with_sales() + (
        "SELECT start, \"end\", CAST(start - 1 - CAST(\"end\" - start AS INTEGER) AS DATE) AS prev_start, CAST(start - 1 AS DATE) AS prev_end "
        "FROM (SELECT min(order_date) AS start, max(order_date) AS \"end\" FROM sales)"
    )

    # T1-T3 listings
    q["orders_listing"] = lambda s, sf: M.orders_listing(_sales(s, sf), START, END, region=REGIONS[1:])
    o["orders_listing"] = Q.with_sales() + (
        f"SELECT {SALES_COLS} FROM sales WHERE order_date BETWEEN DATE '{START}' AND DATE '{END}' AND region = '{REGIONS[1]}'"
    )
    q["orders_page"] = lambda s, sf: M.orders_page(M.orders_listing(_sales(s, sf), START, END, region=REGIONS[1:]), page=3)
    o["orders_page"] = Q.with_sales() + (
        f"SELECT {SALES_COLS} FROM sales WHERE order_date BETWEEN DATE '{START}' AND DATE '{END}' AND region = '{REGIONS[1]}' "
        f"ORDER BY order_date, order_id LIMIT {R.PAGE_SIZE} OFFSET {2 * R.PAGE_SIZE}"
    )
    def _page_jump(s, sf):
        rows = M.filter_dimensions(M.filter_date_range(_sales(s, sf), START, END))
        return P.page_at(rows, P.page_directory(rows), 25, R.PAGE_SIZE)

    q["orders_page_jump"] = _page_jump
    o["orders_page_jump"] = Q.with_sales() + (
        f"SELECT {SALES_COLS} FROM sales WHERE order_date BETWEEN DATE '{START}' AND DATE '{END}' "
        f"ORDER BY order_date, order_id LIMIT {R.PAGE_SIZE} OFFSET {24 * R.PAGE_SIZE}"
    )
    q["page_directory"] = lambda s, sf: P.page_directory(_sales(s, sf))
    o["page_directory"] = Q.with_sales() + (
        "SELECT order_date, count(*) AS rows, CAST(COALESCE(sum(count(*)) OVER (ORDER BY order_date NULLS FIRST "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM sales GROUP BY order_date"
    )
    q["orders_page_after"] = lambda s, sf: M.orders_page_after(M.orders_listing(_sales(s, sf), START, END), START, "5")
    o["orders_page_after"] = Q.with_sales() + (
        f"SELECT {SALES_COLS} FROM sales WHERE order_date BETWEEN DATE '{START}' AND DATE '{END}' "
        f"AND (order_date > DATE '{START}' OR order_id > '5') ORDER BY order_date, order_id LIMIT {R.PAGE_SIZE}"
    )
    q["orders_row_count"] = lambda s, sf: M.row_count(M.orders_listing(_sales(s, sf), START, END))
    o["orders_row_count"] = Q.with_sales() + f"SELECT count(*) AS row_count FROM sales WHERE order_date BETWEEN DATE '{START}' AND DATE '{END}'"
    q["top_transactions"] = lambda s, sf: M.top_transactions(M.filter_date_range(_sales(s, sf), START, END), "profit_total_usd")
    o["top_transactions"] = Q.with_sales() + (
        f"SELECT {SALES_COLS} FROM sales WHERE order_date BETWEEN DATE '{START}' AND DATE '{END}' "
        f"ORDER BY COALESCE(profit_usd, 0.0) DESC, order_date, order_id LIMIT {R.TOP_K}"
    )

    # A13 the whole response, flattened
    q["metric_query"] = lambda s, sf: M.metric_query_rows(_sales(s, sf), _req("profit_margin_pct", group_by="region_group"))
    series = f"SELECT {Q.bucket('order_date', 'month')} AS period_start, {Q.metric_agg('profit_margin_pct')} AS value FROM sales WHERE {W_CUR} GROUP BY 1"
    cmp_ = _comparison_sql("profit_margin_pct")[len(Q.with_sales()):]
    box = _box_sql("month")[len(Q.with_sales()):]
    o["metric_query"] = Q.with_sales() + (
        f"SELECT 'value' AS part, CAST(NULL AS VARCHAR) AS key, value FROM ({cmp_}) UNION ALL "
        f"SELECT 'comparison_value', NULL, comparison_value FROM ({cmp_}) UNION ALL "
        f"SELECT 'delta', NULL, delta FROM ({cmp_}) UNION ALL "
        f"SELECT 'delta_pct', NULL, delta_pct FROM ({cmp_}) UNION ALL "
        f"SELECT 'series', period_start, value FROM ({series}) UNION ALL "
        f"SELECT 'breakdown', region_group, {Q.metric_agg('profit_margin_pct')} FROM sales WHERE {W_CUR} GROUP BY region_group UNION ALL "
        + " UNION ALL ".join(f"SELECT 'distribution', '{st}', {st} FROM ({box})" for st in ("q1", "median", "q3", "iqr", "whisker_low", "whisker_high"))
    )

    q["metric_query_growth"] = lambda s, sf: M.metric_query_rows(_sales(s, sf), _req("revenue_growth_pct", group_by="country", time_grain="week"))
    gcmp, gseries = (x[len(Q.with_sales()):] for x in (_comparison_sql("revenue_growth_pct"), _series_sql("revenue_growth_pct", "week")))
    o["metric_query_growth"] = Q.with_sales() + " UNION ALL ".join(
        [f"SELECT '{c}' AS part, CAST(NULL AS VARCHAR) AS key, {c} AS value FROM ({gcmp})" for c in ("value", "comparison_value", "delta", "delta_pct")]
        + [f"SELECT 'series', period_start, value FROM ({gseries})",
           f"SELECT 'breakdown', key, {Q.growth('cur_value', 'prev_value')} FROM ({_period_totals_sql('country')})"]
    )

    # P17 / P18 time buckets and period starts; P24 growth labels
    q["time_bucket"] = lambda s, sf: _sales(s, sf).select(
        "order_id", *[S.time_bucket("order_date", g).alias(g) for g in R.TIME_GRAINS]
    )
    o["time_bucket"] = Q.with_sales() + "SELECT order_id, " + ", ".join(f"{Q.bucket('order_date', g)} AS {g}" for g in R.TIME_GRAINS) + " FROM sales"
    q["week_month_start"] = lambda s, sf: _sales(s, sf).select(
        "order_id", S.week_start("order_date").alias("week_start"), S.month_start("order_date").alias("month_start")
    )
    o["week_month_start"] = Q.with_sales() + (
        "SELECT order_id, CAST(date_trunc('week', order_date) AS DATE) AS week_start, "
        "CAST(date_trunc('month', order_date) AS DATE) AS month_start FROM sales"
    )
    q["week_start"] = lambda s, sf: _sales(s, sf).select("order_id", S.week_start("order_date").alias("week_start"))
    o["week_start"] = Q.with_sales() + "SELECT order_id, CAST(date_trunc('week', order_date) AS DATE) AS week_start FROM sales"
    q["month_start"] = lambda s, sf: _sales(s, sf).select("order_id", S.month_start("order_date").alias("month_start"))
    o["month_start"] = Q.with_sales() + "SELECT order_id, CAST(date_trunc('month', order_date) AS DATE) AS month_start FROM sales"
    q["growth_label"] = lambda s, sf: M.growth_breakdown(_sales(s, sf), _req("revenue_growth_pct"), "country").select(
        "key", S.growth_label("value").alias("label")
    )
    o["growth_label"] = Q.with_sales() + (
        "SELECT key, CASE WHEN g IS NULL THEN 'NO_COMPARISON' WHEN g > 0 THEN 'GROWTH' WHEN g < 0 THEN 'DECLINE' ELSE 'FLAT' END AS label "
        f"FROM (SELECT key, {Q.growth('cur_value', 'prev_value')} AS g FROM ({_period_totals_sql('country')}))"
    )

    # P7 + J1: the size-checked nation lookup and the region display names
    q["lookup_join"] = lambda s, sf: J.lookup_join(
        T.read_table(s, sf, "customer").select("c_custkey", "c_nationkey"),
        T.nation_dimension(s, sf), F.col("c_nationkey") == F.col("n_nationkey"),
    ).select("c_custkey", "country", "region", "region_group")
    o["lookup_join"] = "WITH " + Q.NATION_DIM + (
        " SELECT c.c_custkey, nd.country, nd.region, nd.region_group FROM customer c LEFT JOIN nation_dim nd ON c.c_nationkey = nd.n_nationkey"
    )

    # P21 safe division, P22 non-finite sanitising, P20 parse helpers on table text
    q["safe_div"] = lambda s, sf: _sales(s, sf).select("order_id", S.safe_div("cost_usd", "revenue_usd").alias("cost_ratio"))
    o["safe_div"] = Q.with_sales() + "SELECT order_id, cost_usd / NULLIF(revenue_usd, 0) AS cost_ratio FROM sales"
    q["non_finite_to_null"] = lambda s, sf: T.read_table(s, sf, "customer").select(
        "c_custkey", S.non_finite_to_null("c_acctbal").alias("c_acctbal")
    )
    o["non_finite_to_null"] = "SELECT c_custkey, CASE WHEN isnan(c_acctbal) OR isinf(c_acctbal) THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer"
    q["parse_bool"] = lambda s, sf: _sales(s, sf).select("order_id", S.parse_bool((F.col("order_status") == "COMPLETED").cast("string")).alias("is_completed"))
    o["parse_bool"] = Q.with_sales() + "SELECT order_id, COALESCE(order_status = 'COMPLETED', FALSE) AS is_completed FROM sales"
    # the same on whole texts: truthy, falsy, padded, null and the untouched priority
    q["parse_bool_text"] = lambda s, sf: T.read_table(s, sf, "orders").select(
        "o_orderkey",
        S.parse_bool(
            F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(" "), F.upper((F.col("o_custkey") % 2 == 0).cast("string")), F.lit("\t")))
            .when(F.col("o_orderkey") % 4 == 1, F.element_at(F.array(*map(F.lit, BOOL_TEXTS)), (F.col("o_custkey") % len(BOOL_TEXTS) + 1).cast("int")))
            .when(F.col("o_orderkey") % 4 == 2, F.col("o_orderpriority"))
        ).alias("is_true"),
    )
    o["parse_bool_text"] = (
        "SELECT o_orderkey, COALESCE(lower(trim(CASE o_orderkey % 4 WHEN 0 THEN ' ' || upper((o_custkey % 2 = 0)::VARCHAR) || chr(9)"
        f" WHEN 1 THEN ([{', '.join(repr(t) for t in BOOL_TEXTS)}])[o_custkey % {len(BOOL_TEXTS)} + 1]"
        " WHEN 2 THEN o_orderpriority END, ' ' || chr(9))) IN ('true', '1', 'yes', 'y', 't'), FALSE) AS is_true FROM orders"
    )
    return q, o
