"""DuckDB SQL text for the correctness oracles.

Each builder returns SQL that computes, independently of Spark, what the
matching library function computes. Shared pieces are common table
expressions composed into one ``WITH`` list per oracle statement.
"""

from __future__ import annotations

from collections.abc import Mapping

from .. import reference_data as R
from ..sources import tables as T


def q(s) -> str:
    if s is None:
        return "NULL"
    if isinstance(s, (int, float)):
        return repr(s)
    return "'" + str(s).replace("'", "''") + "'"


def case_map(expr: str, mapping: Mapping, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {arms} ELSE {default} END)"


def title(expr: str) -> str:
    """Python-style title case: upper the first letter of each letter run."""
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({expr}), '\\P{{L}}*\\p{{L}}*'), "
        "lambda t: regexp_extract(t, '^\\P{L}*') || upper(substr(regexp_extract(t, '\\p{L}*$'), 1, 1)) "
        "|| substr(regexp_extract(t, '\\p{L}*$'), 2)), '')"
    )


def canonical_region(expr: str) -> str:
    s = f"trim({expr})"
    return (
        f"(CASE WHEN {s} IS NULL OR {s} = '' THEN {q(R.REGION_UNKNOWN)} "
        f"ELSE coalesce({case_map(f'upper({s})', R.REGION_CANONICAL)}, {title(s)}) END)"
    )


def region_group(expr: str) -> str:
    return case_map(expr, R.REGION_GROUPS, q(R.REGION_GROUP_OTHER))


def money(expr: str) -> str:
    return f"CAST({expr} AS DECIMAL(28,6))"


def msum(expr: str, cond: str | None = None) -> str:
    inner = money(expr) if cond is None else f"CASE WHEN {cond} THEN {money(expr)} END"
    return f"CAST(SUM({inner}) AS DOUBLE)"


def pick(pool, idx: str) -> str:
    items = ", ".join("CAST(NULL AS VARCHAR)" if v is None else q(v) for v in pool)
    return f"([{items}])[({idx}) % {len(pool)} + 1]"


# ------------------------------------------------------------------ sales ---

NATION_DIM = f"""nation_dim AS (
  SELECT n.n_nationkey, n.n_name AS country,
         {canonical_region(case_map('r.r_name', T.FIXTURE_REGION_CODES, 'r.r_name'))} AS region,
         {region_group(canonical_region(case_map('r.r_name', T.FIXTURE_REGION_CODES, 'r.r_name')))} AS region_group
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

ORDER_COSTS = """order_costs AS (
  SELECT l.l_orderkey,
         CAST(SUM(CAST(l.l_quantity AS DECIMAL(18,2)) * CAST(p.p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS cost_usd
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY l.l_orderkey
)"""

SALES = f"""sales AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS order_id,
         CAST(o.o_orderdate AS DATE) AS order_date,
         CAST(year(o.o_orderdate) AS INTEGER) AS order_year,
         CAST(month(o.o_orderdate) AS INTEGER) AS order_month,
         st.order_status,
         CAST(c.c_custkey AS VARCHAR) AS customer_id,
         c.c_name AS customer_name,
         nd.region, nd.region_group, nd.country,
         c.c_mktsegment AS category,
         o.o_orderpriority AS payment_method,
         o.o_totalprice AS revenue_usd,
         oc.cost_usd,
         CASE WHEN st.order_status = 'COMPLETED' THEN o.o_totalprice - oc.cost_usd END AS profit_usd,
         CASE WHEN st.order_status = 'COMPLETED' THEN (o.o_totalprice - oc.cost_usd) / NULLIF(o.o_totalprice, 0) * 100.0 END AS margin_pct
  FROM orders o
  CROSS JOIN LATERAL (SELECT {case_map('o.o_orderstatus', T.FIXTURE_STATUS)} AS order_status) st
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation_dim nd ON c.c_nationkey = nd.n_nationkey
  LEFT JOIN order_costs oc ON o.o_orderkey = oc.l_orderkey
)"""


def with_sales(*ctes: str) -> str:
    return "WITH " + ",\n".join([NATION_DIM, ORDER_COSTS, SALES, *ctes]) + "\n"


#: Line-grain sales under the name of the order-grain table, so that metric SQL reads it unchanged.
SALES_LINES = f"""lines AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) AS order_id, l.l_linenumber AS line_number, CAST(o.o_orderdate AS DATE) AS order_date,
         {case_map('o.o_orderstatus', T.FIXTURE_STATUS)} AS order_status, CAST(c.c_custkey AS VARCHAR) AS customer_id,
         nd.region, nd.region_group, nd.country, c.c_mktsegment AS category, p.p_name AS product,
         CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DOUBLE) AS revenue_usd,
         CAST(CAST(l.l_quantity AS DECIMAL(18,2)) * CAST(p.p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS cost_usd
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation_dim nd ON c.c_nationkey = nd.n_nationkey
), sales AS (
  SELECT *, CASE WHEN order_status = 'COMPLETED' THEN revenue_usd - cost_usd END AS profit_usd,
         CASE WHEN order_status = 'COMPLETED' THEN (revenue_usd - cost_usd) / NULLIF(revenue_usd, 0) * 100.0 END AS margin_pct FROM lines
)"""


def with_sales_lines() -> str:
    return "WITH " + ",\n".join([NATION_DIM, SALES_LINES]) + "\n"


def bucket(expr: str, grain: str) -> str:
    fmt = {"day": "%Y-%m-%d", "week": "%Y-%W", "month": "%Y-%m-01"}[grain]
    return f"strftime({expr}, '{fmt}')"


def in_list(col: str, values) -> str:
    return f"{col} IN ({', '.join(q(v) for v in values)})" if values else "TRUE"


def metric_where(start, end, region=(), customer_id=()) -> str:
    return (
        f"order_date >= DATE {q(str(start))} AND order_date <= DATE {q(str(end))} "
        f"AND {in_list('region', region)} AND {in_list('customer_id', customer_id)} "
        "AND order_status = 'COMPLETED'"
    )


def metric_agg(metric_id: str, cond: str | None = None) -> str:
    if metric_id == "profit_margin_pct":
        return f"({msum('profit_usd', cond)} * 100.0 / NULLIF({msum('revenue_usd', cond)}, 0))"
    if metric_id.startswith("revenue"):
        return msum("revenue_usd", cond)
    return msum("profit_usd", cond)


def growth(cur: str, prev: str) -> str:
    return f"(CASE WHEN {prev} <> 0 THEN ({cur} - {prev}) / {prev} * 100.0 END)"
