"""Driver-provided TPC-H-style tables and the two domain views built on them.

* ``sales``     — one row per order, the warehouse ``orders`` table shape the
  metric layer works on.
* ``raw_sales`` — one row per line item, rendered as dirty text the way a
  hand-kept sales CSV looks, as input to the data-quality pipeline.

Both are lazy DataFrames; Catalyst prunes every unused column down to the
Parquet scan.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import reference_data as R
from ..functions import scalars as S
from .partitioning import spread_scan

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


#: The columns that the views read: a given schema costs no job for reading footers.
SCHEMAS: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_type string, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_shipdate timestamp_ntz",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fresh handle each time, so that files added to the folder are seen; of the
    tables in SCHEMAS the columns listed there."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Fixture-only recode of the TPC-H region names onto the domain's region codes.
FIXTURE_REGION_CODES: dict[str, str] = {
    "AMERICA": "NORTH AMERICA",
    "ASIA": "APAC",
    "EUROPE": "EMEA",
    "MIDDLE EAST": "EMEA",
}
# Fixture-only mapping of the TPC-H order status onto the domain statuses.
FIXTURE_STATUS: dict[str, str] = {"F": "COMPLETED", "O": "PENDING", "P": "CANCELED"}


def nation_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation x region with display region and region group (25 rows in TPC-H)."""
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    code = S.replace_values(F.col("r_name"), FIXTURE_REGION_CODES)
    canon = S.canonical_region(code)
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey",
        F.col("n_name").alias("country"),
        canon.alias("region"),
        S.region_group(canon).alias("region_group"),
    )


def order_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order cost = sum(quantity * unit list price), exact in DECIMAL."""
    li = spread_scan(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), "l_orderkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    line_cost = F.col("l_quantity").cast("decimal(18,2)") * F.col("p_retailprice").cast("decimal(18,2)")
    return (
        li.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_orderkey")
        .agg(F.sum(line_cost).cast("double").alias("cost_usd"))
    )


def profit_columns(revenue: Column, cost: Column, status: Column) -> tuple[Column, Column]:
    """Completed orders only: profit = revenue - cost, margin = profit/revenue*100."""
    completed = status == F.lit(R.STATUS_COMPLETED)
    profit = F.when(completed, revenue - cost)
    margin = F.when(completed, F.try_divide(revenue - cost, revenue) * F.lit(100.0))
    return profit, margin


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-grain ``orders`` table (the metric layer's input)."""
    # Both sides spread on the order key (only when their scans are too few
    # splits): the cost aggregate and the orders-costs join then reuse that
    # hash partitioning instead of adding exchanges.
    orders = spread_scan(read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    ), "o_orderkey")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nations = nation_dimension(spark, sf_dir)
    costs = order_costs(spark, sf_dir)
    status = S.lookup(F.col("o_orderstatus"), FIXTURE_STATUS)
    revenue = F.col("o_totalprice")
    profit, margin = profit_columns(revenue, F.col("cost_usd"), status)
    order_date = F.col("o_orderdate").cast("date")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(costs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").cast("string").alias("order_id"),
            order_date.alias("order_date"),
            F.year(order_date).alias("order_year"),
            F.month(order_date).alias("order_month"),
            status.alias("order_status"),
            F.col("c_custkey").cast("string").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            "region",
            "region_group",
            "country",
            F.col("c_mktsegment").alias("category"),
            F.col("o_orderpriority").alias("payment_method"),
            revenue.alias("revenue_usd"),
            F.col("cost_usd"),
            profit.alias("profit_usd"),
            margin.alias("margin_pct"),
        )
    )


def sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-grain sales: the dimensions of ``sales`` and the ``product`` of each line.

    An order holds many products, so breakdowns by product need this grain. Revenue is
    the discounted price and cost the quantity at list price, multiplied in DECIMAL. The
    metric functions work on it unchanged. Only the part join and one shuffle on the
    order key stand between the scans and the aggregate.
    """
    li = spread_scan(
        read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"), "l_orderkey"
    )
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    orders = spread_scan(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"), "o_orderkey")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    status = S.lookup(F.col("o_orderstatus"), FIXTURE_STATUS)
    exact = lambda c, t: F.col(c).cast(t)
    revenue = (exact("l_extendedprice", "decimal(18,2)") * (1 - exact("l_discount", "decimal(4,2)"))).cast("double")
    cost = (exact("l_quantity", "decimal(18,2)") * exact("p_retailprice", "decimal(18,2)")).cast("double")
    profit, margin = profit_columns(F.col("revenue_usd"), F.col("cost_usd"), F.col("order_status"))
    return (
        li.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation_dimension(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_linenumber").alias("line_number"),
            F.col("o_orderdate").cast("date").alias("order_date"), status.alias("order_status"),
            F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("customer_name"),
            "region", "region_group", "country", F.col("c_mktsegment").alias("category"), F.col("p_name").alias("product"),
            revenue.alias("revenue_usd"), cost.alias("cost_usd"),
        )
        .select("*", profit.alias("profit_usd"), margin.alias("margin_pct"))
    )


# ----------------------------------------------------------- raw_sales ---

# Header names of the dirty CSV (camelCase on purpose: the cleaner renames).
RAW_HEADERS = (
    "OrderID", "OrderDate", "Amount", "DiscountRate", "Currency", "Region", "Country",
    "OrderStatus", "Customer", "Product", "Category", "PaymentMethod",
)

# Fixture text pools, picked per row by key arithmetic.
RAW_REGIONS = (
    "North America", "n america", "N. AMERICA", "NorthAmerica", "APAC", "asia  pacific",
    "EMEA", " emea", "Africa", "LATAM", None,
)
RAW_COUNTRIES = (
    "nigeria", "KENYA", "united states", "COTE D'IVOIRE", "saudi-arabia", "japan",
    "united kingdom", "germany",
)
RAW_STATUSES = (
    "COMPLETED", "COMPLETED", "COMPLETED", "COMPLETED", "Completed", "complete", "DONE",
    " completed ", "PENDING", "pending", "CANCELLED", "Canceled",
)
RAW_CURRENCIES = (
    "USD", "USD", "USD", "USD", "USD", "USD", "USD", "USD", "USD", "USD", "usd ",
    "EUR", "EUR", " eur", "GBP", "NGN", "KES", "JPY", "XYZ", None, "NULL", "GBP", "GBP",
)
RAW_PAYMENTS = ("Card", "Bank Transfer", "Cash", "Mobile Money")


def _pick(pool, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in pool]), (idx % F.lit(len(pool))).cast("int") + 1)


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-grain dirty sales text (all columns strings) plus ``_source_pos``.

    ``OrderID`` is ``ORD-<orderkey>-<linenumber>``; that pair repeats in the
    line items, which gives the de-duplication step real duplicates.
    ``_source_pos`` is a unique, deterministic position key standing in for
    the row number of a CSV file.
    """
    li = spread_scan(read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_shipdate",
    ), "l_orderkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    # Shared values become columns first so the text builders below read
    # them instead of re-deriving them in every branch.
    base = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "*",
        (F.col("l_extendedprice").cast("decimal(18,2)") * F.lit(0.25)).cast("decimal(18,2)").alias("_x"),
        F.col("l_shipdate").cast("date").alias("_d"),
    )
    base = base.select("*", F.col("_x").cast("string").alias("_t"), F.floor("_x").cast("bigint").alias("_ip"))
    k, n, p, s = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint"), F.col("l_partkey"), F.col("l_suppkey")

    x, t, ip = F.col("_x"), F.col("_t"), F.col("_ip")
    cents = F.lpad(((x - ip) * 100).cast("int").cast("string"), 2, "0")
    grouped = F.when(
        ip >= 1000,
        F.concat((ip / 1000).cast("bigint").cast("string"), F.lit(","), F.lpad((ip % 1000).cast("string"), 3, "0")),
    ).otherwise(ip.cast("string"))
    va = (k + 3 * n) % 20
    amount = (
        F.when(va == 8, F.concat(F.lit("$"), grouped, F.lit("."), cents))
        .when(va == 9, F.concat(F.lit("("), t, F.lit(")")))
        .when(va == 10, F.replace(t, F.lit("."), F.lit(",")))
        .when(va == 11, F.concat(F.lit("USD "), t))
        .when(va == 12, F.concat(F.lit(" "), t, F.lit(" ")))
        .when(va == 13, F.lit("N/A"))
        .when(va == 14, F.lit(""))
        .when(va == 15, F.lit("abc"))
        .when(va == 16, F.concat(t, F.lit("-")))
        .when(va == 17, F.lit("0.00"))
        .when(va == 18, (x * 10).cast("decimal(18,2)").cast("string"))
        .otherwise(t)
    )

    vd = (k + n) % 3
    discount = (
        F.when(vd == 0, F.col("l_discount").cast("decimal(4,2)").cast("string"))
        .when(vd == 1, F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")))
    )

    d = F.col("_d")
    vt = (k + 5 * n) % 16
    order_date = (
        F.when(vt == 4, F.date_format(d, "yyyyMMdd'T'101500"))
        .when(vt == 5, F.date_format(d, "MM/dd/yyyy"))
        .when(vt == 6, F.date_format(d, "dd/MM/yyyy"))
        .when(vt == 7, F.date_format(d, "MMM d, yyyy"))
        .when(vt == 8, F.date_format(d, "yyyyMMdd"))
        .when(vt == 9, F.date_format(d, "yyyy-MM-dd 00:00:00"))
        .when(vt == 10, F.lit("not a date"))
        .when(vt == 11, F.lit(None).cast("string"))
        .when(vt == 12, F.concat(F.date_format(d, "yyyy"), F.lit("-13-"), F.date_format(d, "dd")))
        .when(vt == 13, F.date_format(d, "M.d.yyyy"))
        .when(vt == 14, F.date_format(d, "dd-MMM-yy"))
        .when(vt == 15, F.date_format(d, "yyyy-MM-dd '03:15 PM'"))
        .otherwise(F.date_format(d, "yyyy-MM-dd"))
    )

    order_id = (
        F.when((k * 7 + n) % 53 == 0, F.lit(None).cast("string"))
        .when((k + n) % 41 == 0, F.lit("N/A"))
        .otherwise(F.concat(F.lit("ORD-"), k.cast("string"), F.lit("-"), n.cast("string")))
    )
    products = list(R.PRODUCT_COSTS)
    product = F.coalesce(
        F.try_element_at(F.array(*[F.lit(v) for v in products]), ((p % 13) + 1).cast("int")),
        F.concat(F.lit("Generic "), F.col("p_name")),
    )
    customer = F.when((k + s) % 29 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("CUST-"), s.cast("string")))
    source_pos = F.concat_ws(
        "-", k.cast("string"), n.cast("string"), p.cast("string"), s.cast("string"),
        F.col("l_quantity").cast("bigint").cast("string"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
        F.date_format(d, "yyyyMMdd"),
    )
    cols = [
        order_id, order_date, amount, discount,
        _pick(RAW_CURRENCIES, k * 3 + s),
        _pick(RAW_REGIONS, s + n),
        _pick(RAW_COUNTRIES, s),
        _pick(RAW_STATUSES, k + n * 7 + s),
        customer, product, F.col("p_type"),
        _pick(RAW_PAYMENTS, n),
    ]
    return base.select(source_pos.alias("_source_pos"), *[c.alias(h) for c, h in zip(cols, RAW_HEADERS)])
