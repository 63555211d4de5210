"""A mergeable rollup of the orders: one row per day and dimension values.

Its measures are DECIMAL partial sums, rounded per order exactly as the metrics round
them, so sums of them equal sums over the orders. It keeps the names of the
order table's columns: every metric without a customer filter runs on it as it
is, over days x dimension values instead of orders. It is stored by month; after
an append only the changed months are read and replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import drop_tables

DIMENSIONS = ("order_date", "order_status", "region", "region_group", "country", "category", "payment_method", "product")
MEASURES = ("revenue_usd", "cost_usd", "profit_usd")
MONTH = ("order_year", "order_month")


def rollup(orders: DataFrame) -> DataFrame:
    """Partial sums per month, day and dimension values: one map-side combined aggregate."""
    keys = [c for c in DIMENSIONS if c in orders.columns]
    return orders.groupBy(*MONTH, *keys).agg(*[F.sum(S.money(F.col(c))).alias(c) for c in MEASURES], F.count(F.lit(1)).alias("orders"))


def in_months(months: list[tuple[int, int]]) -> Column:
    """Whether a row is of one of the (year, month) pairs: a filter on the folders."""
    by_year: dict[int, list[int]] = {}
    for y, m in months:
        by_year.setdefault(y, []).append(m)
    return reduce(lambda a, b: a | b, [(F.col("order_year") == y) & F.col("order_month").isin(ms) for y, ms in by_year.items()], F.lit(False))


def of_months(df: DataFrame, months: list[tuple[int, int]]) -> DataFrame:
    return df.where(in_months(months))


def months_of(df: DataFrame) -> list[tuple[int, int]]:
    """The months that hold rows: as many as the calendar has."""
    return sorted((r.order_year, r.order_month) for r in df.select(*MONTH).distinct().collect())


def write_rollup(orders: DataFrame, path: str) -> None:
    rollup(orders).write.mode("overwrite").partitionBy(*MONTH).parquet(path)


def refresh_rollup(spark: SparkSession, warehouse: str, path: str, months: list[tuple[int, int]]) -> None:
    """Rebuild the rollup's given months from the warehouse; all others keep their files."""
    orders = of_months(spark.read.parquet(warehouse), months)
    rollup(orders).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*MONTH).parquet(path)
    emptied = set(months) - set(months_of(orders))
    drop_tables(spark, [f"{path}/order_year={y}/order_month={m}" for y, m in sorted(emptied)])
