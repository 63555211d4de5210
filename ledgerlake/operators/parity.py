"""Two copies of a table compared by bucket digests, and pages found by a directory.

Both keep what they need of a large table in a few rows, so that only the rows
in question are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import parity_diff


def bucket_digests(df: DataFrame, key: list[str], buckets: int = 4096) -> DataFrame:
    """One row per bucket of the key's hash: number of rows and an order-free digest of them.

    The digest is a pair of sums over independent 64-bit hashes of the rows, so a
    repeated row counts as often as it occurs. Nulls are hashed with their places.
    The aggregate is combined in every task; at most ``buckets`` rows are shuffled by each.
    """
    places = [c for name in df.columns for c in (F.col(name), F.col(name).isNull())]
    total = lambda seed, name: F.sum(F.xxhash64(F.lit(seed), *places).cast("decimal(20,0)")).alias(name)
    return df.groupBy(_bucket(key, buckets).alias("bucket")).agg(F.count("*").alias("n"), total(1, "d1"), total(2, "d2"))


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def unequal_buckets(a: DataFrame, b: DataFrame, key: list[str], buckets: int = 4096) -> DataFrame:
    """The buckets whose rows differ, with both counts (0: no rows on that side)."""
    left = bucket_digests(a, key, buckets)
    right = bucket_digests(b.select(*a.columns), key, buckets).withColumnsRenamed({"n": "m", "d1": "e1", "d2": "e2"})
    same = F.col("n").eqNullSafe(F.col("m")) & F.col("d1").eqNullSafe(F.col("e1")) & F.col("d2").eqNullSafe(F.col("e2"))
    zero = F.lit(0).cast("long")
    return left.join(right, "bucket", "full").where(~same).select(
        "bucket", F.coalesce("n", zero).alias("left_rows"), F.coalesce("m", zero).alias("right_rows")
    )


def digest_diff(a: DataFrame, b: DataFrame, key: list[str], buckets: int = 4096) -> DataFrame:
    """``parity_diff``, but only rows of unequal buckets are shuffled and compared.

    Two scans of each table: one for the digests, one for the rows of the few
    unequal buckets (joined to at most ``buckets`` numbers). Rows of equal
    multisets cost no shuffle. A difference is missed only if both 64-bit sums
    and the count of a bucket agree by chance.
    """
    off = unequal_buckets(a, b, key, buckets).select(F.col("bucket").alias("_off"))
    some = lambda df: df.join(F.broadcast(off), _bucket(key, buckets) == F.col("_off"), "left_semi")
    return parity_diff(some(a), some(b.select(*a.columns)))


def page_directory(orders: DataFrame) -> DataFrame:
    """(order_date, rows, before): rows of each date and of all dates before it.

    One row per date, null first as in a listing; kept beside a table it answers
    where any page lies. Bounded by the calendar, so the running sum is one small task.
    """
    upto = Window.orderBy(F.col("order_date").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return orders.groupBy("order_date").agg(F.count("*").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(upto), F.lit(0)))


def page_at(orders: DataFrame, directory: DataFrame, page: int, page_size: int) -> DataFrame:
    """Page ``page`` (from 1) of the listing of ``orders`` by date and id, whose directory this is.

    The directory gives the dates the page lies in: they are a filter on the scan,
    and only what stands before the page on its first date is skipped. One row is
    fetched from the directory while the plan is built.
    """
    low, high = (page - 1) * page_size, page * page_size
    day = F.col("order_date")
    span = directory.where((F.col("before") < high) & (F.col("before") + F.col("rows") > low)).agg(
        F.min(day).alias("first"), F.max(day).alias("last"), F.min("before").alias("before"), F.count_if(day.isNull()).alias("nulls"), F.count("*").alias("n")
    ).first()
    if not span.n:
        return orders.limit(0)
    dated = day.between(F.lit(span["first"]), F.lit(span["last"])) if span["first"] is not None else F.lit(False)
    within = (dated | day.isNull()) if span.nulls else dated
    return orders.where(within).orderBy("order_date", "order_id").offset(low - span.before).limit(page_size)
