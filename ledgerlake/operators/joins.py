"""Join helpers: lookups, the join of two periods, long IN lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_join(df: DataFrame, dim: DataFrame, on: str | list[str] | Column) -> DataFrame:
    """Equi left lookup of ``df`` against a dimension table.

    There is no broadcast hint and no job while the plan is built: Spark broadcasts the
    dimension if its files' statistics or, at run time, its measured bytes are below
    ``spark.sql.autoBroadcastJoinThreshold``, and shuffles both sides otherwise.
    """
    return df.join(dim, on, "left")


def period_outer_join(cur: DataFrame, prev: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """The keys of two aggregates together, a null key included; a missing side or value reads as 0.

    The aggregates hold one row per key, so the join is as small as they are.
    """
    c, p = cur.select(F.col(key).alias("_ck"), F.col(value).alias("_cv"), F.lit(1).alias("_c")), prev.select(F.col(key).alias("_pk"), F.col(value).alias("_pv"))
    return c.join(p, c["_ck"].eqNullSafe(p["_pk"]), "full").select(
        F.when(F.col("_c").isNotNull(), F.col("_ck")).otherwise(F.col("_pk")).alias(key),
        F.coalesce("_cv", F.lit(0.0)).alias("cur_value"),
        F.coalesce("_pv", F.lit(0.0)).alias("prev_value"),
    )


def in_list_semi(df: DataFrame, col: str, values: list, max_inline: int = 1000) -> DataFrame:
    """``col IN (values)``: inline for short lists, a semi join beyond, whose
    strategy Spark picks from the size of the list. The columns stay the same."""
    if not values:
        return df
    if len(values) <= max_inline:
        return df.filter(F.col(col).isin(list(values)))
    keys = df.sparkSession.createDataFrame([(v,) for v in values], [col])
    return df.join(keys, col, "left_semi").select(*df.columns)
