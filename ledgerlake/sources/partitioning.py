"""Input parallelism for scans that come back as too few splits.

Spark splits a Parquet file by row group and a CSV by byte range. A source
written as one large row group (or one small file) is therefore read by ONE
task, and every narrow step after it — text rendering, cleaning, hashing,
rule checks — runs in that task until the first shuffle. On a cluster
reading many files the scan already has thousands of splits and this is a
no-op; it only acts when the scan has fewer partitions than the session can
run at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def task_slots(df: DataFrame) -> int:
    try:
        return max(1, df.sparkSession.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - no SparkContext on Spark Connect
        return 1


def spread_scan(df: DataFrame, *keys: str, min_partitions: int | None = None) -> DataFrame:
    """Hash-repartition ``df`` on ``keys`` when it has fewer partitions than
    ``min_partitions`` (default: the session's task slots).

    Call it on a bare scan (plus projections): asking for the partition
    count plans the scan only, it runs no job. Hash partitioning on a key is
    deterministic, so a retried task sees the same rows.
    """
    target = min_partitions or task_slots(df)
    try:
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - sessions without RDD access (Spark Connect)
        return df
    if have >= target:
        return df
    return df.repartition(target, *keys) if keys else df.repartition(target)
