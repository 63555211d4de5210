"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Settings every job relies on. AQE re-plans joins from runtime sizes
# (broadcast only when the measured side is small), coalesces small shuffle
# partitions and splits skewed join partitions.
DEFAULT_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # Fall back from whole-stage codegen for methods HotSpot would refuse to
    # JIT-compile (> 8000 bytes of bytecode) instead of interpreting them.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(
    master: str | None = None,
    app_name: str = "ledgerlake",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Runtime SQL settings the library's plans rely on; safe to apply to a
# session someone else built.
SQL_DEFAULTS: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def apply_sql_defaults(spark: SparkSession) -> SparkSession:
    for k, v in SQL_DEFAULTS.items():
        spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, local_default: str | None = None) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir`` on the session. Only when
    it is unset (local tests) is a private scratch folder created and set.
    """
    current = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    if local_default is None and not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    path = local_default or tempfile.mkdtemp(prefix="ledgerlake-ckpt-")
    spark.conf.set(CHECKPOINT_KEY, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def checkpoint_dir(spark: SparkSession) -> str:
    current = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not current:
        raise RuntimeError(f"{CHECKPOINT_KEY} is not set; call ensure_checkpoint_dir() in tests")
    return current


#: Staged tables of this process that nobody has dropped.
_STAGED: list[str] = []


def staged_tables() -> list[str]:
    return list(_STAGED)


def new_table(spark: SparkSession, name: str) -> str:
    """The path of a staged table to be written under the shared checkpoint folder."""
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _STAGED.append(path)
    return path


def write_staged(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back; zstd, as staged bytes are written more than read."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize(df: DataFrame, name: str, written: list[str] | None = None) -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet under the shared checkpoint folder.

    A lost executor then recomputes from this table, not from the raw input,
    and two consumers of one stage read it once each instead of recomputing.
    The path is added to ``written``, so that the caller can drop the table.
    """
    path = new_table(df.sparkSession, name)
    back = write_staged(df, path)
    if written is not None:
        written.append(path)
    return back


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables that no result reads any more."""
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if p in _STAGED:
            _STAGED.remove(p)


def drop_unread(result: DataFrame, before: list[str]) -> DataFrame:
    """``result``, after deleting the staged tables written since ``before`` that it does
    not read. Those that it reads stay until the caller has used it, and then go with
    ``drop_tables(spark, staged_tables())``."""
    new = [p for p in _STAGED if p not in before]
    if new:
        read = {folder for f in result.inputFiles() for folder in f.split("/")}
        drop_tables(result.sparkSession, [p for p in new if os.path.basename(p) not in read])
    return result
