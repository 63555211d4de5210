"""Shared helpers: tables, staged Parquet, words of a text as numpy arrays."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Bound on one Arrow batch sent to a Python worker, so that many very long
#: texts never meet in one batch.
ARROW_BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}
#: One word: a run of anything but ASCII blanks and control spaces.
WORD = r"[^\x20\x09-\x0D]+"
_STAGED: list[str] = []
#: Stands for a null id wherever ids are compared: it is larger than all others.
NO_ID = (1 << 63) - 1


def ship_package(spark: SparkSession) -> None:
    """Let the executors' Python import this package where PYTHONPATH does not hold it."""
    package = Path(__file__).resolve().parent.parent
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    name = f"{package.name}-{spark.sparkContext.applicationId}.zip"
    if str(package.parent) in known or any(f.endswith(name) for f in spark.sparkContext.listFiles):
        return
    path = os.path.join(tempfile.mkdtemp(), name)  # Spark serves it from the driver
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)


def prepare(spark: SparkSession) -> None:
    """What the Python stages need: this package on the executors, bounded Arrow batches."""
    ship_package(spark)
    for k, v in ARROW_BATCH.items():
        spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, with the session made ready for Python stages."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only in local mode with none set."""
    got = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    got = tempfile.mkdtemp(prefix="ledgerlake-stage-")
    spark.conf.set(CHECKPOINT_KEY, got)
    return got


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts lineage: after a lost executor, work resumes from this table. Two
    readers of it do not compute it twice, and its size is known to the planner.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged() -> list[str]:
    """The paths that ``stage`` has written in this process and nobody has dropped."""
    return list(_STAGED)


def drop_staged(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables that no result still reads."""
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _STAGED.remove(p)


def free_prefix(columns: list[str], prefix: str) -> str:
    """``prefix``, lengthened until no column begins with it (names differ in more than case)."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def id_or_last(col: Column) -> Column:
    return F.coalesce(col.cast("long"), F.lit(NO_ID))


def sha256_of_spans(spans: Column) -> Column:
    """Lowercase hex SHA-256 of a span string."""
    return F.sha2(spans.cast("binary"), 256)


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; a null text is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose bytes together are at most ``most`` (or one text)."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


#: Bytes of a word that are hashed one by one.
LONG_WORD = 64
_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a list of texts: ``start`` and ``end`` byte offsets into
    ``data`` (the texts joined by a blank), ``doc`` the text each belongs to."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        inside = ~((raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D)))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(lens + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
        first = np.searchsorted(self.start, np.append(self.text_start, len(self.data) + 1))
        self.first, self.count = first[:-1], np.diff(first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.raw = raw

    def hashes(self) -> np.ndarray:
        """A 64-bit polynomial hash of each word's bytes, scrambled."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        lens = self.end - self.start
        acc = lens.astype(np.uint64)
        live = np.arange(len(lens))
        for off in range(LONG_WORD):
            acc[live] = (acc[live] ^ self.raw[self.start[live] + off]) * _MULT
            live = live[lens[live] > off + 1]
            if not len(live):
                break
        for w in live:  # words longer than that are rare: the rest is folded in at once
            rest = self.raw[self.start[w] + LONG_WORD : self.end[w]].tobytes()
            acc[w] = xxhash.xxh64_intdigest(rest, int(acc[w]))
        return mix64(acc)

