"""Quality classifier by compression with two dictionaries.

Two zstandard dictionaries are trained, one on good and one on bad labelled
texts. A text is compressed with each, in blocks of ``block`` bytes so that its
own earlier blocks do not help and long texts count in full. The difference of
the two compressed sizes, bad minus good, per byte of text, tells which
dictionary fits better; a logistic curve fitted on labelled texts that the
dictionaries have not seen turns it into a score in 0..1.

Training reads at most ``max_rows`` labelled texts of each class (chosen by a
seeded hash of the id) and at most ``max_bytes`` of them per class; both are
parameters, and the sample is all that reaches the driver. The model (two
dictionaries of ``dict_bytes`` and three numbers) has a fixed size and travels
with the tasks. Scoring is one pass over the documents without a shuffle.

Null and empty texts have a difference of zero and get the curve's value there.
With too few labels of a class no model can be fitted; every text then scores
0.5. Rows of ``labels`` with a null id or quality are not used. Extra columns
of the documents are passed through; the names of the two columns that ``score``
adds are parameters, so that they need not clash with others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C


@dataclass(frozen=True)
class Params:
    block: int = 512
    dict_bytes: int = 32 << 10
    max_rows: int = 4_000
    max_bytes: int = 8 << 20
    level: int = 3
    seed: int = 11
    calibration_share: int = 4  # one labelled text in so many calibrates, the others train


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    intercept: float = 0.0
    params: Params = field(default_factory=Params)

    def __post_init__(self):
        self._packers = None

    def __getstate__(self):
        return {**self.__dict__, "_packers": None}

    def difference(self, text: bytes) -> float:
        """Compressed size with the bad less that with the good dictionary, per byte."""
        if not text or not self.good:
            return 0.0
        if self._packers is None:
            self._packers = [
                zstandard.ZstdCompressor(
                    level=self.params.level, dict_data=zstandard.ZstdCompressionDict(d),
                    write_content_size=False, write_checksum=False, write_dict_id=False,
                )
                for d in (self.bad, self.good)
            ]
        bad, good = self._packers
        step, diff = self.params.block, 0
        for i in range(0, len(text), step):
            piece = text[i : i + step]
            diff += len(bad.compress(piece)) - len(good.compress(piece))
        return diff / len(text)

    def score(self, text: bytes) -> float:
        z = self.slope * self.difference(text) + self.intercept
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def held_out(doc_id: Column) -> Column:
    """True for the third of ids from which no label may be learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, p: Params) -> list[tuple[int, bytes, bool]]:
    """At most ``max_rows`` texts of each class: (quality, text, calibrates)."""
    rank = F.xxhash64(F.lit(p.seed), F.col("doc_id"))
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where(F.col("quality") == F.col("other"))
        .drop("other")
    )
    out: list[tuple[int, bytes, bool]] = []
    for quality in (0, 1):
        # the chosen ids first (top-n of narrow rows), then only their texts
        ids = [r.doc_id for r in marks.where(F.col("quality") == quality).orderBy(rank, "doc_id").limit(p.max_rows).collect()]
        wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        found = (
            texts.join(F.broadcast(wanted), "doc_id", "left_semi")  # at most max_rows ids
            .where(F.length("text") > 0)
            .orderBy(rank, "doc_id", "text")
            .select("text", (F.pmod(F.xxhash64(F.lit(p.seed + 1), "doc_id"), F.lit(p.calibration_share)) == 0).alias("cal"))
            .limit(p.max_rows)
        )
        size = 0
        for row in found.toLocalIterator():
            if size >= p.max_bytes:
                break
            size += len(row.text)
            out.append((quality, bytes(row.text), row.cal))
    return out


def fit(sample: list[tuple[int, bytes, bool]], p: Params = Params()) -> Model:
    model = Model(params=p)
    dicts = []
    for quality in (1, 0):
        blocks = [t[i : i + p.block] for q, t, cal in sample if q == quality and not cal for i in range(0, len(t), p.block)]
        try:
            dicts.append(zstandard.train_dictionary(p.dict_bytes, blocks).as_bytes())
        except (zstandard.ZstdError, ValueError):  # too little text to train on
            raw = b"".join(blocks)[-p.dict_bytes :]
            if len(raw) < 8:
                return model
            dicts.append(raw)
    model.good, model.bad = dicts
    unseen = [(q, model.difference(t)) for q, t, cal in sample if cal]
    if len({q for q, _ in unseen}) < 2:
        unseen = [(q, model.difference(t)) for q, t, _ in sample]
    y = np.array([q for q, _ in unseen], float)
    x = np.array([d for _, d in unseen])
    model.slope, model.intercept = _logistic(x, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a little ridge on the slope."""
    scale = float(x.std()) or 1.0
    feats = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    ridge = np.diag([1e-2, 1e-9])
    for _ in range(50):
        prob = 1 / (1 + np.exp(-np.clip(feats @ w, -35, 35)))
        grad = feats.T @ (prob - y) + ridge @ w
        hess = (feats * (prob * (1 - prob))[:, None]).T @ feats + ridge
        step = np.linalg.solve(hess + 1e-9 * np.eye(2), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with two more columns: the score of column ``text`` and whether it is at least 0.5."""
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(t) for t in C.texts_of(b.column(at))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())],
                names=[*b.schema.names, *names],
            )

    return docs.mapInArrow(rows, schema)


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    return fit(labelled_sample(docs, labels, p), p)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, C.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drop the documents that the classifier rejects."""
    model = train(docs, C.table(spark, sf_dir, "labels"))
    return score(docs, model, ("_quality_score", "_quality_predicted")).where("_quality_predicted = 1").select(docs.columns)
