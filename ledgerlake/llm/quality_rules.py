"""Quality rules with tokeniser fertility.

Base rules per text: fewer than ``min_words`` words, or more than
``repeat_percent`` per cent of the words in 3-word windows that occur twice or
more, fail it. The method then measures what a public sentencepiece vocabulary
makes of the words: characters per token, the share of tokens that are byte
fallbacks, and the entropy of the text's token distribution relative to the
most that its number of tokens allows. Each language has a band for each
measure, derived from its own distinct texts that pass the base rules: ``width``
times the distance between the quartiles, and at least the measure's own least
width, beyond either quartile. A text counts once however many copies it has, so
copies neither shrink a band nor draw it to themselves.
A text's own band is wider by ``noise`` / sqrt(words), what chance alone moves a
mean over so many words. A text outside a band of its language is rejected.

Two passes over narrow rows: the first reads every whole text once and is
staged as numbers and a 128-bit hash of the text; copies are folded by that hash
(combined map-side) and counted by cell of a fine grid, and the quartiles are read
off those counts, so no task sorts texts and reruns agree. A language of n distinct
texts takes its own band by n / (n + ``prior``) and the band of all texts by the
rest, so a small language has hardly a band of its own and no size is a switch.
Texts without a language take the band of all. Null and empty texts have no words, fail the base
rule and are not kept. Repeated rows get equal results. A word's tokens depend
on the word alone, so they are kept in a bounded cache; long texts are whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

FILE = "piece_bpe_32k.model"
MAX_WORDS = 300_000
SYMBOLS = b"#*$%&|<>"
#: Steps to one in which quartiles are told apart, far finer than the least widths of the bands.
GRID = 1000
_NOT_COUNTED = bytes([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)])  # spaces and UTF-8 continuation bytes
MEASURES = ("chars_per_token", "byte_share", "entropy")
#: A band's least width beyond a quartile, as (a constant, a share of the median):
#: characters per token have a scale that depends on language and vocabulary.
LEAST = {"chars_per_token": (0.0, 0.05), "byte_share": (0.05, 0.0), "entropy": (0.2, 0.0)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


def line_and_word_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x and x.strip()]
    repeat = 0
    if n > 2:
        seen = Counter(zip(words, words[1:], words[2:]))
        if len(seen) < n - 2:
            again = np.fromiter((seen[w] > 1 for w in zip(words, words[1:], words[2:])), bool, n - 2)
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[k : n - 2 + k] |= again
            repeat = int(cover.sum())
    return (
        n, len(text.translate(None, _NOT_COUNTED)), len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)), repeat,
    )


class Fertility:
    """Tokens of words under one sentencepiece vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def tokens(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [t.split() for t in texts]
        if len(self._young) > MAX_WORDS:
            self._old, self._young = self._young, {}
        young, old, new = self._young, self._old, []
        for w in dict.fromkeys(chain.from_iterable(split)):
            if w not in young:
                if (ids := old.get(w)) is None:
                    new.append(w)
                else:
                    young[w] = ids
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            found = self.sp.encode([w.decode("utf-8", "replace") for w in part], num_threads=1)
            young.update((w, np.array(ids, np.uint16).tobytes()) for w, ids in zip(part, found))
        get = young.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), np.uint16) for ws in split]

    def measures(self, tokens: np.ndarray, chars: int) -> tuple[float, float, float]:
        n = len(tokens)
        if not n:
            return 0.0, 0.0, 0.0
        counts = np.bincount(tokens)
        counts = counts[counts > 0]
        entropy = float(np.log2(n) - (counts * np.log2(counts)).sum() / n)
        most = np.log2(min(n, len(self.is_byte)))
        return chars / n, float(self.is_byte[tokens].sum()) / n, entropy / most if most else 1.0


@cache
def vocabulary(path: str) -> Fertility:
    return Fertility(path)


def measure(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, lang, the base counts, the three measures and a hash of every text."""
    path = path or default_path()
    ints = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for b in batches:
            texts = C.texts_of(b.column(2))
            for lo, hi in C.chunks(texts):
                part = texts[lo:hi]
                base = [line_and_word_counts(t) for t in part]
                more = [voc.measures(k, c[1]) for k, c in zip(voc.tokens(part), base)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo)]
                    + [pa.array([c[i] for c in base], pa.int64()) for i in range(5)]
                    + [pa.array([m[i] for m in more], pa.float64()) for i in range(3)]
                    + [pa.array([xxhash.xxh3_128_digest(t) for t in part], pa.binary())],
                    names=["doc_id", "lang", *ints, *MEASURES, "text_hash"],
                )

    kinds = ", ".join([f"{c} long" for c in ints] + [f"{m} double" for m in MEASURES])
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    ).mapInArrow(rows, f"doc_id long, lang string, {kinds}, text_hash binary")


def quartiles(sound: DataFrame, *key: str) -> DataFrame:
    """Per ``key``: n, the number of distinct texts, and each measure's quartiles over them.

    The quartiles are exact on a grid of 1 / GRID: counts by grid cell are summed
    map-side, and what is sorted per key is one row for each cell, not for each text.
    The result does not depend on the order in which tasks end.
    """
    texts = sound.groupBy(*key, "text_hash").agg(*[F.min(m).alias(m) for m in MEASURES])  # equal in all copies
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) * GRID).alias("cell")) for m in MEASURES]))
    cells = texts.select(*key, each.alias("c")).groupBy(*key, "c.measure", "c.cell").agg(F.count("*").alias("k"))
    of = Window.partitionBy(*key, "measure")
    ranked = cells.select(*key, "measure", "cell", F.sum("k").over(of).alias("n"), F.sum("k").over(of.orderBy("cell")).alias("upto"))
    found = lambda m, q: F.min(F.when((F.col("measure") == m) & (4 * F.col("upto") >= q * F.col("n")), F.col("cell"))) / GRID
    return ranked.groupBy(*key).agg(F.max("n").alias("n"), *[F.array(*[found(m, q) for q in (1, 2, 3)]).alias(m) for m in MEASURES])


def judge(measured: DataFrame, min_words: int = 50, repeat_percent: int = 50, width: float = 3.0, least: dict = LEAST, noise: float = 0.5, prior: int = 10) -> DataFrame:
    """``measured`` with base_failed and kept."""
    rows = measured.withColumn(
        "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    )
    sound = rows.where(~F.col("base_failed"))

    def bands(quartiles: DataFrame) -> list[Column]:
        out = []
        for m in MEASURES:
            q1, q2, q3 = F.col(m)[0], F.col(m)[1], F.col(m)[2]
            beyond = F.greatest(width * (q3 - q1), F.lit(least[m][0]) + least[m][1] * q2)
            out += [(q1 - beyond).alias(f"_{m}_low"), (q3 + beyond).alias(f"_{m}_high")]
        return out

    by_lang = quartiles(sound.where("lang is not null"), "lang")
    own = C.stage(by_lang.select(F.col("lang").alias("_lang"), (F.col("n") / (F.col("n") + prior)).alias("_weight"), *bands(by_lang)), "fertility-bands")
    whole = quartiles(sound.withColumn("_all", F.lit(0)), "_all")
    limits = (whole.select(*bands(whole)).first() or {f"_{m}_{x}": None for m in MEASURES for x in ("low", "high")})  # one row of six numbers
    joined = rows.join(own, rows.lang == own._lang, "left")
    inside, more = F.lit(True), noise / F.sqrt(F.greatest("n_words", F.lit(1)))
    weight = F.coalesce("_weight", F.lit(0.0))
    for m in MEASURES:
        low, high = [
            weight * F.coalesce(f"_{m}_{x}", F.lit(0.0)) + (1 - weight) * F.lit(limits[f"_{m}_{x}"]).cast("double") for x in ("low", "high")
        ]
        inside = inside & (F.col(m) >= low - more) & (F.col(m) <= high + more)
    return joined.select(*rows.columns, (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = C.stage(measure(C.table(spark, sf_dir, "documents")), "fertility")
    return judge(measured).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", *MEASURES
    )
