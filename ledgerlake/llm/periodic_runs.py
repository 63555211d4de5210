"""Runs of periodic text: stretches of words that repeat with a smallest period.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and at least max(6, 4q) words, which no neighbouring word extends.
Documents are independent, so the operator is one map over them; a task works on
pieces of at most 2 MB of texts (or one text), with exact word numbers.

1. Seeds. Two words q apart agree over at least 3q words of a run (5 words for
   q = 1). Periods are taken in classes [a, 1.5a] with k = 3a, the least overlap
   that the class guarantees, so every run holds a k-gram that occurs again q
   words later. As k >= 2q, no occurrence of it can lie between the two (the run
   would have a smaller period), so *neighbouring* occurrences are enough: at most
   one pair for each place and class, never all pairs of a k-gram.
2. The k-grams of a class are numbered exactly by pairs of the numbers of the class
   before (k grows by less than double). Only grams that occur twice in their
   document go on to the next class, so prose costs little after the first.
3. Extension. Each seed lies on the diagonal of its lag. A table of how far each
   lag is covered skips seeds inside a stretch that was already extended; the
   others are extended word by word in both directions, in blocks.

Null and empty texts have no words and no runs; very long texts only cost time in
proportion to their words (times the classes). Repeated rows and ids are judged
each on their own, null ids included. Only the id and text columns are read, so
further columns, whatever their names, change nothing. Empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: A run has at least this many words, and at least this many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4


def period_classes(most: int) -> Iterator[tuple[int, int, int]]:
    """(smallest period, largest period, k) up to documents of ``most`` words."""
    a, b, k = 1, 2, LEAST_WORDS - 1
    while LEAST_TIMES * a <= most:
        yield a, b, k
        a = b + 1
        b, k = a + a // 2, (LEAST_TIMES - 1) * a


def _renumber(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense numbers of equal keys, and how many there are."""
    values, number = np.unique(key, return_inverse=True)
    return number.astype(np.int64), len(values)


def _first_grams(ids: np.ndarray, doc: np.ndarray, end: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose k-gram occurs twice in its document, and exact gram numbers.

    A hash first leaves out nearly all that occur once; the rest is numbered word by word.
    """
    at = np.flatnonzero(np.arange(len(ids)) + k <= end)
    key = C.mix64(doc[at].astype(np.uint64) + np.uint64(1))
    for j in range(k):
        key = C.mix64(key + ids[at + j].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = at[twice]
    gram, n = _renumber(doc[at])
    width = int(ids.max(initial=0)) + 1
    for j in range(k):
        gram, n = _renumber(gram * width + ids[at + j])
    return at, gram


def _longer_grams(at: np.ndarray, gram: np.ndarray, doc: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams ``by`` words longer, as pairs of the grams at both ends; only those that occur twice."""
    where = np.full(len(doc), -1, np.int64)
    where[at] = np.arange(len(at))
    later = at + by
    other = where[np.minimum(later, len(doc) - 1)]
    whole = (later < len(doc)) & (other >= 0)
    whole[whole] &= doc[at[whole]] == doc[later[whole]]
    at, other, gram_here = at[whole], other[whole], gram[whole]
    number, n = _renumber(gram_here * (int(gram.max(initial=0)) + 1) + gram[other])
    twice = np.bincount(number, minlength=n)[number] > 1
    return at[twice], number[twice]


def _forward(ids: np.ndarray, x: int, q: int, limit: int) -> int:
    """The first place from x on whose word differs from that q later (limit: where that ends)."""
    step = 64
    while x < limit:
        n = min(step, limit - x)
        differ = np.flatnonzero(ids[x : x + n] != ids[x + q : x + q + n])
        if len(differ):
            return x + int(differ[0])
        x, step = x + n, min(2 * step, 1 << 16)
    return limit


def _backward(ids: np.ndarray, x: int, q: int, limit: int) -> int:
    """The smallest place down to limit from which on all words up to x equal those q later."""
    step = 64
    while x > limit:
        n = min(step, x - limit)
        differ = np.flatnonzero(ids[x - n : x] != ids[x - n + q : x + q])
        if len(differ):
            return x - n + int(differ[-1]) + 1
        x, step = x - n, min(2 * step, 1 << 16)
    return limit


def runs(ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run, by start and then period, for each of several
    documents whose word numbers stand one after the other in ``ids``."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in count]
    doc = np.repeat(np.arange(len(count)), count)
    end = np.repeat(first + count, count)
    at = gram = None
    for a, b, k in period_classes(int(count.max(initial=0))):
        if at is None:
            at, gram = _first_grams(ids, doc, end, k)
        else:
            at, gram = _longer_grams(at, gram, doc, k - before)
        before = k
        if not len(at):
            break
        order = np.lexsort((at, gram))
        lag = at[order][1:] - at[order][:-1]
        near = (gram[order][1:] == gram[order][:-1]) & (lag >= a) & (lag <= b)
        place, lag = at[order[:-1][near]], lag[near]
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        new = np.ones(len(place), bool)  # seeds that follow another on the same diagonal add nothing
        new[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1) | (doc[place[1:]] != doc[place[:-1]])
        covered: dict[tuple[int, int], int] = {}
        for x, q in zip(place[new].tolist(), lag[new].tolist()):
            d = int(doc[x])
            lo, hi = int(first[d]), int(first[d] + count[d])
            if x + k <= covered.get((d, q), 0):
                continue
            right = _forward(ids, x + k, q, hi - q)
            covered[d, q] = right
            left = _backward(ids, x, q, lo)
            if right + q - left >= max(LEAST_WORDS, LEAST_TIMES * q):
                found[d].append((left - lo, right + q - left, q))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapse(words: list[bytes], of: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a blank, without those that a run holds after its first period."""
    if not of:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in of:
        edge[start + q] += 1
        edge[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0))


def highest(of: list[tuple[int, int, int]]) -> tuple[int, int, int] | tuple[None, None, None]:
    """The run with the greatest length / period (then smallest start, then period)."""
    best = None
    for r in of:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best or (None, None, None)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, start long, length long, period long, collapsed string"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = C.texts_of(batch.column(1))
        for lo, hi in C.chunks(texts):
            number: dict[bytes, int] = {}
            words = [t.split() for t in texts[lo:hi]]
            count = np.fromiter(map(len, words), np.int64, hi - lo)
            ids = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64, int(count.sum()))
            found = runs(ids, np.cumsum(count) - count, count)
            best = [highest(f) for f in found]
            flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 3)
            each = pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(3)], fields=list(_RUN))
            cut = pa.array(np.concatenate(([0], np.cumsum([len(f) for f in found]))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo), pa.array(count), pa.ListArray.from_arrays(cut, each),
                    *[pa.array([x[j] for x in best], pa.int64()) for j in range(3)],
                    pa.array([collapse(w, f) for w, f in zip(words, found)], pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "start", "length", "period", "collapsed"],
            )


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id as doc_id, n_words, all runs by start and period, the run of the
    highest exponent (start, length, period; null without runs) and the collapsed text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_judge, SCHEMA)


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text, but in a tenth of the documents (by the id's checksum) the words from some
    place on repeat the first p of them again and again. A null id plants nothing."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(f"({C.WORD})"), F.lit(1))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    new = F.slice(F.concat(F.slice(words, F.lit(1), a), F.flatten(F.array_repeat(F.slice(words, a + 1, p), times))), F.lit(1), n)
    return F.when((h % 10 == 0) & text.rlike(C.WORD), F.array_join(new, " ")).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    planted = docs.select("doc_id", with_planted_runs(F.col("doc_id"), F.col("text")).alias("text"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return find_runs(planted).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period",
        F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
