"""How filters interact: what each removes, in every order, from additive counts.

Filters are conditions on a document; one more filter fails a text that a smaller
id has too. A document's failures are a bit mask, and all that is asked about any
order of the filters is a sum over the counts of (part, mask). Plan:

1. Facts. One scan of the texts makes a narrow staged row for each document: id,
   part, mask of the plain filters, and a 64-bit hash of the text.
2. Counting-Bloom prepass. Each task folds the hashes of its rows into a sketch
   of counters that stop at two, listed sparsely by block of 65,536 slots; the
   sketches are merged by block. The slots grow with the documents
   (``SLOTS_PER_TEXT`` each) up to ``MAX_SLOTS``, so what is broadcast, one bit for
   each slot, has at most MAX_SLOTS / 8 bytes (32 MiB). A text one of whose slots was
   counted once is unique for certain. Beyond MAX_SLOTS / SLOTS_PER_TEXT documents more
   unique texts count as possible repeats; the result stays the same.
3. Only possible repeats shuffle, folded in each task first, and the smallest id
   of each full text is taken. Hashes that belong to one text give their
   documents' flag by a join of narrow rows; should two texts share a hash, those
   documents are compared by their full texts.
4. The flags join the facts and the labels, and counts by (part, mask) are summed
   map-side. A group of copies is folded in each task; the joins are plain ones,
   which are split where a key is hot.

A null text is empty. A null id counts as larger than all others and has no label.
Rows of one id are documents of their own, and never repeats of each other. A label
holds if any of the id's label rows says so. Very long texts are only read and
hashed. Only the named columns are read, so further columns change nothing. No
documents give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SLOTS_PER_TEXT, HASHES, MAX_SLOTS, BLOCK = 16, 4, 1 << 28, 1 << 16
#: Hashes that a task gathers before it writes a partial sketch.
FLUSH = 1 << 20


def slots_for(n: int) -> int:
    """Slots of the sketch for n texts: a power of two, at most MAX_SLOTS."""
    return min(MAX_SLOTS, max(BLOCK, 1 << math.ceil(math.log2(max(1, n * SLOTS_PER_TEXT)))))


def slots_of(h: np.ndarray, m: int) -> np.ndarray:
    """The slots of each hash, one row for each of HASHES functions."""
    h = h.astype(np.int64).view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(j) * high) & np.uint64(m - 1) for j in range(HASHES)]).astype(np.int64)


def _partial(m: int):
    """Arrow batches of hashes -> (block, slots counted once, slots counted more often)."""

    def rows(parts: list[np.ndarray]) -> pa.RecordBatch:
        slot, n = np.unique(slots_of(np.concatenate(parts), m), return_counts=True)
        block = slot // BLOCK
        edges = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(slot))
        cut = [(int(block[a]), (slot[a:b] % BLOCK).astype("<u2"), n[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array([c[0] for c in cut], pa.int32()), pa.array([c[1][c[2] == 1].tobytes() for c in cut], pa.binary()), pa.array([c[1][c[2] > 1].tobytes() for c in cut], pa.binary())],
            ["block", "once", "more"],
        )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            parts.append(b.column(0).to_numpy(zero_copy_only=False))
            size += len(parts[-1])
            if size >= FLUSH:
                yield rows(parts)
                parts, size = [], 0
        if size:
            yield rows(parts)

    return fold


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sketches sorted by block -> a bit for each slot counted twice or more."""
    now, count = None, None

    def done() -> pa.RecordBatch:
        bits = np.packbits(count > 1, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits], pa.binary())], ["block", "bits"])

    for b in batches:
        for block, once, more in zip(*(b.column(i).to_pylist() for i in range(3))):
            if block != now:
                if now is not None:
                    yield done()
                now, count = block, np.zeros(BLOCK, np.uint8)
            at = np.frombuffer(once, "<u2")
            count[at] = np.minimum(count[at] + 1, 2)
            count[np.frombuffer(more, "<u2")] = 2
    if now is not None:
        yield done()


def repeat_sketch(hashes: DataFrame, n: int) -> np.ndarray:
    """The merged sketch of a column of hashes: bit s is set if slot s was counted twice or more."""
    m = slots_for(n)
    partial = hashes.mapInArrow(_partial(m), "block int, once binary, more binary")
    merged = partial.repartition("block").sortWithinPartitions("block").mapInArrow(_merge, "block int, bits binary")
    sketch = np.zeros(m // 8, np.uint8)
    for row in merged.toLocalIterator():  # at most MAX_SLOTS / BLOCK rows of BLOCK / 8 bytes
        sketch[row.block * (BLOCK // 8) : (row.block + 1) * (BLOCK // 8)] = np.frombuffer(row.bits, np.uint8)
    return sketch


def may_repeat(spark: SparkSession, sketch: np.ndarray):
    """Whether a hash may be that of a repeated text; False is certain."""
    shared, m = spark.sparkContext.broadcast(sketch), 8 * len(sketch)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        slot = slots_of(h.to_numpy(), m)
        return pd.Series(((shared.value[slot >> 3] >> (slot & 7)) & 1).all(axis=0))

    return test


def smallest_ids(rows: DataFrame) -> DataFrame:
    """Rows (id, h, text) -> per h: how many texts have it, smallest and largest id."""
    by_text = rows.groupBy("h", "text").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    return by_text.groupBy("h").agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.max("last").alias("last"))


def repeats(facts: DataFrame, rows: DataFrame, bit: int) -> DataFrame:
    """``facts`` (id, h, mask, ...) with ``bit`` added to the mask where a smaller id has
    the same text; ``rows`` has (id, h, text) of the same documents."""
    spark = facts.sparkSession
    test = may_repeat(spark, repeat_sketch(facts.select("h"), facts.count()))
    possible = rows.where(test("h"))
    groups = C.stage(smallest_ids(possible).where("first < last"), "repeat-groups")
    found = groups.where("texts = 1").select("h", "first")
    suspect = facts.where(test("h")).join(found, "h", "left")
    suspect = suspect.withColumn("mask", F.when(F.col("id") > F.col("first"), F.col("mask") + bit).otherwise(F.col("mask")))
    shared = groups.where("texts > 1").select("h")
    if shared.limit(1).count():  # two texts of one 64-bit hash: by their full texts
        texts = possible.join(shared, "h", "left_semi")
        first = texts.groupBy("h", "text").agg(F.min("id").alias("first"))
        later = texts.join(first, ["h", "text"]).where("id > first").select("id", "h").distinct().withColumn("later", F.lit(bit))
        suspect = suspect.join(later, ["id", "h"], "left").withColumn("mask", F.col("mask") + F.coalesce("later", F.lit(0)))
    return suspect.select(*facts.columns).unionByName(facts.where(~test("h")))


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], part: Column, repeat_letter: str) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail,
    bit i being the i-th filter; those of quality 1 and of toxic 1 among them."""
    bits = {letter: 1 << i for i, letter in enumerate([*filters, repeat_letter])}
    text = F.coalesce("text", F.lit(""))
    mask = reduce(lambda a, b: a + b, [F.when(fails, F.lit(bits[x])).otherwise(F.lit(0)) for x, fails in filters.items()])
    ids = C.id_or_last(F.col("doc_id"))
    facts = C.stage(docs.select(ids.alias("id"), part.alias("part"), F.xxhash64(text).alias("h"), mask.alias("mask")), "audit-facts")
    rows = docs.select(ids.alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    flagged = repeats(facts, rows, bits[repeat_letter])
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    ).where("good + toxic > 0")
    return flagged.join(marks, "id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )


def orders_report(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the letters and step, from the counts of ``mask_counts``.

    A part has at most 2 ** len(letters) masks, so its counts are one small array.
    The Shapley sum needs no orders: of a document that fails j of k filters, each of
    those j removes it in k! / j orders.
    """
    k = len(letters)
    steps = []
    for order in permutations(letters):
        earlier = 0
        for step, x in enumerate(order, 1):
            steps.append(f"struct('{''.join(order)}' AS filter_order, {step} AS step, {1 << letters.index(x)} AS bit, {earlier} AS earlier)")
            earlier |= 1 << letters.index(x)
    masks = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    each = masks.select("part", "masks", F.expr(f"inline(array({', '.join(steps)}))"))

    def total(value, condition) -> Column:
        add = lambda acc, m: acc + F.when(condition(m["mask"]), value(m)).otherwise(F.lit(0).cast("long"))
        return F.aggregate("masks", F.lit(0).cast("long"), add)

    bit, earlier = F.col("bit"), F.col("earlier")
    passed = lambda m: m.bitwiseAND(earlier) == 0
    fails = lambda m: m.bitwiseAND(bit) != 0
    removed = lambda m: passed(m) & fails(m)
    n = lambda m: m["n"]
    share = lambda m: m["n"] * F.lit(math.factorial(k)) / F.bit_count(m["mask"])
    return each.select(
        "part", "filter_order", "step",
        total(n, lambda m: passed(m) & ~fails(m)).alias("kept"),
        total(n, removed).alias("removed"),
        total(n, lambda m: fails(m) & ~passed(m)).alias("redundant"),
        total(n, lambda m: m == bit).alias("unique_fails"),
        total(lambda m: m["good"], removed).alias("good_lost"),
        total(lambda m: m["toxic"], removed).alias("toxic_lost"),
        total(lambda m: share(m).cast("long"), fails).alias("shapley"),
    )


def text_filters(text: Column) -> dict[str, Column]:
    """The four plain filters: few words, repeated words, capitals, symbols (true: fails)."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    counts = mask_counts(docs, labels, text_filters(F.col("text")), F.coalesce("lang", F.lit("")), "E")
    return orders_report(counts, "ABCDE")


_LETTERS = "(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l)"
_FAILS = "(CASE {0} WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END)"
ORACLE_SQL = rf"""
WITH docs AS (
  SELECT coalesce(doc_id, 9223372036854775807) AS id, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (SELECT text, min(id) AS first FROM docs GROUP BY text),
facts AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * len(regexp_extract_all(d.text, '[A-Z]')) > 3 * length(d.text) AS c,
         regexp_matches(d.text, '[#$%&*|]') AS d, id > first AS e,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
         doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
  FROM docs d JOIN firsts USING (text)
), masks AS (
  SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM facts GROUP BY ALL
), orders AS (
  SELECT x1.l || x2.l || x3.l || x4.l || x5.l AS filter_order
  FROM {_LETTERS} x1, {_LETTERS} x2, {_LETTERS} x3, {_LETTERS} x4, {_LETTERS} x5
  WHERE len(list_distinct([x1.l, x2.l, x3.l, x4.l, x5.l])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)
), judged AS (
  SELECT part, filter_order, step, f, n, good, toxic, {_FAILS.format("f")} AS fails,
         (contains(earlier, 'A') AND a) OR (contains(earlier, 'B') AND b) OR (contains(earlier, 'C') AND c)
         OR (contains(earlier, 'D') AND d) OR (contains(earlier, 'E') AND e) AS gone,
         CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) + CAST(e AS INT) AS failed
  FROM masks, steps
), summed AS (
  SELECT part, filter_order, step, f,
         CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND fails), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (WHERE gone AND fails), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (WHERE fails AND failed = 1), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (WHERE NOT gone AND fails), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails), 0) AS BIGINT) AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed
"""
