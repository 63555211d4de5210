"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint has bit b set if more than half of the XXH64 values of
its word shingles have it. Fingerprints link when at most ``radius`` bits
differ; the classes are the connected components of those links.

Equal fingerprints are folded first (one row per distinct fingerprint with the
smallest id), so a group of copies costs one row. Distinct fingerprints are
then compared exactly, as unsigned words with exclusive-or and bit counts, in
tiles. To keep that linear in the corpus, fingerprints meet in a tile only if
they can be close: cut into ``radius + 1`` bands, two close fingerprints agree
in one band, and their population counts differ by at most the radius. So a
tile cell is (band, band value, population count); a cell is compared with
itself and the next ``radius`` counts, all other tile pairs are skipped. A cell
of many fingerprints is dealt as pairs of chunks to tasks of their own. Inside
a tile numpy compares blocks of ``tile`` rows, and passes on one link per row
to its class there instead of all pairs.

The components come from alternating large-star and small-star steps on staged
tables; nothing is collected. Null ids count as the largest id: a class's id
is null only if no row of it has an id, and such classes stay apart. Null and empty texts have
fingerprint zero. Repeated rows share a class. Extra columns are dropped by
``fingerprints``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import connected_components

SEED = 42


def simhash(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()  # bytes: only A-Z are lowered, only ASCII space splits
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    if len(words) <= shingle:
        grams = [line]
    else:
        grams = [line[a:b] for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, SEED) for g in grams], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int("".join("1" if 2 * n > len(h) else "0" for n in ones.tolist()), 2)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, ``tk`` (a hash of the text) and ``fp``, the fingerprint as a signed long, of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t, shingle) for t in C.texts_of(b.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "tk", "fp"])

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), F.col("text").cast("string").alias("text")
    ).mapInArrow(rows, "doc_id long, tk long, fp long")


def _roots(parent: np.ndarray, rows: np.ndarray) -> np.ndarray:
    found = parent[rows]
    while True:
        above = parent[found]
        if (above == found).all():
            return found
        found = above


def _join_close(bits: np.ndarray, left: np.ndarray, right: np.ndarray, parent: np.ndarray, radius: int, tile: int) -> None:
    """Join in ``parent`` the rows of ``left`` and ``right`` that are close, tile by tile.

    In each round every row of the tile with a close row in another class takes one
    such link, so the rounds are few and no pair is looped over.
    """

    def find(x: int) -> int:
        while parent[x] != x:
            x = int(parent[x])
        return x

    for i in range(0, len(left), tile):
        a = left[i : i + tile]
        for j in range(i if left is right else 0, len(right), tile):
            b = right[j : j + tile]
            close = np.bitwise_count(bits[a, None] ^ bits[None, b]) <= radius
            if left is right and i == j:
                close = np.triu(close, 1)
            while close.any():
                ra, rb = _roots(parent, a), _roots(parent, b)
                close &= ra[:, None] != rb[None, :]
                col = np.flatnonzero(close.any(axis=0))
                for x, y in zip(ra[close[:, col].argmax(axis=0)].tolist(), rb[col].tolist()):
                    p, q = find(x), find(y)
                    if p != q:
                        parent[max(p, q)] = min(p, q)


#: First side of a tile, compared with itself and the second; second side; first side, compared with the second only.
WITHIN, SECOND, FIRST = 0, 1, 2


def tiles(distinct: DataFrame, radius: int = 2, most: int = 16_384) -> DataFrame:
    """fp, rep, the tile (band, part, cell, tile) that a fingerprint goes to, and its side there.

    A cell whose counts all have at most ``most`` fingerprints is one tile (-1). In the
    others each count is dealt into chunks of about ``most``, and every pair of chunks
    is a tile of its own: one hot cell is the work of many tasks, and no task holds it.
    """
    bands = radius + 1
    width = [64 // bands + (i < 64 % bands) for i in range(bands)]
    low = [sum(width[:i]) for i in range(bands)]
    keys = F.array(*[
        F.struct(F.lit(i).cast("int").alias("band"), F.shiftrightunsigned("fp", low[i]).bitwiseAND(F.lit((1 << width[i]) - 1)).alias("part"))
        for i in range(bands)
    ])
    banded = distinct.select("fp", "rep", F.bit_count("fp").alias("pop"), F.explode(keys).alias("k")).select("fp", "rep", "pop", "k.*")
    in_cells = F.explode(F.sequence(F.col("pop") - radius, F.col("pop"))).alias("cell")
    cells = banded.select("fp", "rep", "pop", "band", "part", in_cells).where("cell >= 0")
    own = F.col("pop") == F.col("cell")
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("tile"), F.when(own, WITHIN).otherwise(SECOND).alias("side")))

    sizes = banded.groupBy("band", "part", "pop").agg(F.count("*").alias("n")).where(F.col("n") > most)
    chunks = [F.coalesce(F.max(F.when(F.col("pop") - F.col("cell") == d, F.ceil(F.col("n") / most))), F.lit(1)) for d in range(bands)]
    hot = C.stage(sizes.select("band", "part", "pop", "n", in_cells).groupBy("band", "part", "cell").agg(F.array(*chunks).alias("chunks")), "simhash-hot")
    if hot.isEmpty():
        dealt = cells.withColumn("to", whole)
    else:
        offset = F.col("pop") - F.col("cell")
        mine = F.pmod(F.xxhash64("fp"), F.element_at("chunks", offset + 1))

        def pair(i, d, j, side) -> Column:
            return F.struct(((i * bands + d) * (1 << 30) + j).cast("long").alias("tile"), side.cast("int").alias("side"))

        def each(d: int, use) -> Column:
            return F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks")[d] - 1), use)

        side = lambda j: F.when(j == mine, WITHIN).when(mine < j, FIRST).otherwise(SECOND)
        of_own = F.concat(
            each(0, lambda j: pair(F.least(mine, j), F.lit(0), F.greatest(mine, j), side(j))),
            *[each(d, lambda j, d=d: pair(mine, F.lit(d), j, F.lit(FIRST))) for d in range(1, bands)],
        )
        of_other = each(0, lambda i: pair(i, offset, mine, F.lit(SECOND)))
        split = F.when(F.col("chunks").isNull(), whole).when(own, of_own).otherwise(of_other)
        dealt = cells.join(hot, ["band", "part", "cell"], "left").withColumn("to", split)
    return dealt.select("fp", "rep", "band", "part", "cell", F.explode("to").alias("to")).select("fp", "rep", "band", "part", "cell", "to.*")


def links(distinct: DataFrame, radius: int = 2, tile: int = 1024, most: int = 16_384) -> DataFrame:
    """Spanning links (u, v) of the close fingerprints; ``distinct`` has fp and rep."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(rows: np.ndarray) -> list[tuple[int, int]]:
        """Links among the rows of one tile."""
        bits, rep, side = np.ascontiguousarray(rows[0]).view(np.uint64), rows[1], rows[-1]
        parent = np.arange(len(rep))
        first, second = np.flatnonzero(side != SECOND), np.flatnonzero(side == SECOND)
        if len(first) and side[first[0]] == WITHIN:
            _join_close(bits, first, first, parent, radius, tile)
        if len(first) and len(second):
            _join_close(bits, first, second, parent, radius, tile)
        moved = np.flatnonzero(parent != np.arange(len(rep)))
        return list(zip(rep[moved].tolist(), rep[_roots(parent, moved)].tolist())) if len(moved) else []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by tile: each is compared when it is complete
        held: list[np.ndarray] = []
        fresh = 0

        def done(last: bool) -> pa.RecordBatch:
            nonlocal held, fresh
            all_ = np.concatenate(held, axis=1)
            edge = np.flatnonzero((np.diff(all_[2:-1], axis=1) != 0).any(axis=0)) + 1
            cuts = [0, *edge.tolist(), all_.shape[1]]
            pairs = list(zip(cuts, cuts[1:]))
            held, fresh = [] if last else [all_[:, cuts[-2] :].copy()], 0
            found = [link for lo, hi in (pairs if last else pairs[:-1]) if hi - lo > 1 for link in compare(all_[:, lo:hi])]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["u", "v"])

        for b in batches:
            if b.num_rows:
                held.append(np.stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in b.columns]))
                fresh += b.num_rows
            if fresh >= 50_000:
                yield done(False)
        if held:
            yield done(True)

    key = ("band", "part", "cell", "tile")
    return tiles(distinct, radius, most).repartition(n, *key).sortWithinPartitions(*key).mapInArrow(rows, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, tk, fp, class (one of its fingerprints) and component_id (the smallest id of the class) of each row."""
    fps = C.stage(fingerprints(docs, shingle), "simhash")
    distinct = C.stage(fps.groupBy("fp").agg(F.min(C.id_or_last(F.col("doc_id"))).alias("least")), "simhash-distinct")
    comps = C.stage(connected_components(links(distinct.select("fp", F.col("fp").alias("rep")), radius)), "simhash-components")
    member = distinct.join(comps, distinct.fp == comps.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    ids = comps.join(distinct, comps.node == distinct.fp).groupBy(F.col("component").alias("_class")).agg(F.min("least").alias("_least"))
    named = C.stage(
        member.join(ids, F.col("class") == F.col("_class"), "left").select("fp", "class", F.coalesce("_least", "least").alias("component_id")),
        "simhash-classes",
    )
    return fps.join(named, "fp", "left").select(
        "doc_id", "tk", "fp", "class", F.when(F.col("component_id") != C.NO_ID, F.col("component_id")).alias("component_id")
    )


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the document with the smallest id stays (of repeated rows, one)."""
    C.prepare(spark)
    found = near_duplicates(docs)
    first = C.stage(
        found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("class", "tk", "doc_id").agg(F.count("*").alias("n"))
        .groupBy("class").agg(F.min(F.struct("tk", "doc_id", "n")).alias("kept")).select("kept.*"),
        "simhash-kept",
    )

    def rows_of(ids: DataFrame) -> DataFrame:
        # one way at every size: the texts are shuffled once, by id, and no side is broadcast
        same = docs.doc_id.cast("long").eqNullSafe(ids.doc_id) & (F.xxhash64(docs.text) == ids.tk)
        return docs.join(ids.hint("merge"), same, "left_semi")

    single, several = rows_of(first.where("n = 1")), C.stage(first.where("n > 1"), "simhash-repeated")
    if several.isEmpty():
        return single
    # a kept document on several rows: its smallest row stays
    row = rows_of(several).groupBy("doc_id", F.xxhash64("text")).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return single.unionByName(row.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
