"""Removal of repeated passages by FM-index shards over routed segments.

A window is ``window`` consecutive words of one document. A window goes if its
words also start in a document with a smaller id; all windows are judged on the
input. Plan:

1. Routing. Every window is known by its anchor, the smallest hash among its
   ``ANCHOR``-word grams, so equal windows have equal anchors. One narrow row
   per document and anchor is compared by anchor; anchors of one text only
   cannot hold a repeat. Documents without a shared anchor are finished here,
   and so are exact copies of a text with a smaller id (all their windows go).
2. Segments. Runs of windows with the same shared anchor are cut out of the
   documents left; equal segments are folded within each batch (smallest and
   largest id). A segment is dealt by its anchor, so all places where a window
   can occur meet in one shard. An anchor of more than ``hot`` documents is
   dealt by its single windows' hash instead, so no anchor fills a shard.
3. Shards. Each task sorts its segments by key and takes them in shards of
   complete keys of about ``shard_words`` words. A shard's words are
   numbered exactly (by their bytes), and an FM-index is built on their
   sequence: suffix order by prefix doubling, Burrows-Wheeler transform, a
   wavelet matrix of packed bits with block counts. Every window is streamed
   through it backwards, all windows of the shard at a time, which gives the
   matching statistic at its end: how many words back it still occurs. Where
   that reaches ``window`` words, the interval's smallest document is reported.
4. The reported windows go back to their documents, each with the smallest id
   that has it; what ids are larger lose the covered words.

Memory is bounded by the batch and the shard, never by a group of copies. Words
are matched exactly; texts are told apart by 64-bit hashes, so what two texts alone
share is missed if their hashes are equal (chance below 1e-9 for 100,000 texts).
Null and empty texts have no words. A null id counts as larger than all others,
and rows without an id do not remove each other's words. Rows with equal id and
text get equal results; rows with equal ids never remove each other's words.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

WINDOW, ANCHOR = 13, 5
#: One row in so many is looked at for anchors that are too frequent for one task.
SEEN = 64
_M = np.uint64(0xD6E8FEB86659FD93)


def _chain(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of each ``length`` consecutive values (the last ``length`` - 1 places are void)."""
    out = h.copy()
    for k in range(1, length):
        nxt = np.zeros_like(h)
        nxt[:-k] = h[k:]
        out = C.mix64(out * _M + nxt)
    return out


class Windows:
    """The windows of a list of texts: word position ``at`` and ``anchor`` of each."""

    def __init__(self, texts: list[bytes], window: int = WINDOW):
        self.words = w = C.Words(texts)
        self.window = window
        n = len(w.start)
        if n < window:
            self.at, self.anchor = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            return
        gram = min(ANCHOR, window)
        self.hashes = w.hashes()
        g = _chain(self.hashes, gram)
        least = g[: n - window + 1].copy()
        for k in range(1, window - gram + 1):
            np.minimum(least, g[k : k + len(least)], out=least)
        self.at = np.flatnonzero(w.doc[: n - window + 1] == w.doc[window - 1 :])
        self.anchor = least[self.at]


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, row_key = C.texts_of(b.column(1)), b.column(0).to_numpy(zero_copy_only=False)
        for lo, hi in C.chunks(texts):
            win = Windows(texts[lo:hi], window)
            doc = win.words.doc[win.at]
            new = np.ones(len(doc), bool)
            new[1:] = (win.anchor[1:] != win.anchor[:-1]) | (doc[1:] != doc[:-1])
            doc, anchor = doc[new], win.anchor[new]
            order = np.lexsort((anchor, doc))
            doc, anchor = doc[order], anchor[order]
            new = np.ones(len(doc), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[new].view(np.int64)), pa.array(row_key[lo:hi][doc[new]])], names=["anchor", "tk"]
            )


def kept_words(text: bytes, starts: np.ndarray | None, window: int) -> tuple[int, int, bytes]:
    """Number of words, how many the windows at ``starts`` cover, the others joined by a blank."""
    words = text.split()
    if starts is None or not len(starts):
        return len(words), 0, b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, starts, 1)
    np.add.at(gone, np.minimum(starts + window, len(words)), -1)
    keep = np.cumsum(gone[:-1]) == 0
    return len(words), int((~keep).sum()), b" ".join(w for w, k in zip(words, keep.tolist()) if k)


def _first_pass(batches: Iterator[pa.RecordBatch], window: int, digest: bool) -> Iterator[pa.RecordBatch]:
    """Finish copies and the documents without a shared anchor, pass on the text of the others."""
    for b in batches:
        texts = C.texts_of(b.column(b.schema.get_field_index("text")))
        anchors, copy = b.column(b.schema.get_field_index("anchors")), b.column(b.schema.get_field_index("copy")).to_pylist()
        open_ = [a and not c for a, c in zip(anchors.is_valid().to_pylist(), copy)]
        n, gone, kept, rest = [], [], [], []
        for t, o, c in zip(texts, open_, copy):
            count, _, words = kept_words(t, None, window)
            whole = c and count >= window
            words = b"" if whole else words
            n.append(count)
            gone.append(count if whole else 0)
            kept.append(None if o else sha256(words).hexdigest() if digest else words.decode("utf-8", "replace"))
            rest.append(t if o else None)
        yield pa.RecordBatch.from_arrays(
            [b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("id")), b.column(b.schema.get_field_index("tk")),
             pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(rest, pa.binary()),
             pc.if_else(pa.array(open_, pa.bool_()), anchors, pa.scalar(None, anchors.type))],
            names=["doc_id", "id", "tk", "n_words", "n_removed", "kept", "text", "anchors"],
        )


def _segments(batches: Iterator[pa.RecordBatch], window: int, places: bool) -> Iterator[pa.RecordBatch]:
    """Runs of windows with a shared anchor, as places (id, tk, pos, sid) or folded contents (key, seg, low, high)."""
    for b in batches:
        ids = b.column(b.schema.get_field_index("id")).to_numpy(zero_copy_only=False)
        tks = b.column(b.schema.get_field_index("tk")).to_numpy(zero_copy_only=False)
        texts, anchors = C.texts_of(b.column(b.schema.get_field_index("text"))), b.column(b.schema.get_field_index("anchors"))
        for lo, hi in C.chunks(texts, 1 << 20):
            win = Windows(texts[lo:hi], window)
            words, at = win.words, win.at
            doc = words.doc[at]
            # which windows have an anchor that is shared, and whether it is hot
            part = anchors.slice(lo, hi - lo)
            owner = np.repeat(np.arange(hi - lo), np.diff(part.offsets.to_numpy()))
            flat = part.flatten()
            shared, hot = flat.field(0).to_numpy(zero_copy_only=False).view(np.uint64), flat.field(1).to_numpy(zero_copy_only=False)
            pair = C.mix64(shared + C.mix64(owner.astype(np.uint64)))
            order = np.argsort(pair)
            pair, hot = pair[order], hot[order]
            mine = C.mix64(win.anchor + C.mix64(doc.astype(np.uint64)))
            found = np.searchsorted(pair, mine)
            found = np.minimum(found, max(len(pair) - 1, 0))
            is_shared = pair[found] == mine if len(pair) else np.zeros(len(mine), bool)
            is_hot = is_shared & hot[found] if len(pair) else is_shared
            at, doc, anchor, is_hot = at[is_shared], doc[is_shared], win.anchor[is_shared], is_hot[is_shared]
            if not len(at):
                continue
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | is_hot[1:]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            key = anchor[first].copy()
            if is_hot.any():
                whole = _chain(win.hashes, window)
                key[is_hot[first]] = whole[at[first[is_hot[first]]]]
            a, z = words.start[at[first]], words.end[at[last] + window - 1]
            segs = [b" ".join(words.data[x:y].split()) for x, y in zip(a.tolist(), z.tolist())]
            who = doc[first]
            if places:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi][who]), pa.array(tks[lo:hi][who]), pa.array((at[first] - words.first[who]).astype(np.int32)),
                     pa.array([md5(s).digest() for s in segs], pa.binary())],
                    names=["id", "tk", "pos", "sid"],
                )
                continue
            folded: dict[tuple[int, bytes], list[int]] = {}
            for k, s, i in zip(key.view(np.int64).tolist(), segs, ids[lo:hi][who].tolist()):
                if (f := folded.get((k, s))) is None:
                    folded[k, s] = [i, i]
                else:
                    f[0], f[1] = min(f[0], i), max(f[1], i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in folded], pa.int64()), pa.array([s for _, s in folded], pa.binary()),
                 pa.array([f[0] for f in folded.values()], pa.int64()), pa.array([f[1] for f in folded.values()], pa.int64())],
                names=["key", "seg", "low", "high"],
            )


class WaveletMatrix:
    """Rank queries on a sequence of small integers: one packed bit vector per bit, with block counts."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels = []
        for k in range(self.bits - 1, -1, -1):
            bit = (seq >> k) & 1
            packed = np.packbits(np.pad(bit.astype(np.uint8), (0, -len(bit) % 64 + 64)), bitorder="little").view("<u8")
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            zeros = len(bit) - int(bit.sum())
            self.levels.append((k, packed, before, zeros))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[block] + np.bitwise_count(packed[block] & mask)

    def rank(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often c occurs before lo and before hi, for arrays of queries."""
        start = np.zeros(len(c), np.int64)
        for k, packed, before, zeros in self.levels:
            one = ((c >> k) & 1).astype(bool)
            s, a, b = (self._ones(packed, before, x) for x in (start, lo, hi))
            start = np.where(one, zeros + s, start - s)
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
        return lo - start, hi - start


class FmIndex:
    """FM-index of a sequence of integers >= 1; suffixes are ordered by their first ``depth`` symbols at least."""

    def __init__(self, seq: np.ndarray, depth: int):
        self.text = np.append(seq, 0)
        rank, k = self.text.copy(), 1
        while k < depth:
            nxt = np.zeros_like(rank)
            nxt[:-k] = rank[k:]
            rank = np.unique(rank * (int(rank.max()) + 1) + nxt, return_inverse=True)[1]
            k *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        sigma = int(self.text.max()) + 1
        self.before = np.concatenate(([0], np.cumsum(np.bincount(self.text, minlength=sigma))))
        self.bwt = WaveletMatrix(self.text[self.suffixes - 1], sigma)

    def match_back(self, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics: for each end position, how many symbols back (up to ``most``) the
        text there occurs at least twice, and the suffix interval of the last ``most`` symbols
        (of one row, itself, where the search could stop early)."""
        c = self.text[ends]
        lo, hi = self.before[c].copy(), self.before[c + 1].copy()
        length = (hi - lo > 1).astype(np.int64)
        live = np.flatnonzero(length)
        for k in range(1, most):
            if not len(live):
                break
            c = self.text[ends[live] - k]
            a, b = self.bwt.rank(c, lo[live], hi[live])
            lo[live], hi[live] = self.before[c] + a, self.before[c] + b
            live = live[b - a > 1]
            length[live] = k + 1
        return length, lo, hi


def _search_shard(segs: list[bytes], low: np.ndarray, high: np.ndarray, window: int):
    """For each segment, the windows (offset, smallest id) that a larger id of its shares."""
    number: dict[bytes, int] = {}
    split = [s.split() for s in segs]
    lens = np.fromiter(map(len, split), np.int64, len(split))
    seq = np.ones(int(lens.sum()) + len(segs), np.int64)  # 1 closes a segment
    stop = np.cumsum(lens + 1)
    start = stop - lens - 1
    inside = np.ones(len(seq), bool)
    inside[stop - 1] = False
    seq[inside] = [number.setdefault(w, len(number) + 2) for ws in split for w in ws]
    index = FmIndex(seq, window)
    count = lens - window + 1
    owner = np.repeat(np.arange(len(segs)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    length, lo, hi = index.match_back(start[owner] + offset + window - 1, window)
    least = low[owner].copy()  # a window that occurs once belongs to its segment's documents
    many = np.flatnonzero(length >= window)
    if len(many):
        ids = np.append(low, np.iinfo(np.int64).max)[np.minimum(np.searchsorted(stop, index.suffixes, "right"), len(segs))]
        ranges, back = np.unique(np.stack((lo[many], hi[many])), axis=1, return_inverse=True)
        smallest = np.minimum.reduceat(np.append(ids, np.iinfo(np.int64).max), ranges.T.ravel())[::2]
        least[many] = smallest[back.ravel()]
    hit = np.flatnonzero(least < high[owner])
    return owner[hit], offset[hit], least[hit]


def _shards(batches: Iterator[pa.RecordBatch], window: int, shard_words: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, seg, low, high) sorted by key, taken in shards of complete keys."""
    keys: list[int] = []
    rows: dict[tuple[int, bytes], list[int]] = {}
    size = 0

    def search() -> pa.RecordBatch | None:
        segs = [s for _, s in rows]
        low = np.array([r[0] for r in rows.values()], np.int64)
        high = np.array([r[1] for r in rows.values()], np.int64)
        owner, offset, least = _search_shard(segs, low, high, window)
        if not len(owner):
            return None
        cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        pieces = pa.array(np.append(cuts, len(owner)).astype(np.int32))
        hits = pa.ListArray.from_arrays(
            pieces, pa.StructArray.from_arrays([pa.array(offset.astype(np.int32)), pa.array(least)], names=["at", "low"])
        )
        return pa.RecordBatch.from_arrays([pa.array([md5(segs[i]).digest() for i in owner[cuts].tolist()], pa.binary()), hits], names=["sid", "hits"])

    for b in batches:
        for k, s, lo, hi in zip(*(b.column(i).to_pylist() for i in range(4))):
            if size >= shard_words and k != keys[-1]:
                if (out := search()) is not None:
                    yield out
                rows, size = {}, 0
            if (r := rows.get((k, s))) is None:
                rows[k, s] = [lo, hi]
                size += s.count(b" ") + 1
            else:
                r[0], r[1] = min(r[0], lo), max(r[1], hi)
            keys = [k]
    if rows and (out := search()) is not None:
        yield out


def _last_pass(batches: Iterator[pa.RecordBatch], window: int, digest: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, starts = C.texts_of(b.column(1)), b.column(2).to_pylist()
        done = [kept_words(t, None if s is None else np.array(s, np.int64), window) for t, s in zip(texts, starts)]
        kept = [sha256(w).hexdigest() if digest else w.decode("utf-8", "replace") for _, _, w in done]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )


def dedup(docs: DataFrame, window: int = WINDOW, hot: int = 4096, shard_words: int = 200_000, digest: bool = False, often_rows: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``: the words left, joined by a blank (or their SHA-256)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), C.id_or_last(F.col("doc_id")).alias("id"), F.col("text").cast("string").alias("text")
    )
    rows = rows.withColumn("tk", F.xxhash64("text"))
    def anchors_of(df: DataFrame) -> DataFrame:
        return df.select("tk", "text").mapInArrow(lambda it: _anchor_rows(it, window), "anchor long, tk long")

    # which anchors are folded before the shuffle is seen on a part of the rows; it decides on the way, not on the result
    seen = rows.where(F.pmod(F.xxhash64("tk", "id"), F.lit(SEEN)) == 0)
    often = C.stage(anchors_of(seen).groupBy("anchor").count().where(F.col("count") * SEEN > often_rows).select("anchor"), "substring-often")
    anchors, shared = anchors_of(rows), []
    listed = F.struct("anchor", (F.col("n") > hot).alias("hot"))
    if not often.isEmpty():
        # few: each stands for more than often_rows rows, so the joins are left to Spark to broadcast or split
        folded = C.stage(
            anchors.join(often, "anchor", "left_semi").groupBy("anchor")
            .agg(F.count("*").alias("n"), F.min("tk").alias("least"), F.max("tk").alias("most")).where("least < most").select("anchor", "n"),
            "substring-folded",
        )
        shared.append(anchors.join(folded, "anchor").select("tk", listed.alias("a")))
        anchors = anchors.join(often, "anchor", "left_anti")
    # 16-byte rows; a window function spills and streams, it holds no group in memory
    same = Window.partitionBy("anchor")
    numbered = anchors.withColumns({"n": F.count("*").over(same), "least": F.min("tk").over(same), "most": F.max("tk").over(same)})
    shared.append(numbered.where("least < most").select("tk", listed.alias("a")))
    shared = reduce(DataFrame.unionByName, shared).groupBy("tk").agg(F.collect_set("a").alias("anchors"))  # at most a text's words
    # texts that several rows have, by hash and digest, with the smallest id
    firsts = (
        rows.where("text is not null").select("tk", F.struct("id", F.md5("text").alias("digest")).alias("row"))
        .groupBy("tk").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
        .select("tk", F.array("first").alias("firsts"))
    )
    known = C.stage(shared.join(firsts, "tk", "full"), "substring-known")
    is_copy = F.exists("firsts", lambda f: (f["digest"] == F.md5("text")) & (f["id"] < F.col("id")))
    joined = rows.join(known, "tk", "left").select(
        "doc_id", "id", "tk", "text", "anchors", F.coalesce(is_copy, F.lit(False)).alias("copy")
    )
    first = C.stage(
        joined.mapInArrow(
            lambda it: _first_pass(it, window, digest),
            "doc_id long, id long, tk long, n_words long, n_removed long, kept string, text binary, anchors array<struct<anchor:long,hot:boolean>>",
        ),
        "substring-first",
    )
    open_ = first.where("text is not null").select("doc_id", "id", "tk", "text", "anchors")
    contents = open_.mapInArrow(lambda it: _segments(it, window, False), "key long, seg binary, low long, high long")
    hits = C.stage(
        contents.repartition(n, "key").sortWithinPartitions("key").mapInArrow(
            lambda it: _shards(it, window, shard_words), "sid binary, hits array<struct<at:int,low:long>>"
        ),
        "substring-hits",
    )
    places = open_.mapInArrow(lambda it: _segments(it, window, True), "id long, tk long, pos int, sid binary")
    # a segment may be dealt in more than one piece of work under one content: the smallest id counts
    starts = places.join(hits, "sid").select(
        "id", "tk", F.expr("transform(filter(hits, h -> h.low < id), h -> pos + h.at)").alias("starts")
    ).where("size(starts) > 0")
    removed = starts.groupBy("id", "tk").agg(F.array_distinct(F.flatten(F.collect_set("starts"))).alias("starts"))
    last = (
        open_.select("doc_id", "id", "tk", "text").join(removed, ["id", "tk"], "left").select("doc_id", "text", "starts")
        .mapInArrow(lambda it: _last_pass(it, window, digest), "doc_id long, n_words long, n_removed long, kept string")
    )
    done = first.where("text is null").select("doc_id", "n_words", "n_removed", "kept")
    return done.unionByName(last)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(C.table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")
