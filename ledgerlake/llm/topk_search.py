"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Vectors are made integer (``floor(scale * x)``). A block of candidates is
indexed by impact: each component's posting falls in the segment of its bit
length, so a segment holds, for every dimension, the postings with values in
[2^(b-1), 2^b). Queries take the segments by descending impact and add up exact
partial scores; what the segments not yet taken can still add is at most
|q|_1 * (2^b - 1). As soon as that bound proves which candidates may be among
the k best (upper bound at least the k-th best lower bound), only those are
rescored exactly; if no bound proves it early, all segments are taken and the
scores are exact anyhow. Nothing is dropped without proof.

A segment is a list for each dimension of (rows, values), so the work of a query is the
postings it reads. Queries and candidates are dealt in blocks of bounded size, by the
number of the row and not its content; every block of the stated query set meets every
block of candidates in one task, which indexes its candidates once, leads the queries
past in slices, and passes on k rows a query. Those are merged per query row, the
best k of each map task first. There is no collected side. A candidate is copied once
for each ``query_block`` queries, a query once for each ``block`` candidates.

Vectors that are null or hold a null or non-finite component take no part.
Vectors of unlike lengths are compared as if the shorter one ended in zeros.
Rows with a null id are no queries and, as candidates, take no part (a result
could not name them). Repeated ids are candidates row by row, and each query row has a result
of its own, so a repeated query id has its ranks as often; a row with the query's own
id is never its candidate. Scores beyond the long range saturate. Only vec_id and
embedding are read, so further columns change nothing. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

_LONG = np.iinfo(np.int64)


def whole_numbers(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id and ``v``, the components as integers (kept as whole doubles); unusable rows go."""
    usable = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    return vectors.where(F.col("vec_id").isNotNull()).where(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: _floor(x.cast("double") * scale)).alias("v"),
    )


def _floor(x):
    # floor() of a double gives a long and would overflow for huge values
    whole = F.rint(x)
    return F.when(whole > x, whole - 1).otherwise(whole)


def _matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of q with the same rows of c, as longs."""
    if len(q) == 0 or float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2**53:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    out = [sum(int(a) * int(b) for a, b in zip(x, y)) for x, y in zip(q.tolist(), c.tolist())]
    return np.array([min(max(s, _LONG.min), _LONG.max) for s in out], np.int64)


class ImpactIndex:
    """The postings of one block of candidates, in segments by bit length of their values."""

    #: Queries that are led past the postings together.
    SLICE = 64

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        row, dim = np.nonzero(self.rows)
        value = self.rows[row, dim]
        bits = np.ceil(np.log2(np.abs(value) + 1)).astype(np.int64)
        order = np.lexsort((row, dim, -bits))
        row, dim, value, bits = row[order], dim[order], value[order], bits[order]
        edges = np.flatnonzero(np.diff(bits, prepend=-1) | np.diff(dim, prepend=-1))
        self.segments: list[tuple[int, list]] = []
        for lo, hi in zip(edges, [*edges[1:], len(row)]):
            if not self.segments or self.segments[-1][0] != bits[lo]:
                self.segments.append((int(bits[lo]), []))
            self.segments[-1][1].append((int(dim[lo]), row[lo:hi], value[lo:hi, None]))

    def top(self, qid: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, vec_id, score) of the k best of this block for each query."""
        parts = [self._top(lo, qid[lo : lo + self.SLICE], queries[lo : lo + self.SLICE], k) for lo in range(0, len(qid), self.SLICE)]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3

    @staticmethod
    def _promising(some: np.ndarray, rest: np.ndarray, k: int) -> bool:
        """Whether looking for the proof is worth it, judged by every 16th candidate."""
        near = max(1, k // 16)
        if len(some) <= near:
            return True
        bar = np.partition(some.T, len(some) - near, axis=1)[:, len(some) - near]
        return 16 * (some + 2 * rest >= bar).sum() <= 8 * k * some.shape[1]

    def _top(self, first: int, qid: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, m = len(qid), len(self.ids)
        norm = np.abs(queries).sum(axis=1)
        own = self.ids[:, None] == qid[None, :]
        # sums of whole doubles are exact up to 2^53; beyond, each bound is widened by the rounding
        most = norm * float(np.abs(self.rows).max(initial=0))
        fuzz = np.where(most < 2**52, 0.0, most * 1e-9)
        kind = np.float32 if most.max(initial=0) < 2**24 else np.float64  # either way sums of whole numbers are exact
        acc = np.zeros((m, n), kind)
        acc[own] = -np.inf
        may, by_dim = ~own, np.ascontiguousarray(queries.T.astype(kind))
        for i, (_, lists) in enumerate(self.segments):
            for dim, row, value in lists:
                acc[row] += value.astype(kind) * by_dim[dim]
            rest = norm * (2.0 ** self.segments[i + 1][0] - 1) if i + 1 < len(self.segments) else np.zeros(n)
            if m > k and (i + 1 == len(self.segments) or self._promising(acc[::16], rest, k)):
                bar = np.partition(acc.T, m - k, axis=1)[:, m - k].astype(np.float64)  # the k-th best score so far
                may = ~own & (acc + (rest + fuzz) >= bar - rest - fuzz)
                if may.sum() <= 4 * k * n:
                    break  # proven: no other can be among the k best
        q_at, c_at = np.nonzero(may.T)
        score = np.concatenate(
            [_exact(queries[q_at[i : i + 8192]], self.rows[c_at[i : i + 8192]]) for i in range(0, len(q_at), 8192)] or [np.zeros(0, np.int64)]
        )
        order = np.lexsort((self.ids[c_at], -score.astype(object) if len(score) and score.min() == _LONG.min else -score, q_at))
        q_at, c_at, score = q_at[order], c_at[order], score[order]
        best = np.arange(len(q_at)) - np.searchsorted(q_at, q_at) < k
        return first + q_at[best], self.ids[c_at[best]], score[best]


def search(queries: DataFrame, candidates: DataFrame, k: int = 20, query_block: int = 8192, block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query row."""
    number = F.monotonically_increasing_id()  # fixed by writing it
    queries, candidates = C.stage(queries.withColumn("row", number), "topk-queries"), C.stage(candidates.withColumn("row", number), "topk-candidates")
    n_q = max(1, -(-queries.count() // query_block))
    n_c = max(1, -(-candidates.count() // block))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q_side = queries.select("row", "vec_id", "v", dealt(n_q).alias("qb")).withColumn("cb", every(n_c))
    c_side = candidates.select(F.lit(None).cast("long").alias("row"), "vec_id", "v", dealt(n_c).alias("cb")).withColumn("qb", every(n_q))

    def rows(pair: pa.Table) -> pa.Table:
        row = pair.column("row").combine_chunks()
        is_query = row.is_valid().to_numpy(zero_copy_only=False)
        ids = pair.column("vec_id").to_numpy()
        vec = pair.column("v").combine_chunks()
        flat, offs = vec.flatten().to_numpy(zero_copy_only=False), vec.offsets.to_numpy() - vec.offsets[0].as_py()
        width = int(np.diff(offs).max(initial=1)) or 1
        full = _matrix([flat[a:b] for a, b in zip(offs, offs[1:])], width)
        q, c, s = ImpactIndex(ids[~is_query], full[~is_query]).top(ids[is_query], full[is_query], k)
        return pa.table({"row": row.drop_null().to_numpy()[q], "query_id": ids[is_query][q], "vec_id": c, "score": s})

    part = q_side.unionByName(c_side).groupBy("qb", "cb").applyInArrow(rows, "row long, query_id long, vec_id long, score long")
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_numbers(C.table(spark, sf_dir, "embeddings"))
    return search(vectors.where("vec_id % 20 = 0"), vectors)


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
