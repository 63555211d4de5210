"""Exact whole-table quantiles without gathering the column anywhere.

Spark's exact ``percentile`` merges every distinct value of a global group
in ONE task, which does not survive 100 TB. ``percentile_approx`` is bounded
but inexact. Exact selection here: bracket each wanted rank with two
``percentile_approx`` values (error <= size/accuracy, so a window of
+-2/accuracy always contains the true value), count what lies below the
bracket, and recurse into the bracket. Each pass shrinks the frame by about
``accuracy/4``; once a bracket holds few distinct values its
(value, count) histogram — aggregated map-side, so a hot value is one row —
is fetched and walked. The driver only ever sees scalars and bounded
histograms.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _walk(hist: list, offset: int, targets: list[int], out: dict[int, float]) -> None:
    cum = offset
    want = sorted(targets)
    if want and want[0] < offset:
        raise RuntimeError("rank below the frame; bracket did not hold it")
    i = 0
    for row in hist:
        cum += row[1]
        while i < len(want) and want[i] < cum:
            out[want[i]] = row[0]
            i += 1
    if i < len(want):
        raise RuntimeError("rank outside the frame; input changed between passes?")


def _brackets(frame: DataFrame, size: int, offset: int, targets: list[int], accuracy: int) -> list[tuple]:
    eps = 2.0 / accuracy
    fracs: list[float] = []
    for r in targets:
        local = (r - offset) / size
        fracs += [max(0.0, local - eps), min(1.0, local + eps)]
    approx = frame.agg(F.percentile_approx("v", fracs, accuracy).alias("q")).first()["q"]
    return [(approx[2 * i], approx[2 * i + 1], r) for i, r in enumerate(targets)]


def _select(frame: DataFrame, size: int, offset: int, targets: list[int], out: dict[int, float],
            accuracy: int, max_hist: int, force_hist: bool = False, first: list[tuple] | None = None) -> None:
    if size <= max_hist or force_hist:
        rows = frame.groupBy("v").count().orderBy("v").limit(max_hist + 1).collect()
        if len(rows) <= max_hist:
            _walk(rows, offset, targets, out)
            return
    brackets = sorted(first or _brackets(frame, size, offset, targets, accuracy))
    merged: list[list] = []
    for lo, hi, r in brackets:
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
            merged[-1][2].append(r)
        else:
            merged.append([lo, hi, [r]])
    v = F.col("v")
    aggs = []
    for i, (lo, hi, _) in enumerate(merged):
        aggs += [F.count_if(v < F.lit(lo)).alias(f"b{i}"), F.count_if(v.between(F.lit(lo), F.lit(hi))).alias(f"i{i}")]
    stats = frame.agg(*aggs).first()
    for i, (lo, hi, rs) in enumerate(merged):
        below, inside = stats[f"b{i}"], stats[f"i{i}"]
        if lo == hi:  # every value in the bracket is the same value
            for r in rs:
                out[r] = lo
            continue
        sub = frame.filter(v.between(F.lit(lo), F.lit(hi)))
        _select(sub, inside, offset + below, rs, out, accuracy, max_hist, force_hist=(inside >= size))


def exact_percentiles(df: DataFrame, col: str, probs: list[float], accuracy: int = 10_000,
                      max_hist: int = 100_000) -> list[float | None]:
    """Linear-interpolated (inclusive, R-7) percentiles of ``col``; NULL/NaN
    skipped; ``None`` for an empty column."""
    frame = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    # The count and the first brackets (p +- 2/accuracy) come out of one scan.
    # For n >= 2 * accuracy such a bracket holds both ranks next to p*(n-1):
    # they differ from p*n by at most 2 ranks, i.e. 2/n <= 1/accuracy, and the
    # sketch errs by at most 1/accuracy on either side.
    eps = 2.0 / accuracy
    fracs = [x for p in probs for x in (max(0.0, p - eps), min(1.0, p + eps))]
    head = frame.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", fracs, accuracy).alias("q")).first()
    n = head["n"]
    if n == 0:
        return [None] * len(probs)
    pos = [p * (n - 1) for p in probs]
    ranks = sorted({int(math.floor(h)) for h in pos} | {int(math.ceil(h)) for h in pos})
    first = None
    if n >= 2 * accuracy:
        by_rank = {}
        for i, h in enumerate(pos):
            for r in (int(math.floor(h)), int(math.ceil(h))):
                by_rank.setdefault(r, (head["q"][2 * i], head["q"][2 * i + 1], r))
        first = [by_rank[r] for r in ranks]
    values: dict[int, float] = {}
    _select(frame, n, 0, ranks, values, accuracy, max_hist, first=first)
    res = []
    for h in pos:
        lo, hi = int(math.floor(h)), int(math.ceil(h))
        res.append(values[lo] + (h - lo) * (values[hi] - values[lo]))
    return res
