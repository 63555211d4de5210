"""One hot cell is dealt to many tiles, and loses no link."""

import numpy as np
from pyspark.sql import functions as F

from ledgerlake.llm import common as C
from ledgerlake.llm import simhash
from ledgerlake.llm.components import connected_components


def hot_fingerprints(n=1500):
    """Fingerprints that share the lowest band and nearly all have one bit count; chains, pairs and loners."""
    rng = np.random.default_rng(3)
    found = set()
    while len(found) < n:
        high = rng.permutation(42)[:12]
        fp = sum(1 << (22 + int(b)) for b in high) | 5
        found.add(fp)
        if rng.random() < 0.5:  # a neighbour of the same count, two bits away, and one of another count
            out, into = int(high[0]), next(b for b in range(42) if b not in high)
            found.add(fp ^ (1 << (22 + out)) ^ (1 << (22 + into)))
            found.add(fp ^ (1 << (22 + out)))
    return np.array(sorted(found), np.uint64)


def brute_classes(bits, radius):
    label = np.arange(len(bits))
    close = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    while True:
        now = np.where(close, label[None, :], len(bits)).min(axis=1)
        if (now == label).all():
            return [frozenset(bits[label == x].tolist()) for x in np.unique(label)]
        label = now


def components(spark, bits, radius, most):
    C.prepare(spark)
    rows = [(int(x), int(x)) for x in bits.view(np.int64)]
    links = simhash.links(C.stage(spark.createDataFrame(rows, "fp long, rep long"), "test"), radius, 64, most)
    by = {}
    for r in connected_components(links).collect():
        by.setdefault(r.component, set()).add(r.node & ((1 << 64) - 1))
    joined = {x for s in by.values() for x in s}
    return sorted(map(sorted, by.values())) + [[x] for x in sorted(set(bits.tolist()) - joined)]


def test_hot_cells_lose_no_link(spark):
    bits = hot_fingerprints()
    want = sorted(map(sorted, brute_classes(bits, 2)))
    assert any(len(x) > 2 for x in want) and any(len(x) == 1 for x in want)
    for most in (40, 300, 16_384):
        assert sorted(components(spark, bits, 2, most)) == want


def test_no_tile_holds_a_hot_cell(spark):
    bits = hot_fingerprints()
    rows = [(int(x), int(x)) for x in bits.view(np.int64)]
    most = 100
    sizes = simhash.tiles(spark.createDataFrame(rows, "fp long, rep long"), 2, most).groupBy("band", "part", "cell", "tile").count()
    largest = sizes.agg(F.max("count")).first()[0]
    assert len(bits) > 10 * most and largest <= 3 * 2 * most


def test_dense_classes_need_few_rounds(spark):
    base = 0b1011 << 30
    bits = np.array(sorted({base} | {base ^ (1 << i) for i in range(64)} | {base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)}), np.uint64)
    for most in (50, 16_384):
        assert components(spark, bits, 2, most) == [bits.tolist()]
