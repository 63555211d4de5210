"""The filter audit against brute force over all orders, and its sketch."""

import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import filter_audit as A
from tests.llm.tables import SF

LAST = (1 << 63) - 1


def read(folder, name):
    import os

    path = f"{folder}/{name}.parquet"
    return duckdb.connect().execute(f"SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'").fetchall()


def brute(folder):
    """Every document is led through every order of the filters."""
    docs, labels = read(folder, "documents"), read(folder, "labels")
    good = {r[0] for r in labels if r[0] is not None and r[1] == 1}
    toxic = {r[0] for r in labels if r[0] is not None and r[2] == 1}
    first = {}
    for r in docs:
        t = r[1] or ""
        first[t] = min(first.get(t, LAST), LAST if r[0] is None else r[0])
    out = {}
    for r in docs:
        t, i = r[1] or "", LAST if r[0] is None else r[0]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i > first[t],
        }
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                c = out.setdefault((r[2] or "", order, step), Counter())
                if fails[f]:
                    c["redundant" if gone else "removed"] += 1
                    c["unique_fails"] += sum(fails.values()) == 1
                    c["good_lost"] += not gone and r[0] in good
                    c["toxic_lost"] += not gone and r[0] in toxic
                    gone = True
                c["kept"] += not gone
    total = Counter()
    for (part, order, step), c in out.items():
        total[part, order[step - 1]] += c["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {k: tuple(c[n] for n in names) + (total[k[0], k[1][k[2] - 1]],) for k, c in out.items()}


@pytest.mark.parametrize("which", ["given", "awkward", "empty"])
def test_audit_equals_brute_force(spark, folder, empty, which):
    d = {"given": SF, "awkward": folder, "empty": empty}[which]
    rows = A.op11_filter_audit(spark, d).collect()
    got = {tuple(r[:3]): tuple(r[3:]) for r in rows}
    assert len(got) == len(rows) and got == brute(d)


def test_sketch_clears_only_unique_hashes(spark):
    """Over several tasks: every repeated hash may repeat, and nearly no other does."""
    rows = spark.range(0, 40000, 1, 7).select(F.xxhash64(F.when(F.col("id") % 10 == 0, F.col("id") % 1000).otherwise(F.col("id"))).alias("h"))
    n = rows.groupBy("h").count().toPandas()
    sketch = A.repeat_sketch(rows, 40000)
    assert 8 * len(sketch) == A.slots_for(40000) >= A.SLOTS_PER_TEXT * 40000
    slot = A.slots_of(n["h"].to_numpy(), 8 * len(sketch))
    may = ((sketch[slot >> 3] >> (slot & 7)) & 1).all(axis=0)
    repeated = n["count"].to_numpy() > 1
    assert may[repeated].all() and may[~repeated].mean() < 0.02


def test_a_full_sketch_changes_nothing(spark, folder, monkeypatch):
    """Beyond the bound on its size the sketch clears less; the counts stay."""
    monkeypatch.setattr(A, "MAX_SLOTS", A.BLOCK)
    monkeypatch.setattr(A, "FLUSH", 3)
    assert A.slots_for(10**9) == A.BLOCK
    got = {tuple(r[:3]): tuple(r[3:]) for r in A.op11_filter_audit(spark, folder).collect()}
    assert got == brute(folder)


def test_texts_that_share_a_hash(spark):
    rows = spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (3, 7, "a"), (4, 7, "b"), (4, 7, "b"), (5, 7, "c"), (6, 8, "d"), (9, 8, "d")], "id long, h long, text string")
    facts = rows.select("id", "h", F.lit(0).alias("mask"))
    got = sorted(tuple(r) for r in A.repeats(facts, rows, 16).select("id", "mask").collect())
    assert got == [(1, 0), (2, 0), (3, 16), (4, 16), (4, 16), (5, 0), (6, 0), (9, 16)]


def test_slots_and_saturation():
    assert A.slots_for(0) == A.BLOCK and A.slots_for(10**12) == A.MAX_SLOTS
    parts = [np.arange(5), np.arange(3, 9)]
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(p, pa.int64())], ["h"]) for p in parts]
    once, more = set(), set()
    for b in A._partial(A.BLOCK)(iter(batches)):
        for o, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            once |= set(np.frombuffer(o, "<u2").tolist())
            more |= set(np.frombuffer(m, "<u2").tolist())
    want = Counter(A.slots_of(np.concatenate(parts), A.BLOCK).ravel().tolist())
    assert once == {s for s, c in want.items() if c == 1} and more == {s for s, c in want.items() if c > 1}
