"""Benchmark passages against brute force; no Python in the plan; a passage in a third of all documents."""

import hashlib
import os
import re
from collections import Counter

import duckdb
import pytest

from ledgerlake.llm import decontamination as D
from tests.llm.tables import SF, awkward

DOC = "doc_id long, text string, words string, row int, matches int"
ITEM = "item_id long, text string, wid int, window string"


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10, slop=3):
    """(doc_id, n_words, n_hit, n_items, items, n_near) by comparing every place with every window."""
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - k + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + k]), set()).add(i if i is None else str(i))
    sizes, count = {len(w) for w in windows}, Counter(x for _, t in docs for x in words(t))
    pair = {}
    for w in windows:
        if all(count[x] for x in w):
            r = sorted(range(len(w)), key=lambda j: (count[w[j]], j))
            a, b = r[0], r[min(1, len(r) - 1)]
            pair[w] = (w[a], w[b], b - a)
    for i, t in docs:
        w, hit, listed, near = words(t), set(), set(), set()
        for m in sizes:
            for s in range(len(w) - m + 1):
                if (found := windows.get(tuple(w[s : s + m]))) is not None:
                    hit |= set(range(s, s + m))
                    listed |= found
        at = {}
        for j, x in enumerate(w):
            at.setdefault(x, set()).add(j)
        for x, (a, b, d) in pair.items():
            if any(j + d + e in at.get(b, ()) for j in at.get(a, ()) for e in range(-slop, slop + 1)):
                near |= windows[x]
        listed, near = listed - {None}, near - {None}
        yield (i, len(w), len(hit), len(listed), hashlib.sha256(",".join(sorted(listed)).encode()).hexdigest(), bool(hit), len(near))


def table(folder, name):
    path = f"{folder}/{name}.parquet"
    cols = "doc_id, text" if name == "documents" else "item_id, text"
    return duckdb.connect().execute(f"SELECT {cols} FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'").fetchall()


@pytest.fixture(scope="module")
def benchmark_folder(spark, tmp_path_factory):
    """The awkward documents, with items cut from them, short ones, repeated ones and rows without id or words."""
    d = tmp_path_factory.mktemp("leaks")
    rows = [(r[0], r[1], "w", 1, 2) for r in awkward()]
    rows += [(100, "ONE two", "", 0, 0), (101, "one-two three", "", 0, 0), (102, "Zebra zebra zebra", "", 0, 0), (103, "quick fox near the brown lazy dog", "", 0, 0)]
    spark.createDataFrame(rows, DOC).coalesce(3).write.parquet(f"{d}/documents.parquet")
    fox = "The quick, brown FOX jumps over the lazy dog while nine small birds sing!"
    items = [(1, fox), (1, fox), (2, fox), (10, "one two"), (11, "zebra"), (12, "word " * 30), (13, "a b c " * 9), (14, None), (15, "?!"), (None, "ünï çödé Ünï çödé"),
             (16, "é" * 40), (17, "no such passage stands in any of the documents at all here"), (18, "one")]
    spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEM).write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def compare(spark, d):
    order = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted((tuple(r) for r in D.op13_benchmark_decontamination(spark, d).collect()), key=order)
    want = sorted(brute(table(d, "documents"), table(d, "benchmark")), key=order)
    assert got == want
    return got


def test_given_tables(spark):
    assert sum(r[5] for r in compare(spark, SF)) > 5


def test_awkward_tables(spark, benchmark_folder):
    got = compare(spark, benchmark_folder)
    assert any(r[0] == 103 and not r[5] for r in got) and any(r[6] > r[3] for r in got)


def test_more_candidates_than_are_broadcast(spark, benchmark_folder, monkeypatch):
    monkeypatch.setattr(D, "MAX_BROADCAST_ROWS", 2)
    compare(spark, benchmark_folder)


def test_empty_tables(spark, benchmark_folder, tmp_path):
    def copy(name, schema, to):
        spark.createDataFrame([], schema).write.parquet(f"{to}/{name}.parquet")

    os.makedirs(tmp_path / "a")
    copy("documents", "doc_id long, text string", tmp_path / "a")
    spark.read.parquet(f"{benchmark_folder}/benchmark.parquet").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    assert compare(spark, f"{tmp_path}/a") == []
    os.makedirs(tmp_path / "b")
    copy("benchmark", "item_id long, text string", tmp_path / "b")
    spark.read.parquet(f"{benchmark_folder}/documents.parquet").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert all(r[2] == r[3] == r[6] == 0 for r in compare(spark, f"{tmp_path}/b"))


def test_matches_are_spans(spark):
    docs = spark.createDataFrame([(1, "x Alpha beta gamma delta y alpha BETA gamma"), (2, "alpha x beta gamma"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("i", "alpha beta gamma"), ("j", "gamma delta"), ("k", "beta")], "item_id string, text string")
    got = {r.doc_id: r for r in D.decontaminate(docs, items, window=3, slop=1).collect()}
    assert [(m.start, m.end) for m in got[1].matches] == [(1, 4), (2, 3), (3, 5), (6, 9), (7, 8)] and got[1].n_hit == 7 and got[1]["items"] == ["i", "j", "k"]
    assert [(m.start, m.end) for m in got[2].matches] == [(2, 3)] and got[2]["items"] == ["k"] and got[2].n_near == 2
    assert got[3].matches is None and got[3].n_hit == 0 and got[3]["items"] == []


def test_no_python_in_the_plans(spark, benchmark_folder):
    docs, items = (spark.read.parquet(f"{benchmark_folder}/{t}.parquet") for t in ("documents", "benchmark"))
    index = D.build_index(docs, items)
    for df in (D.together(index), D.phrase_matches(index, D.together(index)), D.near_items(index, D.together(index)), D.op13_benchmark_decontamination(spark, benchmark_folder)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_a_passage_in_a_third_of_all_documents(spark, tmp_path):
    """Places are met one by one: the joined lists hold a row for each occurrence, not for each pair."""
    passage = "seven brave tailors mend the old king's red coat before the first snow falls"
    rows = [(i, f"w{i} " * 5 + (passage if i % 3 == 0 else "") + " a" * 200) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = D.build_index(docs, spark.createDataFrame([(1, passage), (2, "a " * 12)], "item_id long, text string"))
    places = D.together(index, 2)
    assert D.phrase_matches(index, places).count() == 900
    assert places.count() <= 300 * index.pairs.count() + 900 * 200 * 5
