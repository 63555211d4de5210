"""Periodic runs against brute force: random small alphabets, planted runs, awkward rows."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.llm import periodic_runs as P
from tests.llm.tables import SF, documents


def brute_runs(w):
    """Every run by its definition: for each period all maximal stretches, then the smallest period only."""
    n, found = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                found.add((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(docs):
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for d in docs for w in d], np.int64)
    count = np.array([len(d) for d in docs], np.int64)
    return ids, np.cumsum(count) - count, count


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(
    st.text("ab", max_size=60),
    st.builds(lambda a, r, k, z: a + r * k + z, st.text("abc", max_size=9), st.text("abc", min_size=1, max_size=13), st.integers(2, 9), st.text("abc", max_size=9)),
    st.builds(lambda r, i, k, j: ((r * i + "x") * k + r * j), st.text("ab", min_size=1, max_size=5), st.integers(3, 6), st.integers(2, 6), st.integers(0, 6)),
), min_size=1, max_size=4))
def test_runs_equal_brute_force(docs):
    assert P.runs(*numbered(docs)) == [brute_runs(d) for d in docs]


def test_long_periods_and_nested_runs():
    rng = np.random.default_rng(3)
    for q in (1, 2, 3, 4, 5, 8, 12, 13, 19, 20, 31, 46, 47, 200, 999):
        root = rng.integers(0, 10**6, q).tolist()
        for length in (4 * q - 1, max(6, 4 * q), 5 * q + q // 2):
            doc = ["p", *(root * 7)[:length], "z"]
            assert P.runs(*numbered([doc]))[0] == ([(1, length, q)] if length >= max(6, 4 * q) else [])
    fib = ["a", "ab"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    assert P.runs(*numbered([fib[-1], "a" * 3000, (("ab" * 5 + "c") * 5)])) == [brute_runs(fib[-1]), [(0, 3000, 1)], brute_runs(("ab" * 5 + "c") * 5)]


def test_period_classes_guarantee_their_grams():
    seen = 0
    for a, b, k in P.period_classes(10**6):
        assert a == seen + 1 and k >= 2 * b - 2 and k == min(max(6, 4 * q) - q for q in range(a, b + 1))
        seen = b
    assert seen >= 10**6 // 4


def expected(folder):
    for i, t in documents(folder):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
        runs = P.runs(*numbered([w]))[0] if n > 600 else brute_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        gone = {x for s, ln, q in runs for x in range(s + q, s + ln)}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        yield (
            i, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
            sha("".join(f"{s},{ln},{q}\n" for s, ln, q in runs)), sha(" ".join(x for j, x in enumerate(w) if j not in gone)),
        )


@pytest.mark.parametrize("which", ["given", "awkward", "empty"])
def test_query(spark, folder, empty, which):
    d = {"given": SF, "awkward": folder, "empty": empty}[which]
    got = [tuple(r) for r in P.op12_periodic_runs(spark, d).collect()]
    order = lambda r: tuple((x is None, x or 0) for x in r[:2]) + (r[6], r[7])
    assert sorted(got, key=order) == sorted(expected(d), key=order)


def test_operator_keeps_spans_and_text(spark):
    rows = [(1, "x a b a b a b a b y", 5, "s"), (None, None, 6, "t"), (1, "", 7, "u")]
    got = P.find_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string")).collect()
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [
        (1, 10, [(1, 8, 2)], "x a b y"), (None, 0, [], ""), (1, 0, [], "")]
