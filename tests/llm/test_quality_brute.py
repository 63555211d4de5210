"""Measures, bands and verdicts of the quality rules against a plain computation."""

import math
from collections import Counter

import pytest
import sentencepiece

from ledgerlake.llm import common as C, quality_rules as Q
from tests.llm.tables import SF, documents


@pytest.fixture(params=["folder", "sf"])
def data(request, folder):
    return folder if request.param == "folder" else SF


def brute_measures(sp, text):
    words = (text or "").encode().split()
    ids = [i for w in words for i in sp.encode(w.decode("utf-8", "replace"))]
    if not ids:
        return 0.0, 0.0, 0.0
    n, kinds = len(ids), Counter(ids)
    entropy = -sum(k / n * math.log2(k / n) for k in kinds.values())
    most = math.log2(min(n, sp.get_piece_size()))
    return sum(len(w.decode()) for w in words) / n, sum(sp.is_byte(i) for i in ids) / n, entropy / most if most else 1.0


def brute_band(values, const, share, width=3.0):
    cells = sorted(math.floor(v * Q.GRID) for v in values)
    q1, q2, q3 = [cells[math.ceil(k * len(cells) / 4) - 1] / Q.GRID for k in (1, 2, 3)]
    beyond = max(width * (q3 - q1), const + share * q2)
    return q1 - beyond, q3 + beyond


def test_measures(spark, data):
    sp = sentencepiece.SentencePieceProcessor(model_file=Q.default_path())
    want = Counter((i, *(round(x, 9) for x in brute_measures(sp, t))) for i, t in documents(data))
    got = Counter((r[0], *(round(x, 9) for x in r[1:])) for r in Q.measure(C.table(spark, data, "documents")).select("doc_id", *Q.MEASURES).collect())
    differ = sorted((want - got).keys(), key=str), sorted((got - want).keys(), key=str)
    assert len(differ[0]) == len(differ[1])
    assert all(a[0] == b[0] and all(abs(x - y) < 1e-6 for x, y in zip(a[1:], b[1:])) for a, b in zip(*differ))


def test_verdicts(spark, data):
    measured = C.stage(Q.measure(C.table(spark, data, "documents")), "test")
    rows = Q.judge(measured).collect()
    assert len(rows) == measured.count()
    texts = {}  # lang -> distinct text -> measures
    for r in rows:
        if not r.base_failed:
            for lang in {r.lang, "*"} - {None}:
                texts.setdefault(lang, {})[bytes(r.text_hash)] = [r[m] for m in Q.MEASURES]
    bands = {x: [brute_band([v[i] for v in t.values()], *Q.LEAST[m]) for i, m in enumerate(Q.MEASURES)] for x, t in texts.items()}
    if not texts:
        assert not any(r.kept for r in rows)
        return
    for r in rows:
        weight = len(texts[r.lang]) / (len(texts[r.lang]) + 10) if r.lang in texts else 0.0
        inside = True
        for i, m in enumerate(Q.MEASURES):
            own, whole = bands.get(r.lang, bands["*"])[i], bands["*"][i]
            low, high = [weight * a + (1 - weight) * b for a, b in zip(own, whole)]
            more = 0.5 / math.sqrt(max(r.n_words, 1))
            inside = inside and low - more <= r[m] <= high + more
        assert r.kept == (inside and not r.base_failed), r


def test_reruns_and_partitions_agree_and_no_size_is_a_switch(spark):
    measured = C.stage(Q.measure(C.table(spark, SF, "documents").repartition(13)), "test")
    first = {(r.doc_id, r.kept) for r in Q.judge(measured).select("doc_id", "kept").collect()}
    assert first == {(r.doc_id, r.kept) for r in Q.judge(measured.repartition(3, "n_words")).select("doc_id", "kept").collect()}
    # a language of a single odd text does not make its own band
    odd = measured.where("not n_words < 50").limit(1).selectExpr("-1L AS doc_id", "'xx' AS lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "0L AS n_repeat_words", "0.9D AS chars_per_token", "0.95D AS byte_share", "0.1D AS entropy", "unhex('ff') AS text_hash")
    assert [r.kept for r in Q.judge(measured.unionByName(odd)).where("doc_id = -1").collect()] == [False]
