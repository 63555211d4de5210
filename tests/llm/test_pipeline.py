"""The pipeline's stages against brute-force versions, each on its own input."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from ledgerlake.llm import bpe, common as C, mixing, quality_classifier, simhash
from tests.llm.tables import SF
from tests.llm.test_operators import PERSONAL, brute_classes, brute_spans


@pytest.fixture(scope="module", params=["folder", "sf"])
def steps(request, spark, folder):
    """The documents before the first and after each stage, and the data folder."""
    d = folder if request.param == "folder" else SF
    out = [C.table(spark, d, "documents")]
    for name, f in corpus_pipeline.STAGES:
        out.append(C.stage(f(spark, out[-1], d), "test"))
    return d, out


def test_columns(steps):
    _, out = steps
    assert all(o.columns == out[0].columns for o in out[1:-1])
    assert out[-1].columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "BPE encoding and decoding"


def test_quality_stage(spark, steps):
    d, out = steps
    model = quality_classifier.train(out[0], C.table(spark, d, "labels"))
    want = Counter(tuple(r) for r in out[0].collect() if model.score((r.text or "").encode()) >= 0.5)
    assert Counter(tuple(r) for r in out[1].collect()) == want


def test_simhash_stage(steps):
    _, out = steps
    rows = out[1].collect()
    classes = brute_classes([simhash.simhash((r.text or "").encode()) for r in rows], list(range(len(rows))))
    least = {}
    for c, r in zip(classes, rows):
        i = (1 << 63) - 1 if r.doc_id is None else r.doc_id
        least[c] = min(least.get(c, i), i)
    assert Counter((1 << 63) - 1 if r.doc_id is None else r.doc_id for r in out[2].collect()) == Counter(least.values())
    assert not {tuple(r) for r in out[2].collect()} - {tuple(r) for r in rows}


def test_pii_stage(steps):
    _, out = steps
    before, after = {r.doc_id: r for r in out[2].collect()}, {r.doc_id: r for r in out[3].collect()}
    assert before.keys() == after.keys()
    for i, r in before.items():
        spans = brute_spans(r.text or "", PERSONAL)
        assert after[i].n_chars == (None if r.text is None else len(after[i].text))
        if not spans and not re.search("IBAN|SSN", r.text or ""):
            assert after[i].text == r.text
        for a, _, b, _k in spans:
            assert r.text[a:b] not in after[i].text


def test_mixing_stage(spark, steps):
    _, out = steps
    want = Counter()
    for r in mixing.mix(mixing.sized(out[3]))[0].collect():
        if r.taken:
            want[r.doc_id] += r.taken // r.size
    assert Counter(r.doc_id for r in out[4].collect()) == want
    assert {tuple(r) for r in out[4].collect()} <= {tuple(r) for r in out[3].collect()}


def test_bpe_stage(steps):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    _, out = steps
    want = Counter((r.doc_id, tuple(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in out[4].collect())
    rows = out[5].collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
    assert all(r.decoded == lib.decode(r.ids, skip_special_tokens=False) for r in rows)


def test_run_drops_what_it_staged(spark):
    before = C.staged()
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 500 and len(C.staged()) == len(before) + 1
    assert np.all([len(r.ids) == r.n_tokens for r in got.limit(50).collect()])
