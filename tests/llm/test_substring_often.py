"""Anchors too frequent for one task are folded by an aggregate, with equal results."""

from collections import Counter

import pytest

from ledgerlake.llm import common as C, substring_dedup
from tests.llm.test_operators import brute_removed


@pytest.mark.parametrize("often_rows", [1, 40, 1 << 20])
def test_frequent_anchors(spark, monkeypatch, often_rows):
    C.prepare(spark)
    monkeypatch.setattr(substring_dedup, "SEEN", 2)
    line = "one common line that stands in a third of all the documents we have here today "
    rows = [(i, f"{i} {line * (i % 3 == 0)} tail {i % 7} of document {i} with words of its own {i * i} {line[: 40 + i % 9]}") for i in range(240)]
    rows += [(1000 + i, "the same text in many rows, with enough words for a window of thirteen of them") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.dedup(df, hot=3, shard_words=500, often_rows=often_rows).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == Counter((i, n, g, k.decode()) for i, n, g, k in brute_removed(rows))
