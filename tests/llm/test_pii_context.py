"""Context words count only as whole words; names of the tables' own stay untouched."""

import pytest

from ledgerlake.llm import common as C, pii, secret_scan


@pytest.mark.parametrize("text, kind, score", [
    ("we ship goods to 10.0.0.1 today", "ip", 0.6),
    ("its IP 10.0.0.1 today", "ip", 1.0),
    ("both hosts: 10.0.0.1", "ip", 1.0),
    ("hotel +1 415 555 0134", "phone", 0.6),
    ("Tel. +1 415 555 0134", "phone", 1.0),
    ("+1 415 555 0134 mobile", "phone", 1.0),
    ("x" * 39 + "tel +1 415 555 0134", "phone", 0.6),
    ("tel" + " " * 37 + "+1 415 555 0134", "phone", 1.0),
    ("hotel" + " " * 37 + "+1 415 555 0134", "phone", 0.6),
    ("tel" + " " * 50 + "+1 415 555 0134", "phone", 0.6),
    ("+1 415 555 0134" + " " * 37 + "tel", "phone", 1.0),
    ("+1 415 555 0134" + " " * 37 + "telling", "phone", 0.6),
])
def test_whole_words_raise_the_score(spark, text, kind, score):
    C.prepare(spark)
    (r,) = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(f.kind, round(f.score, 6)) for f in r.findings] == [(kind, score)]


def test_columns_of_clashing_names_are_kept(spark):
    C.prepare(spark)
    schema = "doc_id long, text string, _pii_text string, _PII_spans int, _key string, _secret_key string, rules int, _rules int, _found string"
    row = (1, "mail a@b.co token=abcdefgh1", "mine", 2, "k", "s", 3, 4, "f")
    df = spark.createDataFrame([row], schema)
    (r,) = pii.find_pii(df).collect()
    assert tuple(r)[:-1] == row and [f.kind for f in r.findings] == ["email"]
    (r,) = secret_scan.scan(df, secret_scan.BASE).collect()
    assert tuple(r)[: len(row)] == row and len(r["assign"]) == 1
    (r,) = pii.redact_stage(spark, df, "").collect()
    assert r.text == "mail <EMAIL> token=abcdefgh1" and tuple(r)[2:] == row[2:]


def test_more_rules_than_bits(spark):
    C.prepare(spark)
    kinds = [secret_scan.S.Kind(f"k{i}", f"needle{i:03d}x") for i in range(80)]
    df = spark.createDataFrame([(1, "a needle075x and needle003x"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: [k.name for k in kinds if r[k.name]] for r in secret_scan.scan(df, kinds).collect()}
    assert got == {1: ["k3", "k75"], 2: []}
