"""The trigram index gives what the plain search gives, for substrings of every length."""

import pytest

from ledgerlake.operators import metrics as M
from ledgerlake.operators import search as X

NAMES = ["Ada Lovelace", "ADA 50%_off\\", "aaaa", "aaa", "aa", "a", "", None, "Élodie Çelik", "ÉLODIE", "Jo\nLine", "naïve 😀😀😀 name", "İstanbul", "abcabcabc", "Customer#000000012"]


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    rows = [(str(i), n) for i, n in enumerate(NAMES * 2)] + [("0", NAMES[0])] * 3
    df = spark.createDataFrame(rows, "customer_id string, customer_name string")
    path = str(tmp_path_factory.mktemp("index"))
    X.write_search_index(df, path)
    return df, path


@pytest.mark.parametrize("q", [None, "", "  ", "a", "aa", "aaa", "aaaa", "ADA", "ada l", "50%_", "%_o", "f\\", "off\\", "élodie", "ÇELIK", "o\nl", "😀😀", "😀😀😀", "😀😀😀 n", "stanbul", "bcabca", "#000000012", "nobody", "ada lovelace", "ada lovelacex"])
def test_index_equals_the_plain_search(spark, customers, q):
    df, path = customers
    want = [tuple(r) for r in M.customer_search(df, q).collect()]
    assert [tuple(r) for r in X.search_indexed(spark, path, q).collect()] == want


def test_only_postings_of_the_text_are_read(spark, customers):
    plan = X.search_indexed(spark, customers[1], "lovelace")._jdf.queryExecution().executedPlan().toString()
    assert "postings" in plan and "In(tri, [ace,ela,lac,lov,ove,vel])" in plan and "/names" not in plan


def test_no_customers(spark, tmp_path):
    empty = spark.createDataFrame([], "customer_id string, customer_name string")
    X.write_search_index(empty, str(tmp_path / "i"))
    assert X.search_indexed(spark, str(tmp_path / "i"), "abc").count() == X.search_indexed(spark, str(tmp_path / "i"), "").count() == 0
