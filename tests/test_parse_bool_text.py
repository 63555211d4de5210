import duckdb

import __spark_entry__ as E
from ledgerlake.plans.metric_catalog import BOOL_TEXTS
from tests.conftest import SF_SMALL


def test_whole_texts_are_parsed_and_match_duckdb(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{SF_SMALL}/orders.parquet'")
    got = {r.o_orderkey: r.is_true for r in E.queries()["parse_bool_text"](spark, SF_SMALL).collect()}
    assert got == dict(con.sql(E.oracle_sql()["parse_bool_text"]).fetchall())
    rows = con.sql("SELECT o_orderkey, o_custkey FROM orders").fetchall()
    truthy = {"true", "1", "yes", "y", "t"}
    for key, cust in rows:
        want = {0: cust % 2 == 0, 1: BOOL_TEXTS[cust % len(BOOL_TEXTS)].strip().lower() in truthy}.get(key % 4, False)
        assert got[key] == want
    assert {key % 4 for key, _ in rows} == {0, 1, 2, 3}
