import duckdb
import pytest

import __spark_entry__ as E
from ledgerlake.plans import catalog
from ledgerlake.sources.tables import TABLES
from tests.conftest import SF_SMALL

FAST = [
    "metric_series", "metric_comparison", "growth_breakdown", "margin_box", "orders_page", "top_transactions",
    "dimension_values", "clean_numeric", "parse_mixed_date", "canonical_region", "dedup_keep_fullest",
    "validate_rules", "sales_pipeline", "reason_counts", "audit_report", "gold_audit",
]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["period_start", "value"] and df.count() > 0


def test_every_query_has_an_oracle():
    # the optional training-data queries have tests of their own
    assert set(catalog.queries()) == set(catalog.oracle_sql()) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", FAST)
def test_query_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    sdf = E.queries()[name](spark, SF_SMALL)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    idx = [rel.columns.index(c) for c in sdf.columns]

    def norm(v):
        return float(v) if type(v).__name__ == "Decimal" else (tuple(v) if isinstance(v, list) else v)

    key = lambda r: tuple((x is None, str(x)) for x in r)
    srows = sorted((tuple(norm(x) for x in r) for r in sdf.collect()), key=key)
    drows = sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=key)
    assert srows == drows
