"""Spellings and layouts that real files bring."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import scalars as S
from ledgerlake.sources import files as IO
from ledgerlake.sources import tables as T
from tests.conftest import SF_SMALL

MARCH_5 = dt.datetime(2024, 3, 5)
DATES = {
    "2024-3-5": MARCH_5, "2024/3/5": MARCH_5, "2024.03.05": MARCH_5, "2024-03-05 10:00": dt.datetime(2024, 3, 5, 10),
    "2024-03-05 10:00:00.123": dt.datetime(2024, 3, 5, 10), "2024-03-05T10:00:00Z": dt.datetime(2024, 3, 5, 10),
    "2024/03/05 10:00:00": dt.datetime(2024, 3, 5, 10), "03/05/2024 14:30": dt.datetime(2024, 3, 5, 14, 30), "03/05/24": MARCH_5,
    "5-Mar-2024": MARCH_5, "Mar 5 2024": MARCH_5, "March 5 2024": MARCH_5, "Sept 5, 2024": dt.datetime(2024, 9, 5), "05 March, 2024": MARCH_5,
    "5th March 2024": MARCH_5, "Tue, 05 Mar 2024": MARCH_5, "Mar-2024": dt.datetime(2024, 3, 1), "2024-03": dt.datetime(2024, 3, 1),
    "3/2024": dt.datetime(2024, 3, 1), "2024-13-40": None, "abc": None, "": None, None: None, "31/12/2024": dt.datetime(2024, 12, 31),
    "\t2024-03-05\u00a0": MARCH_5,
}


def test_dates_of_many_spellings(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "s string")
    got = {r.s: r.d for r in df.select("s", S.parse_mixed_date("s").alias("d")).collect()}
    assert {k: v for k, v in got.items() if v != DATES[k]} == {}


def test_white_space_of_any_kind_is_stripped(spark):
    row = spark.range(1).select(
        S.clean_numeric(F.lit("\u00a0(500)")).alias("n"), S.parse_bool(F.lit("\ttrue")).alias("b"),
        S.normalize_status(F.lit("DONE\t")).alias("s"), S.normalize_region(F.lit("\tEMEA")).alias("r"),
    ).first()
    assert (row.n, row.b, row.r) == (-500.0, True, "EMEA")


@pytest.mark.parametrize("name, want", [("orderDate", "order_date"), (" Order ID ", "order_id"), ("a--b__C9x", "a_b_c9x"), ("discountRate%", "discount_rate"), ("ABCDef", "abcdef"), ("x1Y", "x1_y")])
def test_snake_case(name, want):
    assert S.snake_case(name) == want


def test_csv_round_trip_with_quotes(spark, tmp_path):
    rows = [("He said \"hi\", ok", "a\\b"), ("x,y", "")]
    path = str(tmp_path / "q")
    IO.write_csv(spark.createDataFrame(rows, "orderId string, note string"), path)
    text = "".join(p.read_text() for p in (tmp_path / "q").glob("part-*"))
    assert '"He said ""hi"", ok"' in text
    got = {r.note_ for r in IO.read_raw_sales(spark, path).select(F.col("orderId").alias("note_")).collect()}
    assert got == {"He said \"hi\", ok", "x,y"}


def test_every_warehouse_file_is_in_date_order(spark, tmp_path):
    path = str(tmp_path / "wh")
    IO.load_warehouse(T.sales(spark, SF_SMALL), path)
    import pyarrow.parquet as pq

    for f in (tmp_path / "wh").rglob("*.parquet"):
        days = pq.ParquetFile(f).read(columns=["order_date"])["order_date"].to_pylist()
        assert days == sorted(days)


def test_appended_files_are_seen(spark, tmp_path):
    folder = str(tmp_path / "region.parquet")
    spark.range(3).coalesce(1).write.parquet(folder)
    assert T.read_table(spark, str(tmp_path), "region").count() == 3
    spark.range(5).coalesce(1).write.mode("append").parquet(folder)
    assert T.read_table(spark, str(tmp_path), "region").count() == 8
