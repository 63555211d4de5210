"""CSV records against the csv module: breaks in quoted fields, cut at many split sizes."""

import csv
import gzip
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.operators import cleaning as C
from ledgerlake.sources import csv_records as R
from ledgerlake.sources import files as IO

HEADER = "OrderID,Region,Note"
AWKWARD = [
    ["1", "EMEA", "plain"], ["2", "a\nb", 'say "hi", ok'], ["3", "", "x\r\ny\r\n\r\nz"], ["4", ",\n,\n", '"'], ["5", "\n\n\n", '""\n""'],
    ["6", "né 😀", "\t"], ["7", '5" pipe', "a,b"], ["8", "N/A", "long " * 40 + "\n" + "tail," * 30], ["9", "x", '"\n"'],
]


def rendered(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def read(spark, paths, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows, header = R.read_records(spark, paths)
        return header, [(r.row, r.fields) for r in sorted(rows.collect(), key=lambda r: r.row)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("split", [61, 250, 10**6])
def test_equal_to_the_csv_module_at_every_split_size(spark, tmp_path, split):
    text = HEADER + "\n" + rendered(AWKWARD) + "\n\n" + rendered(AWKWARD[::-1], "\r\n") + '10,5" pipe,"closed"then more\n11,"" odd,short\n12,z\n'
    (tmp_path / "raw.csv").write_bytes(("﻿" + text).encode())
    want = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    header, got = read(spark, [str(tmp_path / "raw.csv")], split)
    assert header == want[0] and got == list(enumerate(want[1:]))


def test_row_numbers_depend_on_neither_splits_nor_path_order(spark, tmp_path):
    names = ["b.csv", "a.csv", "c.csv"]
    for k, name in enumerate(names):
        rows = [[f"{name}-{i}", "x\ny" if i % 3 == k else "x", str(i)] for i in range(40)]
        (tmp_path / name).write_text(HEADER + "\n" + rendered(rows))
    paths = [str(tmp_path / n) for n in names]
    want = [f"{n}-{i}" for n in sorted(names) for i in range(40)]
    for order, split in ((paths, 150), (paths[::-1], 400), (paths, 10**6)):
        got = read(spark, order, split)[1]
        assert [f[0] for _, f in got] == want and [n for n, _ in got] == list(range(120))


def test_positions_are_numbers(spark, tmp_path):
    """Row 9 stands before row 10, also when a tie is decided by the position."""
    rows = [["X", "EMEA", "n"] if i in (9, 10) else [str(i), "EMEA", "n"] for i in range(12)]
    (tmp_path / "raw.csv").write_text("OrderID,Region,Note\n" + rendered(rows))
    df = IO.read_raw_sales(spark, str(tmp_path / "raw.csv"))
    assert dict(df.dtypes)["_source_pos"] == "bigint"
    std = C.snake_case_columns(df)
    assert {r.order_id: r._keep_pos for r in C.dedup_winners(std).collect()}["X"] == 9


@pytest.mark.parametrize("body, says", [("1,a,b,c\n", "more than 3 fields"), ('1,"a,b\n2,c,d\n', "never closed"), ('1,"a\nb",c,\n', "more than 3 fields")])
def test_bad_files_fail_the_read(spark, tmp_path, body, says):
    (tmp_path / "raw.csv").write_text(HEADER + "\n" + body)
    with pytest.raises(Exception, match=says):
        IO.read_raw_sales(spark, str(tmp_path / "raw.csv")).collect()


def test_headers_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "\n1,2,3\n")
    (tmp_path / "b.csv").write_text("OrderID,Note,Region\n1,2,3\n")
    with pytest.raises(ValueError, match="headers differ"):
        IO.read_raw_sales(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])


def test_missing_tokens_and_short_records(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(HEADER + '\nN/A,"",x\n1\n')
    got = [tuple(r) for r in IO.read_raw_sales(spark, str(tmp_path / "raw.csv")).orderBy("_source_pos").collect()]
    assert got == [(None, None, "x", 0), ("1", None, None, 1)]


@settings(max_examples=200, deadline=None)
@given(st.text('a,"\r', max_size=14), st.booleans())
def test_states_of_a_line_follow_the_csv_module(line, inside):
    """A line that ends inside quotes takes the next line into its record."""
    head = '"' if inside else ""
    records = list(csv.reader(io.StringIO(head + line.replace("\r", "r") + "\nNEXT\n", newline="")))
    joined = any("\nNEXT" in f for r in records for f in r)
    assert R.line_states(line.replace("\r", "r"))[inside] == joined


def zipped(path, text):
    path.write_bytes(gzip.compress(text.encode()))
    return str(path)


def test_gzip_files_equal_the_csv_module_without_staged_lines(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # records go on in the next batch
    try:
        tail = '10,5" pipe,"closed"then more\n11,"" odd,short\n12,z\n13,"""",""\n14,"x",\r\n'
        texts = [HEADER + "\n" + rendered(AWKWARD) + "\n\n" + rendered(AWKWARD[::-1], "\r\n") + tail, '"OrderID",Region,Note\r\n' + rendered(AWKWARD * 3), HEADER, ""]
        paths = [zipped(tmp_path / f"{n}.csv.gz", ("﻿" if n == "b" else "") + t) for n, t in zip("badc", texts)]
        want = [r for k in (1, 0, 3, 2) for r in [r for r in csv.reader(io.StringIO(texts[k], newline="")) if r][1:]]
        written = []
        rows, header = R.read_records(spark, paths, written)
        got = [(r.row, r.fields) for r in sorted(rows.collect(), key=lambda r: r.row)]
        assert header == HEADER.split(",") and got == list(enumerate(want))
        assert len(written) == 1 and spark.read.parquet(written[0]).columns == ["file", "n"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_gzip_rows_with_a_position_of_their_own_are_not_counted(spark, tmp_path):
    path, written = zipped(tmp_path / "raw.csv.gz", 'OrderID,_source_pos\n1,"a,1"\n2,b\n'), []
    assert {tuple(r) for r in IO.read_raw_sales(spark, path, written).collect()} == {("1", "a,1"), ("2", "b")} and not written


@pytest.mark.parametrize("bodies, says", [
    (["1,a,b,c\n"], "more than 3 fields"), (['1,"a,b\n2,c,d\n'], "never closed"), (['1,"a\nb",c,\n'], "more than 3 fields"),
    (['1,"a,b\n', "2,c,d\n"], "never closed"), (["1,2,3\n", "4,5,6\nOrderID,Note,Region"], "headers differ"),
])
def test_bad_gzip_files_fail_the_read(spark, tmp_path, bodies, says):
    heads = [HEADER, "OrderID,Note,Region" if says == "headers differ" else HEADER]
    paths = [zipped(tmp_path / f"{i}.csv.gz", f"{h}\n{b}") for i, (h, b) in enumerate(zip(heads, bodies))]
    with pytest.raises(Exception, match=says):
        IO.read_raw_sales(spark, paths).collect()
