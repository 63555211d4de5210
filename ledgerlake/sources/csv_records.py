"""CSV records with line breaks inside quoted fields, read in parallel splits.

A split of a file cannot know whether it begins inside a quoted field, so it is
read for both cases at once. Plan:

1. The lines of each split pass through once, in order. Each line gets its
   number in the split and, for either state at the split's start, whether it
   begins and ends inside quotes and how many records begin before it. Only
   lines with a quote character cost Python time. The lines are staged, so all
   later steps see the same splits.
2. One row per split remains: how it maps the state at its start to the state
   at its end, and its number of records. Prefix sums over a file's splits (a
   row for every 128 MB or so) give each split's true state and first record
   number, and a prefix sum over files gives every record a number of its own.
3. Lines that are whole records are parsed where they are. Only lines of
   records with a break in them meet by record number and are put together.

A gzip file is always one split, whatever the settings: its records are put together in
the task that reads it, nothing is staged, and records are only counted beforehand where
their numbers are asked for.

A record's number is exact, counts the data rows of all files in path order from
0, and depends neither on split sizes nor on the order in which paths are given.
Fields are read as the common CSV dialect reads them: a field is quoted if its
first character is a quote; two quotes in it stand for one; what follows the
closing quote up to the comma is kept as it is; quotes elsewhere are plain
characters. Lines end in LF or CR LF; blank lines are skipped; a byte order mark
is dropped. A file that ends inside quotes, headers that differ between files,
and records with more fields than the header fail the read; missing fields at a
record's end are null.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize

_LINES = "file string, block long, n long, line string, in0 boolean, in1 boolean, out0 boolean, out1 boolean, rec0 long, rec1 long"


def _closes(piece: str) -> bool:
    """Whether text inside quotes holds the closing quote: one that is not doubled."""
    return '"' in piece.replace('""', "")


def line_states(line: str) -> tuple[bool, bool]:
    """Whether a line ends inside quotes if it begins outside, and if it begins inside."""
    ends = []
    for inside in (False, True):
        for piece in line.split(","):
            inside = not _closes(piece) if inside else piece.startswith('"') and not _closes(piece[1:])
        ends.append(inside)
    return ends[0], ends[1]


def _speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, block, line) in order -> rows of _LINES."""
    at, number, state, records = None, 0, [False, True], [0, 0]
    for b in batches:
        files, blocks, lines = b.column(0), b.column(1).to_numpy(), b.column(2)
        changed = np.flatnonzero((np.diff(blocks, prepend=-1) != 0) | np.append(True, pc.not_equal(files.slice(1), files.slice(0, len(files) - 1)).to_numpy(zero_copy_only=False)))
        for lo, hi in zip(changed, [*changed[1:], len(blocks)]):
            if (files[lo].as_py(), blocks[lo]) != at:
                at, number, state, records = (files[lo].as_py(), blocks[lo]), 0, [False, True], [0, 0]
            part = lines.slice(lo, hi - lo)
            n = hi - lo
            ends = {j: line_states(part[j].as_py()) for j in np.flatnonzero(pc.match_substring(part, '"').to_numpy(zero_copy_only=False))}
            blank = pc.is_in(part, value_set=pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
            begin, rec = [], []
            for h in (0, 1):
                inside, done = np.empty(n + 1, bool), 0
                for j, end in ends.items():
                    inside[done : j + 1] = state[h]
                    state[h], done = end[state[h]], j + 1
                inside[done:] = state[h]
                starts = np.cumsum(~inside[:-1] & ~blank)
                begin.append(inside)
                rec.append(records[h] + np.append(0, starts[:-1]))
                records[h] += int(starts[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    files.slice(lo, n), b.column(1).slice(lo, n), pa.array(np.arange(number, number + n)), part, pa.array(begin[0][:-1]), pa.array(begin[1][:-1]),
                    pa.array(begin[0][1:]), pa.array(begin[1][1:]), pa.array(rec[0]), pa.array(rec[1]),
                ],
                names=["file", "block", "n", "line", "in0", "in1", "out0", "out1", "rec0", "rec1"],
            )
            number += n


def _blocks(lines: DataFrame) -> DataFrame:
    """Per split: its true state at the start, the number of its first record in the whole
    input, and whether it leaves the file open."""
    is_start = lambda i: ((~F.col(f"in{i}")) & ~F.col("line").isin("", "\r")).cast("long")
    last = F.max_by(F.struct("out0", "out1", (F.col("rec0") + is_start(0)).alias("n0"), (F.col("rec1") + is_start(1)).alias("n1")), "n")
    maps = lines.groupBy("file", "block").agg(last.alias("e")).select("file", "block", "e.*")
    same, swaps = F.col("out0") == F.col("out1"), F.col("out0") & ~F.col("out1")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    maps = maps.withColumn("swaps", F.sum(swaps.cast("int")).over(order))
    fixed = F.last(F.when(same, F.struct("out0", "swaps")), ignorenulls=True).over(before)
    turns = F.coalesce(F.max("swaps").over(before), F.lit(0))
    odd = lambda c: c % 2 == 1
    inside = F.when(fixed.isNotNull(), fixed["out0"] != odd(turns - fixed["swaps"])).otherwise(odd(turns))
    maps = maps.withColumn("inside", inside)
    maps = maps.select("file", "block", "inside", F.when(F.col("inside"), F.col("out1")).otherwise(F.col("out0")).alias("open"), F.when(F.col("inside"), F.col("n1")).otherwise(F.col("n0")).alias("n"))
    maps = maps.select("*", (F.sum("n").over(order) - F.col("n")).alias("in_file"))
    # a row per file; the header, each file's first record, is not counted
    files = maps.groupBy("file").agg((F.sum("n") - 1).alias("n"), F.max_by("open", "block").alias("left_open"))
    files = files.select("file", "left_open", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("earlier"))
    return maps.join(files, "file").select("file", "block", "inside", "left_open", "in_file", "earlier")


def fields(record: Column) -> Column:
    """The fields of one record, unquoted."""
    closes = lambda t: F.replace(t, F.lit('""'), F.lit("")).contains('"')
    tail = lambda t: F.substring(t, F.lit(2), F.length(t))

    def unquoted(t: Column) -> Column:
        body = tail(t)
        inner = F.substring(body, F.lit(1), F.length(body) - 1)
        usual = body.endswith('"') & ~closes(inner)
        parts = [F.regexp_extract(body, r'(?s)^([^"]*+(?:""[^"]*+)*+)"(.*)$', i) for i in (1, 2)]
        plain = lambda x: F.replace(x, F.lit('""'), F.lit('"'))
        return F.when(~t.startswith('"'), t).when(usual, plain(inner)).otherwise(F.concat(plain(parts[0]), parts[1]))

    def step(acc: Column, piece: Column) -> Column:
        text = F.concat(F.coalesce(F.concat(acc["open"], F.lit(",")), F.lit("")), piece)
        still = F.when(acc["open"].isNull(), piece.startswith('"') & ~closes(tail(piece))).otherwise(~closes(piece))
        return F.struct(F.when(still, acc["done"]).otherwise(F.array_append(acc["done"], unquoted(text))).alias("done"), F.when(still, text).alias("open"))

    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))
    quoted = F.aggregate(F.split(record, ","), empty, step, lambda a: a["done"])
    return F.when(record.contains('"'), quoted).otherwise(F.split(record, ","))


def _never_closed(file: str) -> str:
    return f"a quoted field is never closed in {file}"


#: A line that begins and ends outside quotes, as nearly all lines with quotes do.
_CLOSED = r'^(?:[^",]*|"[^"]*")(?:,(?:[^",]*|"[^"]*"))*$'


def _whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[int], list[str], pa.Array]]:
    """Lines (file, line) of whole files in order -> pieces (file, number of the first record,
    ends, records with a break in them, lines): ``ends`` are the numbers of the lines, of those
    given, that are records, or -1 - i for the i-th of the records put together."""
    at, number, open_lines = None, 0, []
    for b in batches:
        files, lines = b.column(0), b.column(1)
        changed = np.flatnonzero(np.append(True, pc.not_equal(files.slice(1), files.slice(0, len(files) - 1)).to_numpy(zero_copy_only=False))) if len(files) else []
        for lo, hi in zip(changed, [*changed[1:], len(files)]):
            if (file := files[lo].as_py()) != at:
                if open_lines:
                    raise ValueError(_never_closed(at))
                at, number = file, 0
            part = lines.slice(lo, hi - lo)
            blank = pc.is_in(part, value_set=pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
            quoted = np.flatnonzero(pc.match_substring(part, '"').to_numpy(zero_copy_only=False))
            with_quotes = part.take(pa.array(quoted, pa.int64()))
            usual = pc.match_substring_regex(with_quotes, _CLOSED).to_pylist()
            ends, broken, done = [], [], 0
            for i, j in enumerate(quoted.tolist()):
                if usual[i] and not open_lines:
                    continue
                line = with_quotes[i].as_py()
                if open_lines:
                    open_lines += part.slice(done, j - done).to_pylist()
                else:
                    ends.append(done + np.flatnonzero(~blank[done:j]))
                if line_states(line)[bool(open_lines)]:
                    open_lines.append(line)
                elif open_lines:
                    broken.append("\n".join([*open_lines, line]))
                    ends.append(np.array([-len(broken)]))
                    open_lines = []
                else:
                    ends.append(np.array([j]))
                done = j + 1
            if open_lines:
                open_lines += part.slice(done).to_pylist()
            else:
                ends.append(done + np.flatnonzero(~blank[done:]))
            ends = np.concatenate(ends) if ends else np.empty(0, np.int64)
            yield at, number, ends, broken, part
            number += len(ends)
    if open_lines:
        raise ValueError(_never_closed(at))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of whole files -> (file, number of data records)."""
    counts: dict[str, int] = {}
    for file, number, ends, _, _ in _whole_records(batches):
        counts[file] = number + len(ends) - 1
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["file", "n"])


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a whole file -> its first record; the rest is not read."""
    for _, _, ends, broken, part in _whole_records(batches):
        if len(ends):
            first = part[int(ends[0])].as_py() if ends[0] >= 0 else broken[0]
            yield pa.RecordBatch.from_arrays([pa.array([first])], names=["line"])
            return


def _bare(record: str) -> str:
    """A record without a byte order mark and the end of CR LF."""
    return record.removeprefix("\ufeff").removesuffix("\r")


def _quoted_fields(record: str) -> list[str] | None:
    """The fields of a record with quotes; None where the csv module might not read as ``fields`` does."""
    if "\r" in record or "\0" in record or len(record) >= csv.field_size_limit():
        return None
    return next(csv.reader([record]))


def _numbered(first: str, header: list[str]):
    """Lines of whole files -> (file, rec, line, parsed) of all data records. ``first`` is the
    first file's first record, ``header`` the names in it: other files must have the same."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, before, ends, broken, part in _whole_records(batches):
            rec = np.arange(before, before + len(ends))
            if broken:
                part = pa.concat_arrays([part, pa.array(broken, pa.string())])
                ends = np.where(ends < 0, len(part) - len(broken) - 1 - ends, ends)
            lines = part if len(ends) == len(part) else part.take(pa.array(ends, pa.int64()))
            if before == 0 and len(rec):
                head = _bare(lines[0].as_py())
                names = _quoted_fields(head) if '"' in head else head.split(",")
                if head != _bare(first) and names != header:
                    raise ValueError(f"the files' headers differ: {header} and {names or head}")
                lines, rec = lines.slice(1), rec[1:]
            quoted = pc.match_substring(lines, '"')
            parsed = map(_quoted_fields, lines.filter(quoted).to_pylist())
            parsed = pa.array([next(parsed) if q else None for q in quoted.to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(lines), pa.string()), pa.array(rec), lines, parsed], names=["file", "rec", "line", "parsed"])

    return number


def _the_header(heads: list, paths: list[str]) -> list[str]:
    if not heads:
        raise ValueError("there is no header in " + ", ".join(paths))
    if len(heads) > 1:
        raise ValueError(f"the files' headers differ: {heads[0].h} and {heads[1].h}")
    return list(heads[0].h)


def _read_whole_files(lines: DataFrame, paths: list[str], written: list[str] | None, unnumbered: str | None) -> tuple[DataFrame, list[str]]:
    """:func:`read_records` for lines (file, line) of files that are one split each."""
    cr = F.col("line").endswith("\r")
    line = F.when(cr, F.substring("line", F.lit(1), F.length("line") - 1)).otherwise(F.col("line"))
    heads: list = []
    for file in sorted(lines.inputFiles()):  # the first, if it holds a record at all
        of_file = lines.where(F.col("file").isin(file, file.replace(":///", ":/", 1))).mapInArrow(_first, "line string")
        if heads := of_file.select("line", fields(F.regexp_replace(line, "^﻿", "")).alias("h")).collect():
            break
    header = _the_header(heads, paths)
    parsed = lines.mapInArrow(_numbered(heads[0].line, header), "file string, rec long, line string, parsed array<string>")
    row = F.lit(None).cast("long")
    if unnumbered not in header:
        counts = materialize(lines.mapInArrow(_counted, "file string, n long"), "csv-files", written)  # a row per file
        earlier = counts.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("earlier"))
        parsed, row = parsed.join(F.broadcast(earlier), "file"), F.col("earlier") + F.col("rec") - 1
    surplus = F.raise_error(F.concat(F.lit(f"more than {len(header)} fields in data row "), F.col("rec").cast("string"), F.lit(" of "), F.col("file")))
    rows = parsed.select(row.alias("row"), "rec", "file", F.coalesce("parsed", fields(line)).alias("fields"))
    return rows.select("row", "file", F.when(F.size("fields") > len(header), surplus.cast("array<string>")).otherwise(F.col("fields")).alias("fields")), header


def read_records(spark: SparkSession, paths: list[str], written: list[str] | None = None, unnumbered: str | None = None) -> tuple[DataFrame, list[str]]:
    """(row, file, fields) of every data record, and the header's names.

    Tables staged in the shared folder have their paths added to ``written``: two, or for
    gzip files one with a row per file. The numbers of a header with the name ``unnumbered``
    may be NULL.
    """
    ensure_checkpoint_dir(spark)
    text = spark.read.option("lineSep", "\n").text(sorted(paths))
    if all(f.endswith(".gz") for f in text.inputFiles()):
        return _read_whole_files(text.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")), paths, written, unnumbered)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    lines = materialize(lines.mapInArrow(_speculate, _LINES), "csv-lines", written)
    blocks = materialize(_blocks(lines), "csv-splits", written)
    if bad := blocks.where("left_open").select("file").first():
        raise ValueError(_never_closed(bad.file))
    true = lambda i: F.when(F.col("inside"), F.col(f"{i}1")).otherwise(F.col(f"{i}0"))
    placed = lines.join(blocks, ["file", "block"]).select(
        "file", "block", "n", "line", true("in").alias("begins_in"), true("out").alias("ends_in"), "earlier", (true("rec") + F.col("in_file")).alias("rec")
    )
    whole = placed.where(~F.col("begins_in") & ~F.col("ends_in") & ~F.col("line").isin("", "\r")).select("file", "rec", "earlier", "line")
    pieces = placed.where(F.col("begins_in") | F.col("ends_in"))
    of = F.col("rec") - F.col("begins_in").cast("long")  # a later line of a record counts its start already
    joined = pieces.groupBy("file", of.alias("rec"), "earlier").agg(F.sort_array(F.collect_list(F.struct("block", "n", "line"))).alias("p"))
    joined = joined.select("file", "rec", "earlier", F.array_join("p.line", "\n").alias("line"))
    parsed = whole.unionByName(joined).select("file", "rec", "earlier", F.regexp_replace("line", r"\r$", "").alias("line"))
    heads = parsed.where("rec = 0").select(fields(F.regexp_replace("line", "^﻿", "")).alias("h")).distinct().limit(2).collect()
    header = _the_header(heads, paths)
    rows = parsed.where("rec > 0").select((F.col("earlier") + F.col("rec") - 1).alias("row"), "file", fields(F.col("line")).alias("fields"))
    surplus = F.raise_error(F.concat(F.lit(f"more than {len(header)} fields in data row "), F.col("row").cast("string"), F.lit(" of the files up to "), F.col("file")))
    checked = F.when(F.size("fields") > len(header), surplus.cast("array<string>")).otherwise(F.col("fields"))
    return rows.select("row", "file", checked.alias("fields")), header
