"""Spans of pattern matches, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, a test on the matched text, and one on the whole
    text that is true whenever the pattern can match at all (None: always look). A
    kind whose spans are not just the pattern's matches has a ``find`` of its own."""

    name: str
    pattern: str
    valid: Callable[[Column], Column] | None = None
    may: Callable[[Column], Column] | None = None
    find: Callable[[Column], Column] | None = None


def find(text: Column, kind: Kind) -> Column:
    """Array of (start, end, match) of the valid leftmost non-overlapping matches, in code points.

    What the pattern splits the text into gives the gaps between matches, so the
    start of each follows from the lengths before it.
    """
    if kind.find:
        return kind.find(text)
    gaps, found = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    steps = F.zip_with(gaps, found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)")
    ok = kind.valid or (lambda m: F.lit(True))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match")))
        return F.struct(end.alias("pos"), F.when(x["m"].isNotNull() & ok(x["m"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(steps, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(kind.may(text), spans).otherwise(none) if kind.may else spans


def all_spans(kinds: list[str], column: Callable[[str], Column] = F.col) -> Column:
    """One array of (start, order, end, kind, match), by start and then kind as listed, from one column per kind."""
    def named(order: int, kind: str) -> Column:
        return F.transform(
            column(kind),
            lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["match"].alias("match")),
        )

    parts = [named(i, k) for i, k in enumerate(kinds)]
    return F.array_sort(F.concat(*parts))


def text_of(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_of(spans: Column) -> Column:
    return C.sha256_of_spans(text_of(spans))
