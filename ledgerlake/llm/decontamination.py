"""Benchmark passages in documents, by a distributed positional inverted index.

Only DataFrame operations. A window is ``window`` consecutive words of one
benchmark item (a shorter item is one window). Plan:

1. Words. Each document is split into words once; the staged table holds a row
   number, the id and the words, so nothing is split or hashed again later.
2. Test terms. The distinct windows get numbers; how often each of their terms
   stands in the documents is counted (summed in each task first). A window
   with a term that no document has cannot occur.
3. Postings (term, row, position) are stored for the two rarest terms of each window.
   Neighbouring windows mostly share them, so lists are kept by the distinct triples
   (rarest term, second, distance between them), not by window.
4. Each pair's second list is shifted by the distance and the two lists are
   intersected by an equality join on (pair, row, stretch of 2 slop + 1 places): one
   row for each place where both terms stand as in the window or at most ``slop`` words
   off, never all pairs of two lists. The result is staged.
5. Places that are not off become window starts. They are gathered by document row, and
   every word of the window is compared with the document's words there: exact
   phrases. Words inside any of them are hit.

Proximity: a window is near a document if its two rarest terms stand there at most
``slop`` words off their distance in the window (exact phrases included).

The row numbers of documents with a possible phrase are broadcast if they are at most
MAX_BROADCAST_ROWS; beyond, the words are joined by shuffle. The other joins carry no
hint: their sizes are known from staged tables, so Spark broadcasts small ones and
shuffles others, splitting hot keys. A
posting list is spread over rows; a hot passage meets its pair on (pair, row, position).

Null texts and items without words have none; a null item_id still hits words but is
neither counted nor listed. Rows of one doc_id, or without any, are each judged on
their own; items of one item_id count as one. Very long texts stay one row of words,
taken apart by the place only for terms of a window. Only the named columns are read, so
further columns change nothing. An empty benchmark hits nothing; no documents give no rows.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW, SLOP = 10, 3
#: Row numbers of documents with a possible phrase that are broadcast at most.
MAX_BROADCAST_ROWS = 1_000_000
#: All ASCII but digits and small letters separates words, once A-Z are small.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    small = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(small, BETWEEN), "")


def numbered(df: DataFrame, name: str, number: str) -> DataFrame:
    """``df`` staged with a row number that is fixed once it is written."""
    return C.stage(df.withColumn(number, F.monotonically_increasing_id()), name)


@dataclass
class Index:
    """Staged tables of one benchmark against one set of documents."""

    docs: DataFrame  # row, doc_id, words, n_words
    items: DataFrame  # wid, item: where each window comes from
    windows: DataFrame  # wid, window (words), pid, at (place of the rarest term in it)
    pairs: DataFrame  # pid, term, other, apart
    postings: DataFrame  # term, row, pos


def build_index(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> Index:
    words = words_of(F.col("text"))
    train = numbered(docs.select("doc_id", words.alias("words")).withColumn("n_words", F.size("words").cast("long")), "train-words", "row")
    tests = C.stage(benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0), "test-words")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    cut = tests.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s, F.lit(window)))).alias("window"))
    windows = numbered(cut.select("window").distinct(), "test-windows", "wid")
    items = C.stage(cut.join(windows, "window").select("wid", "item").distinct(), "window-items")

    terms = windows.select("wid", F.posexplode("window").alias("place", "term"))
    known = C.stage(terms.select("term").distinct(), "test-terms")  # a join side of known size, or one that can be split
    count = train.select(F.explode("words").alias("term")).join(known, "term").groupBy("term").agg(F.count("*").alias("n"))
    count = C.stage(count, "term-counts")
    ranked = terms.join(count, "term").groupBy("wid").agg(F.sort_array(F.collect_list(F.struct("n", "place", "term"))).alias("r"))
    first = F.col("r")[0]
    second = F.coalesce(F.try_element_at("r", F.lit(2)), first)
    chosen = windows.join(ranked, "wid").where(F.size("r") == F.size("window")).select(
        "wid", "window", first["place"].alias("at"), first["term"].alias("term"), second["term"].alias("other"),
        (second["place"] - first["place"]).alias("apart"),
    )
    chosen = C.stage(chosen, "window-terms")
    triple = ["term", "other", "apart"]
    pairs = numbered(chosen.select(*triple).distinct(), "term-pairs", "pid")
    rare = C.stage(pairs.select(F.explode(F.array("term", "other")).alias("term")).distinct(), "rare-terms")
    postings = train.select("row", F.posexplode("words").alias("pos", "term")).join(rare, "term").select("term", "row", "pos")
    return Index(train, items, C.stage(chosen.join(pairs, triple).select("wid", "window", "pid", "at"), "windows"), pairs, C.stage(postings, "postings"))


def together(index: Index, slop: int = SLOP) -> DataFrame:
    """(pid, row, pos, off): the rarest term's places where the other term stands at most
    ``slop`` words off its distance, and by how many. One row for each such place and off."""
    width = 2 * slop + 1
    stretch = lambda c: F.floor(c / width)
    one = index.postings.join(index.pairs.select("pid", "term"), "term").select(
        "pid", "row", "pos", F.explode(F.array_distinct(F.array(stretch(F.col("pos") - slop), stretch(F.col("pos") + slop)))).alias("stretch")
    )
    shifted = F.col("pos") - F.col("apart")
    other = index.postings.join(index.pairs.select("pid", F.col("other").alias("term"), "apart"), "term")
    other = other.select("pid", "row", shifted.alias("there"), stretch(shifted).alias("stretch"))
    off = F.col("there") - F.col("pos")
    return one.join(other, ["pid", "row", "stretch"]).where(F.abs(off) <= slop).select("pid", "row", "pos", off.alias("off"))


def phrase_matches(index: Index, places: DataFrame) -> DataFrame:
    """row, matches: the exact occurrences (start, end, wid) of windows in each document that
    has any, by start; word numbers, the end exclusive. ``places`` is of :func:`together`."""
    at = places.where("off = 0").join(index.windows, "pid").select("row", (F.col("pos") - F.col("at")).alias("start"), "wid", "window").where("start >= 0")
    rows = C.stage(at.select("row").distinct(), "candidate-rows")
    docs = index.docs.select("row", "words")
    if rows.count() <= MAX_BROADCAST_ROWS:  # 8 bytes each: the words of other documents need not shuffle
        docs = docs.join(F.broadcast(rows), "row", "left_semi")
    by_row = at.groupBy("row").agg(F.collect_list(F.struct("start", "wid", "window")).alias("places"))
    same = F.filter("places", lambda p: F.slice("words", p["start"] + 1, F.size(p["window"])) == p["window"])
    found = docs.join(by_row, "row").select("row", same.alias("places"))
    spans = F.transform("places", lambda p: F.struct(p["start"].alias("start"), (p["start"] + F.size(p["window"])).alias("end"), p["wid"].alias("wid")))
    return found.where(F.size("places") > 0).select("row", F.sort_array(spans).alias("matches"))


def near_items(index: Index, places: DataFrame) -> DataFrame:
    """(row, item): items with a window near the document (see the module's text). Distinct."""
    near = places.select("row", "pid").distinct()
    return near.join(index.windows.select("pid", "wid"), "pid").join(index.items, "wid").where("item IS NOT NULL").select("row", "item").distinct()


def covered(matches: Column) -> Column:
    """How many words spans (start, end), sorted by start, cover together."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    add = lambda a, m: F.struct(
        F.greatest(a["upto"], m["end"]).alias("upto"), (a["n"] + F.greatest(m["end"] - F.greatest(a["upto"], m["start"]), F.lit(0))).alias("n")
    )
    return F.aggregate(matches, zero, add, lambda a: a["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Per document: doc_id, n_words, matches (spans of exact phrases, null without any), n_hit
    words inside them, items (ids with exact phrases, sorted as strings), n_near items near it."""
    index = build_index(docs, benchmark, window)
    places = C.stage(together(index, slop), "places")
    exact = C.stage(phrase_matches(index, places), "phrases")
    items = exact.select("row", F.explode(F.col("matches.wid")).alias("wid")).distinct().join(index.items, "wid").where("item IS NOT NULL")
    items = items.select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    near = near_items(index, places).groupBy("row").agg(F.count("*").alias("n_near"))
    return index.docs.select("row", "doc_id", "n_words").join(exact, "row", "left").join(items, "row", "left").join(near, "row", "left").select(
        "doc_id", "n_words", "matches", F.coalesce(covered(F.col("matches")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "n_near",
    )


_SQL_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_SQL_WORDS} AS words FROM documents),
tests AS (SELECT CAST(item_id AS VARCHAR) AS item, words FROM (SELECT item_id, {_SQL_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
cut AS (SELECT item, words[s:s + {WINDOW - 1}] AS win FROM (SELECT item, words, unnest(range(1, greatest(len(words) - {WINDOW} + 1, 1) + 1)) AS s FROM tests)),
places AS (SELECT row, words, len(words) AS n_words, unnest(range(1, len(words) + 1)) AS s FROM docs),
found AS (
  SELECT DISTINCT row, s, k, item FROM (
    SELECT row, s, k, words[s:s + k - 1] AS win FROM places, (SELECT DISTINCT len(win) AS k FROM cut) WHERE s + k - 1 <= n_words
  ) JOIN cut USING (win)
),
hit AS (SELECT row, count(DISTINCT word) AS n FROM (SELECT row, unnest(range(s, s + k)) AS word FROM found) GROUP BY row),
listed AS (SELECT row, string_agg(item, ',' ORDER BY item) AS items, count(*) AS n FROM (SELECT DISTINCT row, item FROM found WHERE item IS NOT NULL) GROUP BY row),
tokens AS (SELECT row, s AS pos, words[s] AS term FROM places),
wterms AS (SELECT win, place, win[place] AS term FROM (SELECT win, unnest(range(1, len(win) + 1)) AS place FROM (SELECT DISTINCT win FROM cut))),
ranked AS (
  SELECT win, place, term, row_number() OVER (PARTITION BY win ORDER BY n, place) AS r, count(*) OVER (PARTITION BY win) AS known
  FROM wterms JOIN (SELECT term, count(*) AS n FROM tokens WHERE term IN (SELECT term FROM wterms) GROUP BY term) USING (term)
),
rarest AS (
  SELECT x.win, x.term AS term, coalesce(y.term, x.term) AS other, coalesce(y.place, x.place) - x.place AS apart
  FROM ranked x LEFT JOIN ranked y ON x.win = y.win AND y.r = 2 WHERE x.r = 1 AND x.known = len(x.win)
),
near AS (
  SELECT p.row, count(DISTINCT item) AS n FROM (
    SELECT DISTINCT a.row, r.term, r.other, r.apart FROM (SELECT DISTINCT term, other, apart FROM rarest) r JOIN tokens a ON a.term = r.term
    JOIN tokens b ON b.row = a.row AND b.term = r.other AND abs(b.pos - a.pos - r.apart) <= {SLOP}
  ) p JOIN rarest USING (term, other, apart) JOIN cut USING (win) GROUP BY p.row
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(listed.n, 0) AS n_items,
       sha256(coalesce(listed.items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated, coalesce(near.n, 0) AS n_near
FROM docs LEFT JOIN hit USING (row) LEFT JOIN listed USING (row) LEFT JOIN near USING (row)
"""
