"""Secret scan behind a trigram inverted index, with DataFrame functions only.

From each rule's pattern a Boolean query over trigrams is derived: strings that
every match must contain, as a disjunction of trigram sets. The index holds,
for every trigram of those queries, the postings of the texts that contain it
(in lower case). A rule's candidates are the texts whose postings complete one
of its sets; only they are searched with the pattern. A rule whose pattern
demands no trigram (a run of hex digits) scans every text.

Texts are known in the index by a 64-bit hash. A collision only adds a
candidate, which the search then refutes; nothing is lost. Equal texts share
their postings, so a group of copies is indexed once per task and folds in the
first aggregate. Postings are intersected by or-ing one bit per trigram and
text (map-side combined), never by gathering a posting list. The candidates
are staged; joining them back to the documents is left to Spark, which
broadcasts them while they are small and else shuffles with skew splitting.

Null texts count as empty and have no spans. Null ids stay null. Repeated rows
get equal results. Extra columns of the documents are kept by ``scan`` unless
they bear the name of an output, in which case the output replaces them.
"""

from __future__ import annotations

import itertools
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import spans as S

#: Strings and clauses that a derived query may have; beyond that, parts are left
#: out of it, which admits more candidates and loses none.
MOST_STRINGS, MOST_CLAUSES = 16, 64

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [
    S.Kind("assign", _ASSIGN, lambda m: F.length(F.regexp_extract(m, _ASSIGN, 2)) >= 8),
    S.Kind("access", r"AKIA[A-Z0-9]+", lambda m: F.length(m) >= 16),
    S.Kind("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+"),  # a run of 32 or more, whole
]
ADDED = [
    S.Kind("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    S.Kind("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    S.Kind("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    S.Kind("google", r"AIza[A-Za-z0-9_-]{35}"),
    S.Kind("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}+"),
]

Clauses = list[frozenset[str]]  # any of these sets of trigrams; [frozenset()] demands nothing


def _and(a: Clauses, b: Clauses) -> Clauses:
    both = list(dict.fromkeys(x | y for x in a for y in b))
    if len(both) > MOST_CLAUSES:
        return min(a, b, key=len)
    return both


def _of_strings(strings: set[str]) -> Clauses:
    if any(len(s) < 3 for s in strings):
        return [frozenset()]
    return [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)]


def _query(items) -> tuple[set[str] | None, Clauses]:
    """What a parsed sequence demands: the strings it can be, if they are few, else a query."""
    query: Clauses = [frozenset()]
    now: set[str] = {""}  # what the stretch at hand can read
    broken = False

    def close() -> None:
        nonlocal query, now, broken
        query, now, broken = _and(query, _of_strings(now)), {""}, True

    for op, arg in items:
        exact: set[str] | None = None
        inner: Clauses = [frozenset()]
        if op is sre.LITERAL:
            exact = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            exact = {chr(v).lower() for _, v in arg}
        elif op is sre.SUBPATTERN:
            exact, inner = _query(arg[-1])
        elif op is sre.BRANCH:
            parts = [_query(p) for p in arg[1]]
            if all(e is not None for e, _ in parts):
                exact = set().union(*(e for e, _ in parts))
            inner = list(dict.fromkeys(c for e, q in parts for c in (_of_strings(e) if e is not None else q)))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            e, q = _query(body)
            if e is not None and high == 1:
                exact = e | ({""} if low == 0 else set())
            elif low and e is not None and low == high and len(e) ** low <= MOST_STRINGS:
                exact = {"".join(t) for t in itertools.product(e, repeat=low)}
            elif low:
                inner = _of_strings(e) if e is not None else q
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        if exact is not None and len(exact) * len(now) <= MOST_STRINGS:
            now = {a + b for a in now for b in exact}
        else:
            close()
            query = _and(query, _of_strings(exact) if exact is not None else inner)
    if not broken:
        return now, query
    close()
    return None, query


def trigram_query(pattern: str) -> Clauses | None:
    """Sets of lower-case trigrams of which every match contains one; None if nothing is demanded."""
    exact, query = _query(parser.parse(pattern))
    clauses = _and(query, _of_strings(exact)) if exact is not None else query
    smallest = [c for c in clauses if not any(d < c for d in clauses)]
    return None if frozenset() in smallest or not smallest else smallest


def build_index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """The postings (tri, key) of the column ``text`` for those trigrams; key is the text's hash."""
    low = texts.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("key"), F.lower("text").alias("low"))
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    return low.select("key", F.explode(held).alias("tri"))


def candidates(index: DataFrame, queries: dict[int, Clauses]) -> DataFrame:
    """key and ``rules`` (those whose query holds) by intersecting postings."""
    uses: dict[str, list[tuple[int, int, int, int]]] = {}
    for r, clauses in queries.items():
        for c, clause in enumerate(clauses):
            tris = sorted(clause)[:62]
            for i, t in enumerate(tris):
                uses.setdefault(t, []).append((r, c, 1 << i, (1 << len(tris)) - 1))
    spark = index.sparkSession
    wanted = spark.createDataFrame([(t, *u) for t, us in uses.items() for u in us], "tri string, rule int, clause int, bit long, full long")
    hits = (
        index.join(F.broadcast(wanted), "tri")  # as many rows as the rules have trigrams
        .groupBy("key", "rule", "clause", "full").agg(F.bit_or("bit").alias("bits"))
        .where("bits = full")
    )
    return hits.groupBy("key").agg(F.collect_set("rule").alias("rules"))  # at most the number of rules


def scan(docs: DataFrame, kinds: list[S.Kind]) -> DataFrame:
    """``docs`` with one array column of spans for each kind, named after it."""
    queries = {r: q for r, k in enumerate(kinds) if (q := trigram_query(k.pattern)) is not None}
    trigrams = sorted({t for q in queries.values() for c in q for t in c})
    kept = [c for c in docs.columns if c not in {k.name for k in kinds}]
    base = docs.select(*kept)
    text = F.coalesce("text", F.lit(""))
    rules = F.expr("cast(array() as array<int>)")
    if trigrams:
        found = C.stage(candidates(build_index(docs.select("text"), trigrams), queries), "secret-candidates")
        own = C.free_prefix(docs.columns, "_secret_")
        found = found.withColumnsRenamed({"key": f"{own}key", "rules": f"{own}rules"})
        base = base.join(found, F.xxhash64(F.col("text")) == F.col(f"{own}key"), "left")
        rules = F.coalesce(F.col(f"{own}rules"), rules)
    out = []
    for r, k in enumerate(kinds):
        may = None if r not in queries else lambda _, r=r: F.array_contains(rules, r)
        out.append(S.find(text, S.Kind(k.name, k.pattern, k.valid, may)).alias(k.name))
    return base.select(*kept, *out)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = BASE + ADDED
    found = scan(docs, kinds)
    base = [k.name for k in BASE]
    both = found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base], S.all_spans(base).alias("b"), S.all_spans([k.name for k in kinds]).alias("a"))
    return both.select("doc_id", *[f"n_{k}" for k in base], S.digest_of(F.col("b")).alias("base_sha256"), S.text_of(F.col("a")).alias("spans"))
