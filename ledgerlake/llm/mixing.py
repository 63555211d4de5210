"""Mixing of overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold
them). Every pattern offers its words once at no cost and again, up to
``cap`` times, at a cost that rises with each repetition (convex); every
source asks for its quota. The min-cost flow from patterns to sources says how
many words of each pattern to take, and so how many whole passes over it plus a
remainder. Sources that no document links, directly or through others, are
flows of their own, so each connected group of sources is solved in a task by
itself (connected components of the sources that patterns share): any number of
sources, one for each web domain say, with nothing on the driver. A task holds the patterns of
one connected group; the time of a single group grows with the square of its
patterns.

Documents of the remainder are selected in the order of a seeded hash: a
histogram of the hash's leading bits finds the cut-off, a second one its next
bits, so that only the few documents at the cut-off are ever sorted; then,
``fill_rounds`` times, the documents behind the cut-off that still fit the rest.

Rows that are equal in every column are one unit with a count, from which as
many rows are taken as fit: no group of copies is sorted, cut through or taken
whole. Targets are found by raising the level of words per weight until no
further source is full, an aggregate over the table of sources each time.

Null and empty texts have size 0 and are taken 0 times. Null sources are one
source, last in order. An empty table gives no rows. Texts of any length are
only counted. Extra columns, whatever their names, are kept by the stage and
tell rows apart. Reruns agree: choices depend on the rows and the seed only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .components import connected_components

BITS = 12
#: Rows of one unit that are written out in one go.
CHUNK = 1 << 16
CYCLE = (3, 1, 2)


def weights_by_order(sources: list[str | None], cycle: tuple[int, ...] = CYCLE) -> dict[str | None, int]:
    """Weights repeating along the sources by code point, null last."""
    ordered = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s])
    ordered += [None] * (None in sources)
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def targets(sizes: dict[str | None, int], weights: dict[str | None, int], share: Fraction = Fraction(3, 2), cap: int = 2) -> dict[str | None, Fraction]:
    """``share`` of all sizes dealt by weight, none above ``cap`` times its size, the excess dealt again."""
    out = {s: Fraction(0) for s in sizes}
    left, open_ = share * sum(sizes.values()), set(sizes)
    while open_ and left > 0:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / total > cap * sizes[s]}
        if not full:
            for s in open_:
                out[s] = left * weights[s] / total
            break
        for s in full:
            out[s] = Fraction(cap * sizes[s])
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def min_cost_flow(words: dict[int, int], member: dict[int, list], quota: dict, max_uses: int = 2) -> dict[int, int]:
    """Words to take of each pattern: most flow first, least repetition cost among those.

    Successive shortest paths with potentials on source -> patterns (one arc for
    each use, at cost 0, 1, 2, ...) -> sources -> sink.
    """
    pats, srcs = sorted(words), list(quota)
    node = {("p", p): i + 1 for i, p in enumerate(pats)} | {("s", s): len(pats) + 1 + i for i, s in enumerate(srcs)}
    sink = len(node) + 1
    graph: list[list[list]] = [[] for _ in range(sink + 1)]  # arcs: to, capacity, cost, index of the reverse arc

    def arc(u: int, v: int, capacity: int, cost: int) -> list:
        fwd, back = [v, capacity, cost, len(graph[v])], [u, 0, -cost, len(graph[u])]
        graph[u].append(fwd)
        graph[v].append(back)
        return back

    offers = {p: [arc(0, node["p", p], words[p], use) for use in range(max_uses)] for p in pats}
    for p in pats:
        for s in member[p]:
            arc(node["p", p], node["s", s], max_uses * words[p], 0)
    for s in srcs:
        arc(node["s", s], sink, quota[s], 0)
    height = [0] * (sink + 1)
    while True:
        dist, came = [None] * (sink + 1), [None] * (sink + 1)
        dist[0], heap = 0, [(0, 0)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for a in graph[u]:
                if a[1] > 0 and (dist[a[0]] is None or d + a[2] + height[u] - height[a[0]] < dist[a[0]]):
                    dist[a[0]], came[a[0]] = d + a[2] + height[u] - height[a[0]], (u, a)
                    heapq.heappush(heap, (dist[a[0]], a[0]))
        if dist[sink] is None:
            return {p: sum(back[1] for back in offers[p]) for p in pats}
        far = max(d for d in dist if d is not None)
        height = [h + (far if d is None else d) for h, d in zip(height, dist)]
        path, v = [], sink
        while v:
            u, a = came[v]
            path.append(a)
            v = u
        push = min(a[1] for a in path)
        for a in path:
            a[1] -= push
            graph[a[0]][a[3]][1] += push


def _order(source: str | None) -> tuple:
    return source is None, [ord(c) for c in source or ""]


def _flows(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, sources, words, asks) sorted by part: the flow of each connected group."""
    rows = (r for b in batches for r in b.to_pylist())
    for _, group in groupby(rows, lambda r: r["part"]):
        found = sorted(group, key=lambda r: [_order(s) for s in r["sources"]])
        asks = {a["source"]: a["quota"] for r in found for a in r["asks"]}
        quota = {s: asks[s] for s in sorted(asks, key=_order)}
        take = min_cost_flow({i: r["words"] for i, r in enumerate(found)}, {i: r["sources"] for i, r in enumerate(found)}, quota, cap)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r["sources"] for r in found], pa.list_(pa.string())), pa.array([r["words"] for r in found], pa.int64()), pa.array([take[i] for i in range(len(found))], pa.int64())],
            names=["sources", "words", "flow"],
        )


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``at``, its place by code point (null last), without a task that sees them all."""
    order = [F.col("source").isNull(), F.col("source")]
    cut = C.stage(
        sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id()), "mix-sources"
    )
    part = F.shiftrightunsigned("m", 33)
    before, first = 0, []
    for r in sorted(cut.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):  # one row a task
        first.append((r.part, before))
        before += r.n
    offsets = cut.sparkSession.createDataFrame(first, "p long, first long")
    at = F.col("first") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    return cut.join(F.broadcast(offsets), part == F.col("p")).select("source", "source_size", at.alias("at"))


def target_table(sources: DataFrame, share: Fraction = Fraction(3, 2), cap: int = 2) -> DataFrame:
    """``targets`` for a table (source, source_size, weight, ...) of any length: adds target and quota (whole words).

    The level (words per weight) rises with each source that is found full, so the
    rounds end; each is one aggregate.
    """
    def big(x: int) -> Column:
        return F.lit(str(x)).cast("decimal(38,0)")

    wide = F.col("source_size").cast("decimal(20,0)") * F.lit(cap)
    heavy = F.col("weight").cast("decimal(10,0)")
    level, full = None, F.lit(False)
    while True:
        a = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("source_size"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        left = Fraction(share) * int(a["all"] or 0) - cap * int(a["full"] or 0)
        new = left / int(a["weight"]) if a["weight"] else level
        if new == level:
            break
        level = new
        full = wide * big(level.denominator) < heavy * big(level.numerator)
    if level is None:
        level = Fraction(0)
    num, den = level.numerator, level.denominator
    even = (heavy * big(2 * num) + big(den)).cast("decimal(38,0)")
    return sources.withColumns({
        "target": F.when(full, F.col("source_size").cast("double") * cap).otherwise(F.col("weight") * F.lit(float(num)) / F.lit(float(den))),
        "quota": F.when(full, F.col("source_size") * cap).otherwise(F.call_function("div", even, big(2 * den))),
    })


def _select(units: DataFrame, quota: DataFrame) -> DataFrame:
    """Units (UNIT, n, h) of the patterns in ``quota`` (sources, quota > 0) with ``m``: how many of
    a unit's n rows belong to the seeded prefix of its pattern that fits the quota."""
    mass = F.col("size") * F.col("n")

    def boundary(df: DataFrame, part: Column, rest: str, names: tuple[str, str]) -> DataFrame:
        """Per pattern the first bucket that no longer fits, and what is left for it."""
        hist = df.groupBy("sources", rest, part.alias("b")).agg(F.sum(mass).alias("mass"))
        upto = F.sum("mass").over(Window.partitionBy("sources").orderBy("b"))  # at most 2^BITS rows
        edge = (
            hist.withColumn("upto", upto).where(F.col("upto") > F.col(rest))
            .groupBy("sources").agg(F.min_by(F.struct("b", (F.col(rest) - F.col("upto") + F.col("mass")).alias("rest")), "b").alias("x"))
        )
        return C.stage(edge.select("sources", F.col("x.b").alias(names[0]), F.col("x.rest").alias(names[1])), "mix-edge")

    first = F.shiftrightunsigned("h", 64 - BITS)
    second = F.shiftrightunsigned("h", 64 - 2 * BITS).bitwiseAND(F.lit((1 << BITS) - 1))
    one = boundary(units.join(quota, "sources"), first, "quota", ("b1", "rest1"))
    two = boundary(units.join(one, "sources").where(first == F.col("b1")), second, "rest1", ("b2", "rest2"))
    # staged, so that its size is known and only the rows at the edge are dealt by source
    edges = C.stage(quota.join(one, "sources", "left").join(two, "sources", "left"), "mix-edges")
    placed = units.join(edges, "sources").withColumn("f", first).withColumn("s", second)
    at_edge = F.coalesce((F.col("f") == F.col("b1")) & (F.col("s") == F.col("b2")), F.lit(False))
    ahead = Window.partitionBy("sources").orderBy("h", *UNIT[:2], "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest2") - F.coalesce(F.sum(mass).over(ahead), F.lit(0))
    cell = placed.where(at_edge).withColumn("room", room).withColumn("m", F.expr("greatest(0L, least(n, room div size))"))
    sure = F.col("b1").isNull() | (F.col("f") < F.col("b1")) | ((F.col("f") == F.col("b1")) & (F.col("s") < F.col("b2")))
    rest = placed.where(~at_edge).withColumn("m", F.when(sure, F.col("n")).otherwise(F.lit(0).cast("long")))
    cols = [*UNIT, "n", "h", "m"]
    return rest.select(*cols).unionByName(cell.select(*cols))


#: What rows of one unit have in common; text_key tells any other difference.
UNIT = ("doc_id", "text_key", "sources", "size")


def mix_units(rows: DataFrame, weights: DataFrame | None = None, share: Fraction = Fraction(3, 2), cap: int = 2, seed: int = 17, fill_rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Units of equal rows (doc_id, text_key, sources, size) with ``n``, their number, ``times``, how
    often each is taken, and ``extra``, how many of them are taken once more; and the sources
    (source, source_size, target).

    ``sources`` of a row is the array of sources that hold the document; ``weights``
    is a table (source, weight), by default ``CYCLE`` along the sources in order.
    """
    spark, old = rows.sparkSession, C.staged()
    units = C.stage(
        rows.withColumn("sources", F.coalesce("sources", F.expr("cast(array() as array<string>)"))).groupBy(*UNIT).agg(F.count("*").alias("n"))
        .withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_key", "sources")),
        "mix-units",
    )
    patterns = C.stage(units.groupBy("sources").agg(F.sum(F.col("size") * F.col("n")).alias("words")), "mix-patterns")
    sizes = patterns.select(F.explode("sources").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("source_size"))
    numbered = _numbered(sizes)
    if weights is None:
        weighed = numbered.withColumn("weight", F.get(F.array(*map(F.lit, CYCLE)), (F.col("at") % len(CYCLE)).cast("int")))
    else:
        weighed = numbered.join(weights.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    sources = C.stage(target_table(C.stage(weighed, "mix-weights"), share, cap), "mix-targets")
    keep = C.staged()[-1:]

    places = patterns.select("sources", "words", F.explode("sources").alias("member")).join(sources, F.col("member").eqNullSafe(F.col("source")))
    groups = places.groupBy("sources", "words").agg(
        F.collect_list(F.struct("source", "quota")).alias("asks"), F.collect_set("at").alias("ats")  # the sources of one document
    ).withColumn("part", F.array_min("ats"))
    links = groups.where("size(ats) > 1").select(F.col("part").alias("u"), F.explode("ats").alias("v")).where("u <> v")
    if not links.isEmpty():
        nodes = connected_components(links).withColumnsRenamed({"node": "part", "component": "root"})
        groups = groups.join(nodes, "part", "left").withColumn("part", F.coalesce("root", "part"))
    flows = C.stage(
        groups.select("part", "sources", "words", "asks").repartition("part").sortWithinPartitions("part")
        .mapInArrow(lambda it: _flows(it, cap), "sources array<string>, words long, flow long")
        .withColumn("times", F.expr(f"if(words > 0, least(flow div words, {cap}), 0L)").cast("long")),
        "mix-flows",
    )
    quota = C.stage(flows.select("sources", F.expr("flow - times * words").alias("quota")).where("quota > 0"), "mix-quota")
    open_ = units.where("size > 0")
    got = units.select(*UNIT, "n", F.lit(0).cast("long").alias("m"))
    for _ in range(fill_rounds):
        if quota.isEmpty():
            break
        done = C.stage(_select(open_, quota), "mix-round")
        got = got.unionByName(done.where("m > 0").select(*UNIT, F.lit(0).cast("long").alias("n"), "m"))
        spent = done.groupBy("sources").agg(F.sum(F.col("size") * F.col("m")).alias("spent"))
        quota = C.stage(quota.join(spent, "sources", "left").select("sources", (F.col("quota") - F.coalesce("spent", F.lit(0))).alias("quota")).where("quota > 0"), "mix-quota")
        open_ = done.join(quota, "sources").where("n > m and size <= quota").select(*UNIT, (F.col("n") - F.col("m")).alias("n"), "h")
    taken = got.groupBy(*UNIT).agg(F.sum("n").alias("n"), F.sum("m").alias("extra"))
    out = C.stage(taken.join(flows.select("sources", "times"), "sources", "left").select(*UNIT, "n", F.when(F.col("size") > 0, F.coalesce("times", F.lit(0))).otherwise(F.lit(0).cast("long")).alias("times"), "extra"), "mix-taken")
    keep += C.staged()[-1:]
    C.drop_staged(spark, [p for p in C.staged() if p not in old and p not in keep])
    return out, sources.select("source", "source_size", "target")


def _spread(units: DataFrame, count: str) -> DataFrame:
    """``count`` rows of each unit, numbered by ``i`` from 0; a large unit's rows in many tasks."""
    starts = units.where(F.col(count) > 0).withColumn("i0", F.explode(F.expr(f"sequence(0L, {count} - 1, {CHUNK}L)")))
    large = F.col(count) > CHUNK
    dealt = starts.where(large)
    dealt = dealt.repartition(F.col("doc_id"), F.col("text_key"), F.col("i0"))
    both = starts.where(~large).unionByName(dealt)
    return both.withColumn("i", F.explode(F.expr(f"sequence(i0, least(i0 + {CHUNK}, {count}) - 1)"))).drop("i0")


def taken_rows(units: DataFrame) -> DataFrame:
    """(doc_id, text_key, sources, size, taken) of each row, from ``mix_units``."""
    taken = (F.col("times") + (F.col("i") < F.col("extra")).cast("long")) * F.col("size")
    return _spread(units, "n").select(*UNIT, taken.alias("taken"))


def mix(rows: DataFrame, weights=weights_by_order, share: Fraction = Fraction(3, 2), cap: int = 2, seed: int = 17, fill_rounds: int = 3) -> tuple[DataFrame, dict, dict]:
    """``mix_units`` for few sources, with weights from a function of their list: rows
    (doc_id, text_key, sources, size, taken); sizes and targets of the sources as dicts."""
    names = [r[0] for r in rows.select(F.explode("sources")).distinct().collect()]
    table = rows.sparkSession.createDataFrame(list(weights(names).items()), "source string, weight int")
    units, sources = mix_units(rows, table, share, cap, seed, fill_rounds)
    found = sources.collect()
    sizes = {r.source: r.source_size for r in found}
    return taken_rows(units), sizes, targets(sizes, weights(names), Fraction(share), cap)


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns: rows that differ anywhere are told apart."""
    plain = [F.col(f"`{f.name}`").cast("string") if f.dataType.typeName() in ("map", "variant") else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return F.xxhash64(*plain)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, sources, size of documents with one source each."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key(docs).alias("text_key"),
        F.array(F.col("source").cast("string")).alias("sources"),
        F.coalesce(F.regexp_count("text", F.lit(C.WORD)), F.lit(0)).cast("long").alias("size"),
    )


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, sources = mix_units(sized(C.table(spark, sf_dir, "documents")))
    out = taken_rows(units).withColumn("src", F.col("sources")[0])
    return out.join(sources, F.col("src").eqNullSafe(F.col("source"))).select("doc_id", "size", "source_size", "target", "taken", "source")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as many times as the mix takes it; its columns unchanged."""
    C.prepare(spark)
    units, _ = mix_units(sized(docs))
    uses = units.select(F.col("doc_id").alias("id"), F.col("text_key").alias("row"), F.col("sources")[0].alias("src"), "n", "times", "extra")
    # the documents as one struct, so that no name of theirs meets one of ours
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_key(docs).alias("key"))
    same = F.col("doc.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col("key") == F.col("row")) & F.col("doc.source").cast("string").eqNullSafe(F.col("src"))
    part = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))  # at most fill_rounds units a pattern
    each = F.col("times") + F.when(F.col("extra") == F.col("n"), F.lit(1)).otherwise(F.lit(0))
    whole = keyed.join(uses.withColumn("each", each).where("each > 0"), same)
    whole = whole.withColumn("use", F.explode(F.expr("sequence(1L, each)"))).select("doc.*")
    some = keyed.join(uses.where(part), same).groupBy("id", "row", "src").agg(F.any_value("doc").alias("doc"), F.max("extra").alias("extra"))
    some = some.select(F.col("id").alias("doc_id"), F.col("row").alias("text_key"), "doc", "extra")
    return whole.unionByName(_spread(some, "extra").select("doc.*"))
