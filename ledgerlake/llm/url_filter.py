"""URL filter: rules first, then the ratio of two character Markov models.

A rule names a host and the start of a path; it fits the host and its
subdomains, and the longest fitting rule decides. The other URLs are judged by
two smoothed variable-order Markov models over the characters of host and path,
one of rejected and one of accepted URLs: Witten-Bell interpolation, where a
context never seen falls back to the next shorter one. A URL's score is the mean
log-likelihood difference per character (accepted minus rejected), and it is
allowed if that reaches a threshold calibrated on labelled URLs held out of the
counts: half way between a low quantile of the accepted and a high one of the
rejected below it.

Rejected examples are the URLs that a rule blocks, those that the caller labels
as rejected, and those whose host has a seed word as a whole part (between dots
and hyphens). All others are accepted ones; where the caller labels accepted URLs,
only these and allow-ruled ones are. A label goes before rule and seed. The threshold is calibrated on seeded and labelled examples, or on
those that a rule blocks where there are no others. A rule may block URLs for
what the rule names alone: where the classes overlap, only the rejected below
nearly all accepted count for the threshold, and if those are no more than chance
puts there, everything is allowed. Digits count as one character.

All counts cover every distinct text. The n-gram table is one aggregate of
exploded grams (map-side combined); shorter grams are sums over it. Grams and
their log ratios are staged, so their join with the texts' grams can split hot
grams or turn to a broadcast by measured size. Ratios are whole micro-units, so
sums do not depend on their order. DataFrame functions only.

Null URLs and those without ``://`` have an empty host and path and are judged
by the method like any other text. Without rejected examples everything is
allowed. Repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ORDER = 4  # characters of context at most
MICRO = 1_000_000
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PAD = "\u0002"  # before a text's first character; \u0003 is its end


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]
#: Words that mark a host as a rejected example, as whole parts of it.
SEEDS = ("casino", "cheap", "pills", "spam", "adult", "porn", "viagra", "free", "bets", "ads", "track")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _AZ, _AZ.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (of equally long ones the first)."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):  # later ones win
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def seeded(host: Column, seeds: tuple[str, ...] = SEEDS) -> Column:
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, seeds))) if seeds else F.lit(False)


def _grams(texts: DataFrame) -> DataFrame:
    """``texts`` with one row for each of its characters (and the end): gram = context and character."""
    padded = F.concat(F.lit(_PAD * ORDER), F.col("text"), F.lit("\u0003"))
    at = F.sequence(F.lit(1), F.length("text") + 1)
    return texts.withColumn("gram", F.explode(F.transform(at, lambda i: F.substring(padded, i, F.lit(ORDER + 1)))))


def log_ratios(grams: DataFrame) -> DataFrame:
    """gram and ``ratio`` (micro-units of ln P_accepted - ln P_rejected of its last character).

    ``grams`` has each gram of ORDER + 1 characters with ``n_acc`` and ``n_rej``.
    """
    lower = None
    for k in range(ORDER + 1):  # contexts of k characters
        level = grams.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("g")).agg(F.sum("n_acc").alias("n_acc"), F.sum("n_rej").alias("n_rej"))
        ctx = level.groupBy(F.substring("g", 1, k).alias("c")).agg(
            *[f(c).alias(f"{p}_{c}") for c in ("n_acc", "n_rej") for p, f in (("all", F.sum), ("kinds", lambda c: F.count_if(F.col(c) > 0)))]
        )
        here = level.join(ctx, F.substring("g", 1, k) == F.col("c"))
        if lower is None:
            here = here.withColumns({"p_acc0": F.lit(1 / 256), "p_rej0": F.lit(1 / 256)})
        else:
            here = here.join(lower.withColumnsRenamed({"g": "tail", "p_acc": "p_acc0", "p_rej": "p_rej0"}), F.substring("g", 2, k) == F.col("tail"))

        def smooth(c: str) -> Column:
            seen, kinds = F.col(f"all_n_{c}"), F.col(f"kinds_n_{c}")
            p = (F.col(f"n_{c}") + kinds * F.col(f"p_{c}0")) / F.when(seen > 0, seen + kinds)
            return F.when(seen > 0, p).otherwise(F.col(f"p_{c}0")).alias(f"p_{c}")

        lower = C.stage(here.select("g", smooth("acc"), smooth("rej")), "url-level")
    return lower.select(F.col("g").alias("gram"), F.round((F.ln("p_acc") - F.ln("p_rej")) * MICRO).cast("long").alias("ratio"))


def score(texts: DataFrame, train: Column, rejected: Column) -> DataFrame:
    """``texts`` (distinct ``text`` and other columns) with ``score``, micro-units per character."""
    count = F.when(train, 1).otherwise(0)
    grams = C.stage(
        _grams(texts).groupBy("gram").agg(
            F.sum(F.when(~rejected, count).otherwise(0)).alias("n_acc"), F.sum(F.when(rejected, count).otherwise(0)).alias("n_rej")
        ),
        "url-grams",
    )
    ratios = C.stage(log_ratios(grams), "url-ratios")
    sums = _grams(texts.select("text")).join(ratios, "gram").groupBy("text").agg((F.sum("ratio") / F.count("*")).alias("score"))
    return texts.join(sums, "text")


def threshold(scored: DataFrame, low: float, high: float) -> float | None:
    """The least score that is allowed; None allows all.

    ``scored``: score, rejected, certain and held_out. Held-out texts of a class
    decide, or all of it where none are held out.
    """
    held, by = F.col("held_out"), {"accepted": ~F.col("rejected"), "certain": F.col("certain"), "blocked": F.col("rejected")}
    n = scored.agg(*[F.count_if(c & h).alias(f"{k}_{x}") for k, c in by.items() for x, h in (("held", held), ("all", F.lit(True)))]).first().asDict()
    if not n["accepted_all"] or not n["blocked_all"]:
        return None
    rejected = "certain" if n["certain_all"] else "blocked"
    cls = {k: by[k] & (held if n[f"{k}_held"] else F.lit(True)) for k in ("accepted", rejected)}
    size = n[f"{rejected}_held"] or n[f"{rejected}_all"]
    acc = scored.agg(F.percentile_approx(F.when(cls["accepted"], F.col("score")), low, 10_000)).first()[0]
    below = cls[rejected] & (F.col("score") < acc)
    rej, found = scored.agg(F.percentile_approx(F.when(below, F.col("score")), high, 10_000), F.count_if(below)).first()
    if found <= low * size + 3 * (low * size) ** 0.5:  # no more than accepted ones would have there
        return None
    return (acc + rej) / 2


def judge(
    pages: DataFrame, rules: list[Rule] = RULES, seeds: tuple[str, ...] = SEEDS, low: float = 0.01, high: float = 0.99, seed: int = 5,
    labelled: DataFrame | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page; ``score`` is null where a rule decides.

    ``labelled`` has known URLs: ``url`` and ``rejected`` (boolean).
    """
    host, path = F.col("host"), F.col("path")
    rule, ruled = match_rule(host, path, rules)
    text = F.regexp_replace(F.concat(host, path), "[0-9]", "0")
    rows = (
        pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"))
        .withColumn("text", text)
    )
    labels_accepted = labelled is not None and not labelled.where(~F.col("rejected")).isEmpty()
    clean = F.coalesce(F.col("ruled") == "allow", F.lit(False)) if labels_accepted else F.lit(True)
    examples = rows.select("text", clean.alias("clean"), seeded(host, seeds).alias("seeded"), F.coalesce(F.col("ruled") == "block", F.lit(False)).alias("blocked"), F.lit(None).cast("boolean").alias("label"))
    if labelled is not None:
        known = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("rejected").alias("label"))
        examples = examples.unionByName(known.select(text.alias("text"), F.lit(True).alias("clean"), F.lit(False).alias("seeded"), F.lit(False).alias("blocked"), "label"))
    texts = C.stage(
        examples.groupBy("text").agg(F.max("seeded").alias("seeded"), F.max("blocked").alias("blocked"), F.max("label").alias("label"), F.max("clean").alias("clean"))
        .select(
            "text", F.coalesce("label", F.col("seeded") | F.col("blocked")).alias("rejected"), F.coalesce("label", "seeded").alias("certain"), "clean",
            (F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(4)) == 0).alias("held_out"),
        ),
        "url-texts",
    )
    example = F.col("rejected") | F.col("clean")
    scored = C.stage(score(texts, example & ~F.col("held_out"), F.col("rejected")), "url-scores")
    limit = threshold(scored.where(example), low, high)
    joined = rows.join(scored.select(F.col("text").alias("_t"), "score"), F.col("text") == F.col("_t"), "left")
    method = F.lit("allow") if limit is None else F.when(F.col("score") >= F.lit(limit), "allow").otherwise("block")
    return joined.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("score") / MICRO).alias("score"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "pages"))
