"""Personal data: patterns propose, checksums confirm, context words adjust the score.

Every kind has a pattern, a check of the matched text (Luhn for cards, mod-97
for IBANs, ranges for addresses, digit counts for phones) and a base score. A
word of the kind's context that stands by itself (or in the plural) in the ``WINDOW``
characters around a span raises its score. Base kinds are always reported; the added kinds are when their score
reaches ``THRESHOLD``: an IBAN passes by its checksum alone, a social security
number only with its context. An IBAN may be followed by capitals, as in
``IBAN ... BIC ...``: where the longest run of groups fails the checksum, those
that end at an earlier blank are tried too (see ``ibans``).

DataFrame functions only, one pass and no shuffle; every text is searched whole.
Patterns are written so that no search runs twice over the same stretch
(possessive runs that start where no run goes on), so very long texts take
linear time. Null texts count as empty. Null ids stay null. Repeated rows get
equal results. Extra columns are kept; a column named as an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import spans as S

WINDOW, RAISE, THRESHOLD = 40, 0.4, 0.6


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(number.substr(n - i, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN (blanks removed) leaves 1 modulo 97, four characters moved to the end."""
    turned = F.concat(iban.substr(F.lit(5), F.length(iban)), iban.substr(F.lit(1), F.lit(4)))
    n = F.length(turned)

    def step(rest: Column, i: Column) -> Column:
        a = F.ascii(turned.substr(i, F.lit(1)))
        return F.when(a >= 65, (rest * 100 + a - 55) % 97).otherwise((rest * 10 + a - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) == 1


def _card(m: Column) -> Column:
    return F.when(F.length(digits(m)).between(12, 19), luhn(digits(m))).otherwise(F.lit(False))


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: What the patterns match, and why it equals the plainer forms: a run is taken whole
#: (nothing after it could use part of it), and starts where no run goes on or where
#: the last match ended.
BASE = [
    S.Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, lambda t: F.contains(t, F.lit("@"))),
    S.Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: F.rlike(m, F.lit(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")), lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]"))),
    S.Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card, lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}"))),
    S.Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(digits(m)).between(9, 15), lambda t: F.contains(t, F.lit("+"))),
]
_GROUPS = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
#: The first four characters of an IBAN; group 1 is the longest run of groups from there.
_IBAN = rf"(?<![A-Za-z0-9])(?=({_GROUPS}))[A-Z]{{2}}[0-9]{{2}}"
_IBAN_HEAD = 4
#: Characters of an IBAN by country. Countries that are not listed have any length.
IBAN_LENGTH = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW", 31: "MT SC", 32: "LC",
}


def longest_iban(run: Column) -> Column:
    """The run if it passes, else its longest part up to a blank that does; null if none.

    A part must have its country's length: by chance one in 97 parts passes the checksum.
    """
    pieces = F.split(run, " ")
    parts = F.transform(F.sequence(F.size(pieces), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(pieces, F.lit(1), k), " "))
    lengths = F.create_map(*[F.lit(x) for n, names in IBAN_LENGTH.items() for c in names.split() for x in (c, n)])

    def passes(part: Column) -> Column:
        iban = F.regexp_replace(part, " ", "")
        n = F.length(iban)
        sized = (F.length(part) == F.length(run)) | (F.coalesce(lengths[F.substring(part, 1, 2)], n) == n)
        return F.when(sized & (n >= 12), mod97(iban)).otherwise(F.lit(False))

    return F.get(F.filter(parts, passes), F.lit(0))


def ibans(text: Column) -> Column:
    """Like ``spans.find``, but a span ends where ``longest_iban`` ends, and the search goes on there."""
    gaps, runs = F.split(text, _IBAN, -1), F.regexp_extract_all(text, F.lit(_IBAN), F.lit(1))
    steps = F.zip_with(gaps, runs, lambda gap, run: F.struct(F.length(gap).alias("gap"), F.when(run.isNotNull(), longest_iban(run)).alias("m")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        end = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match")))
        new = x["m"].isNotNull() & (start >= acc["last"])  # not the head of a group inside the last span
        return F.struct(
            (start + _IBAN_HEAD).alias("pos"), F.when(new, end).otherwise(acc["last"]).alias("last"),
            F.when(new, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("last"), none.alias("out"))
    found = F.aggregate(steps, zero, step, lambda acc: acc["out"])
    return F.when(F.rlike(text, F.lit(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}")), found).otherwise(none)


ADDED = [
    S.Kind("iban", _IBAN, find=ibans),
    S.Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", None, lambda t: F.rlike(t, F.lit(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"))),
]
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT = {
    "email": "mail|e-?mail|contact|write to",
    "ip": "ip|ipv4|address(?:es)?|host|hostname|server",
    "card": "card|visa|mastercard|payment|credit",
    "phone": "phone|telephone|telefon|teléfono|téléphone|tel|call|mobile|fax",
    "iban": "iban|bank|account",
    "ssn": "ssn|social security|tax id",
}


def context_pattern(words: str) -> str:
    """One of the words, not inside another word; a plural s may follow."""
    return rf"(?<![\p{{L}}\p{{N}}])(?:{words})s?(?![\p{{L}}\p{{N}}])"


def find_pii(docs: DataFrame, out: str = "findings") -> DataFrame:
    """``docs`` with a column ``out``: array of (start, order, end, kind, match, score) by start, then kind."""
    kinds = BASE + ADDED
    kept = [c for c in docs.columns if c != out]
    text = F.coalesce("text", F.lit(""))
    own = C.free_prefix(docs.columns, "_pii_")
    cols = {k.name: f"{own}{k.name}" for k in kinds}
    found = docs.select(*kept, text.alias(f"{own}text"), *[S.find(text, k).alias(cols[k.name]) for k in kinds])
    spans = S.all_spans([k.name for k in kinds], lambda k: F.col(cols[k]))
    base = F.create_map(*[F.lit(x) for kv in SCORES.items() for x in kv])
    near = {k: context_pattern(w) for k, w in CONTEXT.items()}

    def in_context(s: Column) -> Column:
        """Whether a context word of the span's kind stands whole in the characters around it."""
        lo = F.greatest(s["start"] - WINDOW - 1, F.lit(0))
        # one character more than the window: it shows whether a word at the edge is whole
        before, after = F.substring(f"{own}text", lo + 1, s["start"] - lo), F.substring(f"{own}text", s["end"] + 1, F.lit(WINDOW + 1))
        around = F.lower(F.concat(before, F.lit("\n"), after))
        out = F.lit(False)
        for kind, pattern in near.items():
            out = F.when(s["kind"] == kind, F.rlike(around, F.lit(pattern))).otherwise(out)
        return out

    def scored(s: Column) -> Column:
        score = base[s["kind"]] + F.when(in_context(s), F.lit(RAISE)).otherwise(F.lit(0.0))
        return F.struct(
            s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"), s["match"].alias("match"),
            F.least(score, F.lit(1.0)).alias("score"),
        )

    listed = found.select(*kept, f"{own}text", spans.alias(f"{own}spans"))
    keep = lambda s: (s["order"] < len(BASE)) | (s["score"] >= THRESHOLD)
    return listed.select(*kept, F.filter(F.transform(f"{own}spans", scored), keep).alias(out))


def redact(text: Column, findings: Column) -> Column:
    """The text with each stretch of findings replaced by the kind of its first one, as in <EMAIL>."""
    end = F.length(text)

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        tag = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, tag)).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(findings, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, end)))
    return F.when(F.size(findings) > 0, done).otherwise(text)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [k.name for k in BASE]
    split = found.select("doc_id", F.filter("findings", lambda s: s["order"] < len(base)).alias("b"), "findings")

    def count(kind: str) -> Column:
        return F.size(F.filter("b", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    scores = F.array_join(F.transform("findings", lambda s: F.format_string("%.1f", s["score"])), ",")
    return split.select("doc_id", *map(count, base), S.digest_of(F.col("b")).alias("base_sha256"), S.text_of(F.col("findings")).alias("spans"), scores.alias("scores"))


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data in the texts replaced by tags, n_chars to match."""
    own = C.free_prefix(docs.columns, "_pii_")
    found = find_pii(docs, f"{own}findings")
    done = found.withColumn(f"{own}clean", F.when(F.col("text").isNotNull(), redact(F.col("text"), F.col(f"{own}findings"))))
    out = {"text": F.col(f"{own}clean"), "n_chars": F.length(f"{own}clean").cast("long")}
    return done.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])
