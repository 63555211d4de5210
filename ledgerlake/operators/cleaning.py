"""Clean stage: standardise raw text, reject rows missing critical fields,
and drop redundant duplicates.

The raw row (after missing-token normalisation) rides along as a struct
column ``_raw`` so any rejected row can be logged with its original text —
no positional back-lookup into the input is needed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import reference_data as R
from ..functions import scalars as S
from ..session import drop_tables, materialize, write_staged

SOURCE_POS = "_source_pos"
RAW = "_raw"
#: Number of a row in a staged table: unique, and one after the other in each of its files.
ROW = "_row"
#: Presence of the critical fields and fullness of a row, where they are staged beside it.
MISSING, SCORE = "_missing", "_score"
#: Up to so many buckets of keep flags (4 KB for 32,768 rows each) are sent to every task.
BROADCAST_BUCKETS = 16_384


def snake_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c if c.startswith("_") else S.snake_case(c) for c in df.columns])


def na_tokens_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[c if c.startswith("_") else S.na_to_null(F.col(c)).alias(c) for c in df.columns])


# Typed form of each known column; unknown columns pass through unchanged.
def _typed(name: str, c: Column | None = None) -> Column:
    c = F.col(name) if c is None else c
    if name in ("amount", "discount_rate"):
        return S.clean_numeric(c)
    if name == "order_date":
        return S.parse_mixed_date(c)
    if name == "currency":
        return S.normalize_category(c, "upper")
    if name == "region":
        return S.normalize_region(c)
    if name == "country":
        return S.normalize_category(c, "title")
    if name == "order_status":
        return S.normalize_status(c)
    return c


def standardize(raw: DataFrame) -> DataFrame:
    """NA tokens -> NULL, snake_case headers, typed columns, plus ``_raw``."""
    df = snake_case_columns(na_tokens_to_null(raw))
    data_cols = [c for c in df.columns if not c.startswith("_")]
    extra = [c for c in df.columns if c.startswith("_")]
    return df.select(
        *extra,
        F.struct(*data_cols).alias(RAW),
        *[_typed(c).alias(c) for c in data_cols],
    )


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


# Typed columns that can be NULL where the raw text is not (a failed parse).
# Every other standardised column (trim / case / alias mapping / pass-through)
# is NULL exactly where its missing-token-normalised raw text is.
PARSED_COLUMNS = ("amount", "discount_rate", "order_date")
#: Standardised columns that a staged row holds: the parsed ones, and those that the rules read.
STAGED_COLUMNS = (*PARSED_COLUMNS, "currency", "order_status")
#: Standardised columns that take work to get back from the raw text.
RESTORED_COLUMNS = ("region", "country")


def present(df: DataFrame, c: str) -> Column:
    """``c IS NOT NULL`` for a standardised column, read off the raw text
    where that is equivalent, so a consumer that only needs presence (the
    duplicate score, the critical-field check) does not run the normaliser."""
    if c in PARSED_COLUMNS or RAW not in df.columns:
        return F.col(c).isNotNull()
    return F.col(f"{RAW}.{c}").isNotNull()


def missing_critical(df: DataFrame) -> Column:
    return reduce(lambda a, b: a | b, [~present(df, c) for c in R.CRITICAL_COLUMNS if c in df.columns])


def missing_reason(df: DataFrame) -> Column:
    parts = [F.when(~present(df, c), F.lit(c.upper())) for c in R.CRITICAL_COLUMNS if c in df.columns]
    return F.concat(F.lit("UNPARSEABLE_OR_MISSING_"), F.concat_ws("_", *parts))


def reject_missing(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected); rejected keeps ``_raw`` + severity + reason."""
    flag = missing_critical(df)
    rejected = df.filter(flag).select(
        *[c for c in df.columns if c.startswith("_")],
        F.lit("CRITICAL").alias("severity"),
        missing_reason(df).alias("failure_reason"),
    )
    return df.filter(~flag), rejected


def completeness_score(df: DataFrame, cols: list[str] | None = None) -> Column:
    cols = cols or data_columns(df)
    return reduce(lambda a, b: a + b, [present(df, c).cast("int") for c in cols])


def dedup_winners(df: DataFrame, key: str = "order_id", order_col: str = SOURCE_POS,
                  score_cols: list[str] | None = None, eligible: Column | None = None) -> DataFrame:
    """Per key: the fullest eligible row's position and the key's row count.

    A plain aggregate (partial aggregation on the map side), so a key that
    holds a third of all rows is folded inside every task instead of being
    sorted in one. Ineligible rows are skipped inside the aggregate rather
    than by a filter, which would be pushed down and re-evaluate the whole
    cleaning expression tree in the scan.
    """
    score = F.col(SCORE) if SCORE in df.columns else completeness_score(df, score_cols)
    cand = F.struct((-score).alias("neg_score"), F.col(order_col).alias("pos"))
    if eligible is not None:
        cand = F.when(eligible, cand)
    best = F.min(cand)
    count = F.count(F.lit(1)) if eligible is None else F.count_if(eligible)
    return df.groupBy(key).agg(best["pos"].alias("_keep_pos"), count.alias("_dup_count"))


def mark_duplicates(df: DataFrame, key: str = "order_id", order_col: str = SOURCE_POS,
                    score_cols: list[str] | None = None) -> DataFrame:
    """Adds ``_keep``: this row is the one kept of its key (most non-null
    fields, then the earliest position). Rows without a key are all kept.
    Rows of ``stage_rows`` stay where they are; others are joined by position."""
    if ROW in df.columns:
        read: list[str] = []
        bits = materialize(keep_bits(kept_rows(df, key, order_col, written=read)), "keep-bits")
        drop_tables(df.sparkSession, read)
        return join_keep(df, bits).withColumn("_keep", F.col("_keep") | F.col(key).isNull())
    return join_winners(df, dedup_winners(df, key, order_col, score_cols), order_col).withColumn(
        "_keep", F.col("_keep_pos").isNotNull() | F.col(key).isNull()
    ).drop("_keep_pos")


def join_winners(df: DataFrame, winners: DataFrame, order_col: str = SOURCE_POS) -> DataFrame:
    """Rows with ``_keep_pos`` set where the row is its key's winner.

    The join is on the position, which is unique: a key that holds a third of
    all rows meets its winner on one row, and rows without a key are spread.
    """
    return df.join(winners.select("_keep_pos"), F.col(order_col) == F.col("_keep_pos"), "left")


def stage_rows(raw: DataFrame, path: str, more: Callable[[DataFrame], DataFrame] = lambda std: std, made: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``raw`` staged at ``path`` in compact form, each with its number: raw text,
    STAGED_COLUMNS, whether critical fields are missing, fullness, and the columns ``made``
    by ``more`` from the standardised rows. The one pass that parses; ``restore`` gives the
    other standardised columns back from the raw text.
    """
    std = standardize(raw)
    kept = [c for c in std.columns if c.startswith("_") or c in STAGED_COLUMNS]
    flags = {MISSING: missing_critical(std), SCORE: completeness_score(std), ROW: F.monotonically_increasing_id()}
    return write_staged(more(std).select(*kept, *[v.alias(c) for c, v in flags.items()], *made), path)


def restore(rows: DataFrame, names: list[str], of: Column | None = None) -> DataFrame:
    """Rows of ``stage_rows`` with all standardised columns ``names``; with ``of`` the
    RESTORED_COLUMNS only of the rows that fulfil it."""
    data = {c: F.col(c) if c in STAGED_COLUMNS else _typed(c, F.col(f"{RAW}.{c}")) for c in names}
    data |= {c: F.when(of, data[c]) for c in RESTORED_COLUMNS if c in data and of is not None}
    return rows.select(*[c for c in rows.columns if c not in data], *[v.alias(c) for c, v in data.items()])


def kept_rows(rows: DataFrame, key: str = "order_id", order_col: str = SOURCE_POS, carry: list[str] | None = None, written: list[str] | None = None) -> DataFrame:
    """Numbers (and the columns ``carry``) of the staged rows that stay: the fullest of each
    key, then the earliest. One shuffle of ids, scores, positions and numbers gives them.

    As in ``join_winners`` every row at a winner's position stays. Whether positions come
    twice at all is read off their hashes, and only such rows are joined by position;
    the tables staged for that are added to ``written``.
    """
    spark, taken = rows.sparkSession, [ROW, *(carry or [])]
    best = F.min(F.struct((-F.col(SCORE)).alias("neg_score"), F.col(order_col).alias("pos"), *taken))
    of_key = rows.select(F.col(f"{RAW}.{key}").alias(key), order_col, SCORE, *taken).where(F.col(key).isNotNull())
    winners = of_key.groupBy(key).agg(best.alias("best")).where("best.pos IS NOT NULL").select("best.pos", *[f"best.{c}" for c in taken])
    staged: list[str] = []
    placed = rows.where(F.col(order_col).isNotNull()).select(F.xxhash64(order_col).alias("hash"), F.col(order_col).alias("pos"), *taken)
    twice = materialize(placed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "positions-twice", staged)
    if twice.isEmpty():
        drop_tables(spark, staged)
        return winners.drop("pos")
    winners = materialize(winners, "winners", staged)
    if written is not None:
        written += staged
    others = placed.join(twice, "hash", "left_semi").join(winners, "pos", "left_semi").join(winners, ROW, "left_anti")
    return winners.select(taken).unionByName(others.select(taken))


def keep_bits(numbers: DataFrame) -> DataFrame:
    """One row per 32,768 row numbers: a bit for each number that occurs in ``numbers``, in 1,024 words of 32."""
    bitmaps = numbers.groupBy(F.bitmap_bucket_number(ROW).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(ROW)).alias("_bits"))
    # a bitmap's first byte holds its lowest bits; a word is read from a row without copying the 4 KB
    byte = lambda i: F.conv(F.hex(F.substring("_bits", i, F.lit(1))), 16, 10).cast("int")
    word = lambda i: reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(byte(i * 4 + k + 1), 8 * k) for k in range(4)])
    return bitmaps.select("_bucket", F.transform(F.sequence(F.lit(0), F.lit(1023)), word).alias("_words"))


def join_keep(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """``_keep``: whether a row's number has its bit in ``bits`` (a staged table of ``keep_bits``).

    The rows stay where they are while the bits are small enough to go to all tasks.
    """
    if bits.count() <= BROADCAST_BUCKETS:
        bits = F.broadcast(bits)
    at = F.bitmap_bit_position(ROW)
    has = F.getbit(F.get("_words", F.shiftright(at, 5).cast("int")), (at % 32).cast("int")) == 1
    return rows.join(bits, F.bitmap_bucket_number(ROW) == F.col("_bucket"), "left").withColumn("_keep", F.coalesce(has, F.lit(False))).drop("_bucket", "_words")


def detect_duplicates(df: DataFrame, key: str = "order_id") -> DataFrame:
    """Every member of a duplicated key, flagged.

    The counts are staged first: a join side that is an aggregate on its own
    exchange is one that AQE does not split, a plain scan of it is.
    """
    counts = materialize(df.groupBy(key).agg(F.count(F.lit(1)).alias("dup_count")), "dup-counts")
    return df.join(counts, key, "left").withColumn("is_duplicate", F.col("dup_count") > 1)


def dedup_keep_fullest(df: DataFrame, key: str = "order_id", order_col: str = SOURCE_POS,
                       score_cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped); dropped rows carry WARNING + REDUNDANT_DUPLICATE_ORDER_ID."""
    marked = mark_duplicates(df, key, order_col, score_cols)
    kept = marked.filter("_keep").drop("_keep", "_dup_count")
    dropped = marked.filter(~F.col("_keep")).select(
        *[c for c in df.columns if c.startswith("_")],
        F.lit("WARNING").alias("severity"),
        F.lit("REDUNDANT_DUPLICATE_ORDER_ID").alias("failure_reason"),
    )
    return kept, dropped


def add_customer_fields(df: DataFrame, seed: int = R.NAME_SEED, of: Column | None = None) -> DataFrame:
    """customer_name / customer_type from salted SHA-256 of the customer id; with ``of``
    only for the rows that fulfil it.

    The two digests are their own columns first, so each is computed once
    per row (the fold reads a digest once per chunk).
    """
    if "customer" not in df.columns:
        return df
    grid = len(R.FIRST_NAMES) * len(R.LAST_NAMES)
    cust = F.col("customer") if of is None else F.when(of, F.col("customer"))
    with_h = df.withColumns({
        "_h_name": S.sha256_hex(S.name_seed_text(cust, seed)),
        "_h_type": S.sha256_hex(S.type_seed_text(cust, seed)),
    })
    return with_h.withColumns({
        "customer_name": F.when(cust.isNotNull(), S.name_from_index(S.hex_mod("_h_name", grid))),
        "customer_type": F.when(cust.isNotNull(), S.type_from_bucket(S.hex_mod("_h_type", 100))),
    }).drop("_h_name", "_h_type")
