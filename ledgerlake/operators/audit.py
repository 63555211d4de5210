"""Audit: rejection breakdowns, quality dimensions, reconciliation, and the
post-run gold checks. Each is one aggregate pass over its input."""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import reference_data as R
from .validation import RULE_CODES, pct_2dp


def reason_counts(error_log: DataFrame) -> DataFrame:
    """Count per individual reason code (multi-code reasons split on "; ")."""
    return (
        error_log.select(F.explode(F.split("failure_reason", "; ")).alias("reason"))
        .groupBy("reason").agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "reason")
    )


def severity_counts(error_log: DataFrame) -> DataFrame:
    """Count per severity, zero-filled over the report's fixed labels."""
    counts = error_log.groupBy("severity").agg(F.count(F.lit(1)).alias("count"))
    labels = counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in R.REPORT_SEVERITIES])).alias("severity"))
    return (
        labels.join(counts, "severity", "full")
        .select("severity", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
    )


def _dimension_counts(error_log: DataFrame) -> list[Column]:
    return [F.count_if(c).alias(n) for n, c in _dimension_flags()]


def quality_dimensions(raw_count: DataFrame, error_log: DataFrame) -> DataFrame:
    """Five scores: share of raw rows NOT rejected for that dimension (2 dp)."""
    fails = error_log.agg(*_dimension_counts(error_log))
    j = raw_count.crossJoin(fails)
    return j.select(*[
        pct_2dp(f"(raw_total_rows - {n.replace('_score', '_failures')})", "raw_total_rows").alias(n)
        for n in R.QUALITY_DIMENSIONS
    ])


def status_label(score: Column) -> Column:
    return (
        F.when(score >= R.PASS_THRESHOLD, F.lit("PASS"))
        .when(score >= R.WARN_THRESHOLD, F.lit("PASS_WITH_WARNINGS"))
        .otherwise(F.lit("FAIL"))
    )


def count_rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def reconcile_counts(raw: DataFrame, gold: DataFrame, error_log: DataFrame) -> DataFrame:
    """raw = valid + rejected, checked from three independent counts."""
    j = count_rows(raw, "raw_total_rows").crossJoin(count_rows(gold, "valid_rows_gold")).crossJoin(
        count_rows(error_log, "rejected_rows_total"))
    delta = F.col("raw_total_rows") - (F.col("valid_rows_gold") + F.col("rejected_rows_total"))
    return j.select(
        "raw_total_rows", "valid_rows_gold", "rejected_rows_total",
        delta.alias("mismatch_delta"),
        F.when(delta == 0, F.lit("VERIFIED")).otherwise(F.lit("ERROR_IN_CALCULATION")).alias("checksum_status"),
    )


def pipeline_status(counts: DataFrame) -> DataFrame:
    score = pct_2dp("valid_rows_gold", "raw_total_rows")
    return counts.select(score.alias("overall_quality_score"), status_label(score).alias("pipeline_status"))


def audit_report(raw: DataFrame, gold: DataFrame, error_log: DataFrame) -> DataFrame:
    """Flat one-row report: reconciliation, status and quality dimensions."""
    counts = reconcile_counts(raw, gold, error_log)
    dims = quality_dimensions(counts.select("raw_total_rows"), error_log)
    return _flat_report(counts.crossJoin(dims))


def _flat_report(counts_and_dims: DataFrame) -> DataFrame:
    score = pct_2dp("valid_rows_gold", "raw_total_rows")
    return counts_and_dims.select(
        "checksum_status", status_label(score).alias("pipeline_status"),
        "raw_total_rows", "valid_rows_gold", "rejected_rows_total", "mismatch_delta",
        *R.QUALITY_DIMENSIONS, score.alias("overall_quality_score"),
    )


def tagged_counts(raw: DataFrame, tagged: DataFrame, stage: str = "stage") -> DataFrame:
    """Reconciliation counts and dimension failures from the pipeline's
    tagged rows (one row per raw row, ``stage`` NULL for gold rows).

    Gold, rejected and every dimension count come out of ONE aggregate over
    the tagged table instead of one job per filtered copy of it. The raw
    count stays an independent scan of the source, so the checksum still
    checks raw rows against outcomes.
    """
    rejected = F.col(stage).isNotNull()
    tag = tagged.agg(
        F.count_if(~rejected).alias("valid_rows_gold"),
        F.count_if(rejected).alias("rejected_rows_total"),
        *[F.count_if(rejected & c).alias(n) for n, c in _dimension_flags()],
    )
    j = count_rows(raw, "raw_total_rows").crossJoin(tag)
    return with_checksum(j)


def with_checksum(counts: DataFrame) -> DataFrame:
    delta = F.col("raw_total_rows") - (F.col("valid_rows_gold") + F.col("rejected_rows_total"))
    return counts.select(
        "*",
        delta.alias("mismatch_delta"),
        F.when(delta == 0, F.lit("VERIFIED")).otherwise(F.lit("ERROR_IN_CALCULATION")).alias("checksum_status"),
    )


# ----------------------------------------------- counters of the writes ---

#: How the reason codes of missing fields and of price floors begin.
MISSING_PREFIX, FLOOR_PREFIX = "UNPARSEABLE_OR_MISSING_", "UNIT_PRICE_LOW_"


def reason_codes() -> list[str]:
    """Every single reason code that a stage can give."""
    critical = [c.upper() for c in R.CRITICAL_COLUMNS]
    missing = ["_".join(x) for n in range(1, len(critical) + 1) for x in combinations(critical, n)]
    floors = [p.upper().replace(" ", "_").replace(".", "") for p in R.PRODUCT_MIN_PRICE]
    return [f"{MISSING_PREFIX}{m}" for m in missing] + [f"{FLOOR_PREFIX}{f}" for f in floors] + list(RULE_CODES)


def log_counters() -> list[Column]:
    """What an error log tells the report, as aggregates to observe while it is written."""
    reason = F.coalesce(F.col("failure_reason"), F.lit(""))
    listed = F.concat(F.lit("; "), reason, F.lit("; "))

    def has(code: str) -> Column:
        # most rows hold no code of a family: its members are not looked for one by one
        family = [listed.contains(f"; {x}") for x in (MISSING_PREFIX, FLOOR_PREFIX) if code.startswith(x)]
        return reduce(lambda a, b: a & b, [*family, listed.contains(f"; {code}; ")])

    return [
        F.count(F.lit(1)).alias("rejected_rows_total"), *[F.count_if(c).alias(n) for n, c in _dimension_flags()],
        *[F.count_if(F.col("severity") == x).alias(f"severity:{x}") for x in (*R.REPORT_SEVERITIES,)],
        F.count_if(~F.coalesce(F.col("severity").isin(list(R.REPORT_SEVERITIES)), F.lit(False))).alias("severity:other"),
        *[F.count_if(has(x)).alias(f"reason:{x}") for x in reason_codes()],
        F.coalesce(F.sum(F.size(F.split(reason, "; "))), F.lit(0)).alias("reasons"),
    ]


def observed_report(spark: SparkSession, raw: dict, gold: dict, log: dict) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(flat report, reason counts, severity counts) from the counters of the reads and
    writes, without a scan; None if the log holds a reason or severity that is not known."""
    reasons = {k.split(":", 1)[1]: n for k, n in log.items() if k.startswith("reason:")}
    if sum(reasons.values()) != log["reasons"] or log["severity:other"]:
        return None
    counts = {"raw_total_rows": raw["n"], "valid_rows_gold": gold["n"], "rejected_rows_total": log["rejected_rows_total"]}
    counts |= {n: log[n] for n, _ in _dimension_flags()}
    one = with_checksum(spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts)))
    pairs = lambda d, name: spark.createDataFrame([(k, n) for k, n in d.items()], f"{name} string, count long")
    severities = {x: log[f"severity:{x}"] for x in R.REPORT_SEVERITIES}
    return flat_report(one), pairs(reasons, "reason").where("count > 0").orderBy(F.desc("count"), "reason"), pairs(severities, "severity")


def _dimension_flags() -> list[tuple[str, Column]]:
    reason = F.coalesce(F.col("failure_reason"), F.lit(""))
    # the patterns are lists of words: looking for these is cheaper than a regular expression
    holds = lambda rx: reduce(lambda a, b: a | b, [reason.contains(w) for w in rx.split("|")]) if re.fullmatch(r"[A-Z_|]+", rx) else reason.rlike(rx)
    return [(name.replace("_score", "_failures"), holds(rx)) for name, rx in R.QUALITY_DIMENSIONS.items()]


def audit_report_tagged(raw: DataFrame, tagged: DataFrame, stage: str = "stage") -> DataFrame:
    """:func:`audit_report` from the tagged rows (see :func:`tagged_counts`)."""
    return flat_report(tagged_counts(raw, tagged, stage))


def flat_report(c: DataFrame) -> DataFrame:
    """The flat report from one row of counts and dimension failures."""
    dims = [
        pct_2dp(f"(raw_total_rows - {n.replace('_score', '_failures')})", "raw_total_rows").alias(n)
        for n in R.QUALITY_DIMENSIONS
    ]
    return _flat_report(c.select("*", *dims))


def nested_report(flat: DataFrame, reasons: DataFrame, severities: DataFrame) -> DataFrame:
    """The report as one row of nested structs/maps (for the JSON sink)."""
    pct = lambda c: F.concat(F.col(c).cast("string"), F.lit("%"))
    sev = severities.agg(F.map_from_entries(F.collect_list(F.struct("severity", "count"))).alias("severity_breakdown"))
    rsn = reasons.agg(F.map_from_entries(F.collect_list(F.struct("reason", "count"))).alias("rejection_reason_breakdown"))
    return flat.crossJoin(sev).crossJoin(rsn).select(
        F.struct(
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("audit_timestamp"),
            "checksum_status", "pipeline_status",
        ).alias("report_metadata"),
        F.struct("raw_total_rows", "valid_rows_gold", "rejected_rows_total", "mismatch_delta").alias("summary_counts"),
        F.struct(*[pct(c).alias(c) for c in (
            "completeness_score", "validity_score", "uniqueness_score", "accuracy_score",
            "consistency_score", "overall_quality_score")]).alias("data_quality_dimensions"),
        "severity_breakdown", "rejection_reason_breakdown",
    )


def gold_audit(gold: DataFrame, error_log: DataFrame) -> DataFrame:
    """Post-run checks as (check, failures, status) rows.

    The counters are one global aggregate. Repeated ids are counted apart, so
    that only the id column is shuffled by id.
    """
    cols = gold.columns
    profit_bad = F.count_if(F.coalesce(F.abs(F.col("profit_usd") - (F.col("amount_usd") - F.col("cost_usd"))) > 0.01, F.lit(False)))
    margin_bad = F.count_if(F.coalesce((F.col("margin_pct") < -100) | (F.col("margin_pct") > 100), F.lit(False)))
    aggs = [F.count_if(F.col(c).isNull()).alias(f"nulls:{c}") for c in cols] + [
        profit_bad.alias("profit_calculation"),
        margin_bad.alias("margin_bounds"),
    ]
    missing_cols = len({"severity", "failure_reason"} - set(error_log.columns))
    per_id = gold.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = per_id.agg(F.coalesce(F.sum("n") - F.count("order_id"), F.lit(0)).alias("duplicate_order_ids"))
    one = gold.agg(*aggs).crossJoin(repeated).withColumn("error_log_columns", F.lit(missing_cols).cast("bigint"))
    names = [f"nulls:{c}" for c in cols] + ["duplicate_order_ids", "profit_calculation", "margin_bounds", "error_log_columns"]
    stacked = one.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").cast("bigint").alias("failures")) for n in names
    ])).alias("r")).select("r.*")
    return stacked.withColumn("status", F.when(F.col("failures") == 0, F.lit("PASSED")).otherwise(F.lit("FAILED")))
