"""End-to-end data-quality pipeline: raw text -> gold + error log + audit.

Single pass: every raw row is tagged with its outcome (kept, rejected at the
clean stage, dropped as a duplicate, rejected by validation) in one
``audited`` DataFrame. Gold, the error log and every audit count are
filters / aggregates of it. The only wide operations are the duplicate
aggregate on ``order_id``, the join of its winners on the row position and the
exact quartile passes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import cleaning as C
from ..operators import enrichment as E
from ..operators import validation as V
from ..session import drop_tables, materialize, new_table, write_staged
from ..sources import files as IO

DATA_COLUMNS = (
    "order_id", "order_date", "amount", "discount_rate", "currency", "region", "country",
    "order_status", "customer", "product", "category", "payment_method",
)
DERIVED_COLUMNS = (
    "customer_name", "customer_type", "amount_usd", "cost_usd", "profit_usd", "margin_pct",
    "order_year", "order_month", "order_quarter", "is_loss_making", "is_high_margin", "is_anomaly",
)


@dataclass
class PipelineResult:
    raw: DataFrame
    audited: DataFrame
    gold: DataFrame
    error_log: DataFrame
    tables: list[str] = field(default_factory=list)

    def close(self) -> None:
        """Delete the staged table behind the results, once they are written."""
        drop_tables(self.raw.sparkSession, self.tables)
        self.tables = []


def _stage(miss: Column) -> Column:
    return (
        F.when(miss, F.lit("CLEAN"))
        .when(~F.col("_keep"), F.lit("DEDUP"))
        .when(F.col("severity") != "OK", F.lit("VALIDATE"))
    )


def _survives() -> Column:
    """Neither a critical field missing nor a redundant duplicate; other rows get no name, region and country."""
    return ~F.col(C.MISSING) & F.col("_keep")


def audited_rows(raw: DataFrame, checkpoint: bool = False, anomaly: bool = True, written: list[str] | None = None) -> DataFrame:
    """Every raw row with its outcome. With ``checkpoint`` the rows are parsed and judged once
    into a staged folder (its path is added to ``written``), and what follows reads it row by
    row; without, nothing but the quartiles runs before the result is used."""
    if checkpoint:
        marked, bounds = _staged_marks(raw, anomaly, written)
    else:
        std = C.standardize(raw)
        miss = C.missing_critical(std)
        winners = C.dedup_winners(std, score_cols=C.data_columns(std), eligible=~miss)
        marked = (
            C.join_winners(std.withColumn("_missing", miss), winners)
            .withColumn("_keep", F.col("_missing") | F.col("_keep_pos").isNotNull())
            .drop("_keep_pos")
        )
        marked = marked.withColumns({c: F.when(_survives(), F.col(c)) for c in C.RESTORED_COLUMNS if c in marked.columns})
    # as in a stage-at-a-time run, rows that went before get no name
    enriched = E.convert_currency(C.add_customer_fields(marked, of=_survives()))
    if not checkpoint:
        bounds = E.iqr_bounds(enriched.filter(_survives()), "amount_usd") if anomaly else None
    out = E.margin_flags(E.date_parts(E.profit_margin_columns(E.attach_cost(enriched))))
    if anomaly:
        out = out.withColumn("is_anomaly", F.lit(False)) if bounds is None else E.iqr_anomaly(out, "amount_usd", bounds)
    if not checkpoint:
        out = V.validate_rules(out)
    stage = _stage(F.col("_missing"))
    severity = (
        F.when(F.col("_missing"), F.lit("CRITICAL"))
        .when(~F.col("_keep"), F.lit("WARNING"))
        .otherwise(F.col("severity"))
    )
    reason = (
        F.when(F.col("_missing"), C.missing_reason(marked))
        .when(~F.col("_keep"), F.lit("REDUNDANT_DUPLICATE_ORDER_ID"))
        .when(F.col("severity") != "OK", F.col("validation_issues"))
    )
    return out.select(
        F.col(C.SOURCE_POS).alias("source_pos"), C.RAW,
        stage.alias("stage"), severity.alias("severity"), reason.alias("failure_reason"),
        F.col("validation_issues"),
        *_columns(out),
    )


def _judged(std: DataFrame) -> DataFrame:
    """Standardised rows with ``validation_issues`` and ``severity``."""
    return V.validate_rules(E.profit_margin_columns(E.attach_cost(E.convert_currency(std))))


def _staged_marks(raw: DataFrame, anomaly: bool, written: list[str] | None) -> tuple[DataFrame, tuple[float, float] | None]:
    """Standardised rows with ``_missing``, ``_keep`` and the rules' verdict, and the anomaly fences.

    One folder is staged: the rows, and a bit for each row that stays. Wide rows are never
    shuffled, and the rules are not worked out again in every filter on an outcome.
    """
    spark = raw.sparkSession
    folder = new_table(spark, "audited")
    rows = C.stage_rows(raw, f"{folder}/rows", _judged, ("validation_issues", "severity"))
    eligible = rows.filter(~F.col(C.MISSING))
    if anomaly:
        amounts: list[str] = []
        kept = C.kept_rows(E.convert_currency(eligible), carry=["amount_usd"], written=amounts)
        kept = materialize(kept, "kept", amounts)
        bounds = E.iqr_bounds(kept, "amount_usd")
        bits = write_staged(C.keep_bits(kept), f"{folder}/bits")
        drop_tables(spark, amounts)
    else:
        read: list[str] = []
        bounds, bits = None, write_staged(C.keep_bits(C.kept_rows(eligible, written=read)), f"{folder}/bits")
        drop_tables(spark, read)
    if written is not None:
        written.append(folder)
    names = [n for n in C.snake_case_columns(raw).columns if not n.startswith("_")]
    marked = C.join_keep(rows, bits).withColumn("_keep", F.col(C.MISSING) | F.col("_keep"))
    return C.restore(marked, names, of=_survives()), bounds


def _columns(df: DataFrame) -> list[str]:
    """The gold columns; without ``is_anomaly`` where the quartile passes were not asked for."""
    return [c for c in (*DATA_COLUMNS, *DERIVED_COLUMNS) if c in df.columns]


def gold_from(audited: DataFrame) -> DataFrame:
    return audited.filter(F.col("stage").isNull()).select(*_columns(audited))


def error_log_from(audited: DataFrame) -> DataFrame:
    """Rejected rows: outcome, the raw text of every field, and the typed
    values for rows that reached validation (NULL for earlier stages)."""
    rej = audited.filter(F.col("stage").isNotNull())
    val = F.col("stage") == "VALIDATE"
    raw_fields = [F.col(f"{C.RAW}.{c}").alias(f"raw_{c}") for c in DATA_COLUMNS]
    typed = [F.when(val, F.col(c)).alias(c) for c in _columns(audited)]
    return rej.select(
        "source_pos", "stage", "severity", "failure_reason",
        F.when(val, F.col("validation_issues")).alias("validation_issues"),
        *raw_fields, *typed,
    )


def run(raw: DataFrame, checkpoint: bool = False, anomaly: bool = True) -> PipelineResult:
    tables: list[str] = []
    audited = audited_rows(raw, checkpoint, anomaly, tables)
    return PipelineResult(raw, audited, gold_from(audited), error_log_from(audited), tables)


def report(res: PipelineResult) -> DataFrame:
    """The flat audit report; every outcome count is one aggregate over the
    tagged rows (gold and the error log are filters of them)."""
    return A.audit_report_tagged(res.raw, res.audited)


def counts(res: PipelineResult) -> DataFrame:
    """raw / gold / rejected counts, mismatch and checksum status."""
    return A.tagged_counts(res.raw, res.audited).select(
        "raw_total_rows", "valid_rows_gold", "rejected_rows_total", "mismatch_delta", "checksum_status")


# --------------------------------------------------- from file to files ---

@dataclass
class FileRun:
    """What one call from a raw file wrote; the reports are read off the writes' counters."""

    source: str
    gold: str
    error_log: str
    report_json: str
    report: DataFrame
    reasons: DataFrame
    severities: DataFrame


def run_files(spark: SparkSession, candidates: list[str], out: str) -> FileRun:
    """The first of the candidate CSVs that exists -> gold CSV, error log CSV and JSON report
    in the folder ``out``.

    Raw rows are counted while they are staged, gold and rejected rows while they are
    written: the report takes no scan of its own, and its checksum compares three counts
    of three different reads and writes.
    """
    source = IO.first_existing(spark, candidates)
    if source is None:
        raise FileNotFoundError("no raw sales file at " + " or ".join(candidates))
    lines: list[str] = []
    staged: list[str] = []
    n, g, log = Observation(), Observation(), Observation()
    raw = IO.read_raw_sales(spark, source, lines).observe(n, F.count(F.lit(1)).alias("n"))
    audited = audited_rows(raw, checkpoint=True, written=staged)
    drop_tables(spark, lines)  # only the staged rows are still read
    paths = [f"{out.rstrip('/')}/{x}" for x in ("validated_data.csv", "error_log.csv", "validation_report.json")]
    IO.write_gold(gold_from(audited).observe(g, F.count(F.lit(1)).alias("n")), paths[0])
    IO.write_error_log(error_log_from(audited).observe(log, *A.log_counters()), paths[1])
    parts = A.observed_report(spark, n.get, g.get, log.get)
    if parts is None:  # a code that is not listed: count what the log holds
        errors = error_log_from(audited)
        counted = A.with_checksum(spark.createDataFrame([(n.get["n"], g.get["n"])], "raw_total_rows long, valid_rows_gold long").crossJoin(errors.agg(*A.log_counters())))
        parts = [materialize(x, "report", None) for x in (A.flat_report(counted), A.reason_counts(errors), A.severity_counts(errors))]
    IO.write_report_json(A.nested_report(*parts), paths[2])
    drop_tables(spark, staged)
    return FileRun(source, *paths, *parts)


# ------------------------------------------- stage-by-stage composition ---

def staged_standardize(raw: DataFrame) -> DataFrame:
    """The standardised stage written once to the checkpoint folder.

    A stage-at-a-time run splits it into kept and rejected rows. Filtering
    the lazy plan instead would push each split predicate below the
    projection, re-running the whole cleaning tree inside the filter (and
    generating one method too large for the JIT); the staged table is read
    with a plain column predicate.
    """
    return materialize(C.standardize(raw), "standardized")


def stage_outputs(raw: DataFrame, anomaly: bool = True) -> dict[str, DataFrame]:
    """The same pipeline as separate stage outputs, joined back with
    ``unionByName`` — the shape of a stage-at-a-time run."""
    names = [n for n in C.snake_case_columns(raw).columns if not n.startswith("_")]
    std = C.restore(C.stage_rows(raw, new_table(raw.sparkSession, "standardized")), names)
    kept, clean_rej = C.reject_missing(std)
    deduped, dropped = C.dedup_keep_fullest(kept, score_cols=names)
    enriched = E.convert_currency(C.add_customer_fields(deduped))
    transformed = E.transform_rows(enriched.drop("amount_usd"))
    if anomaly:
        transformed = E.iqr_anomaly(transformed, "amount_usd", E.iqr_bounds(enriched, "amount_usd"))
    validated = V.validate_rules(transformed)
    passed, val_rej = V.split_valid_rejected(validated)
    return {
        "standardized": std, "clean_rejects": clean_rej, "deduped": deduped, "dedup_drops": dropped,
        "transformed": transformed, "validated": validated, "passed": passed, "validate_rejects": val_rej,
    }


def consolidate_rejections(clean_rej: DataFrame, dropped: DataFrame, val_rej: DataFrame) -> DataFrame:
    """Union of all stage rejects aligned by column name (missing -> NULL)."""
    tag = lambda df, s: df.withColumn("stage", F.lit(s))
    return (
        tag(clean_rej, "CLEAN")
        .unionByName(tag(dropped, "DEDUP"), allowMissingColumns=True)
        .unionByName(tag(val_rej, "VALIDATE"), allowMissingColumns=True)
    )
