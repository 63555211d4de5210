"""Registered data-quality pipeline queries over the ``raw_sales`` view."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from .. import reference_data as R
from ..functions import scalars as S
from ..operators import audit as A
from ..operators import cleaning as C
from ..operators import parity as D
from ..operators import validation as V
from ..session import ensure_checkpoint_dir
from ..sources import files as IO
from ..sources import tables as T
from . import pipeline as PL
from . import pipeline_sql as PS

DATA = list(PL.DATA_COLUMNS)
GOLD = DATA + list(PL.DERIVED_COLUMNS)


def _raw(s, sf):
    return T.raw_sales(s, sf)


def _audited(s, sf, anomaly=False):
    # Parsed and judged once into the checkpoint folder: the duplicate step,
    # the quartile passes and the result read the staged rows.
    ensure_checkpoint_dir(s)
    return PL.audited_rows(_raw(s, sf), checkpoint=True, anomaly=anomaly)


def _res(s, sf, anomaly=False):
    ensure_checkpoint_dir(s)
    return PL.run(_raw(s, sf), checkpoint=True, anomaly=anomaly)


def _raw_staging(s, sf):
    ensure_checkpoint_dir(s)
    return _raw(s, sf)


def _staged(s, sf):
    # Queries that split the standardised rows read them from a staged table.
    ensure_checkpoint_dir(s)
    return PL.staged_standardize(_raw(s, sf))


def _scratch(s, name):
    return os.path.join(ensure_checkpoint_dir(s), f"{name}-{uuid.uuid4().hex}")


def _survivors(df):
    return df.filter(F.col("stage").isNull() | (F.col("stage") == "VALIDATE"))


W = PS.with_pipeline
SURV = "(stage IS NULL OR stage = 'VALIDATE')"
RAW_SNAKE = ", ".join(f'"{h}" AS {n}' for h, n in PS.RAW_NAMES.items())


def build():
    q, o = {}, {}

    # ---- standardisation: P1-P6, P19, P20, F7, P23
    q["snake_case_columns"] = lambda s, sf: C.snake_case_columns(_raw(s, sf))
    o["snake_case_columns"] = W() + f"SELECT _source_pos, {RAW_SNAKE} FROM raw_sales"
    q["na_tokens_to_null"] = lambda s, sf: C.na_tokens_to_null(_raw(s, sf))
    o["na_tokens_to_null"] = W() + "SELECT _source_pos, " + ", ".join(f'{PS.na(chr(34) + h + chr(34))} AS "{h}"' for h in T.RAW_HEADERS) + " FROM raw_sales"

    std = lambda s, sf: C.standardize(_raw(s, sf))
    q["clean_numeric"] = lambda s, sf: std(s, sf).select("_source_pos", F.col("_raw.amount").alias("amount_text"), "amount", "discount_rate")
    o["clean_numeric"] = W() + "SELECT _source_pos, r_amount AS amount_text, amount, discount_rate FROM std"
    q["parse_mixed_date"] = lambda s, sf: std(s, sf).select("_source_pos", F.col("_raw.order_date").alias("order_date_text"), "order_date")
    o["parse_mixed_date"] = W() + "SELECT _source_pos, r_order_date AS order_date_text, order_date FROM std"
    q["normalize_category"] = lambda s, sf: std(s, sf).select("_source_pos", "currency", "country")
    o["normalize_category"] = W() + "SELECT _source_pos, currency, country FROM std"
    q["normalize_region"] = lambda s, sf: std(s, sf).select("_source_pos", "region")
    o["normalize_region"] = W() + "SELECT _source_pos, region FROM std"
    q["normalize_status"] = lambda s, sf: std(s, sf).select("_source_pos", "order_status")
    o["normalize_status"] = W() + "SELECT _source_pos, order_status FROM std"
    q["canonical_region"] = lambda s, sf: std(s, sf).select(
        "_source_pos", S.canonical_region("region").alias("region_name"), S.region_group(S.canonical_region("region")).alias("region_group"))
    from .sql_text import canonical_region as _cr, region_group as _rg
    o["canonical_region"] = W() + f"SELECT _source_pos, {_cr('region')} AS region_name, {_rg(_cr('region'))} AS region_group FROM std"
    q["region_group"] = lambda s, sf: std(s, sf).groupBy(
        S.region_group(S.canonical_region("region")).alias("region_group")).agg(F.count(F.lit(1)).alias("rows"))
    o["region_group"] = W() + f"SELECT {_rg(_cr('region'))} AS region_group, count(*) AS rows FROM std GROUP BY 1"
    q["parse_filter_date"] = lambda s, sf: std(s, sf).select("_source_pos", S.parse_filter_date(F.regexp_replace("_raw.order_date", "-0", "-")).alias("filter_date"))  # ISO days, unpadded
    o["parse_filter_date"] = W() + f"SELECT _source_pos, CAST({PS.parse_filter_date("replace(r_order_date, '-0', '-')")} AS DATE) AS filter_date FROM std"
    q["parse_float"] = lambda s, sf: std(s, sf).select("_source_pos", S.parse_float(F.col("_raw.discount_rate")).alias("discount_value"))
    o["parse_float"] = W() + (
        "SELECT _source_pos, CASE WHEN isnan(v) OR isinf(v) THEN NULL ELSE v END AS discount_value "
        "FROM (SELECT _source_pos, TRY_CAST(trim(r_discount_rate) AS DOUBLE) AS v FROM std)"
    )
    q["missing_critical"] = lambda s, sf: std(s, sf).select("_source_pos", C.missing_critical(std(s, sf)).alias("is_missing"))
    o["missing_critical"] = W() + "SELECT _source_pos, _missing AS is_missing FROM std_m"
    q["product_code"] = lambda s, sf: std(s, sf).select("_source_pos", S.product_code("product").alias("product_code"))
    o["product_code"] = W() + "SELECT _source_pos, replace(replace(upper(product), ' ', '_'), '.', '') AS product_code FROM std"

    # ---- clean-stage rejects, duplicates: Q1-Q3, W2, J4
    q["reject_missing"] = lambda s, sf: C.reject_missing(_staged(s, sf))[1].select(
        "_source_pos", "severity", "failure_reason", *[F.col(f"_raw.{c}").alias(f"raw_{c}") for c in DATA])
    o["reject_missing"] = W() + (
        "SELECT _source_pos, 'CRITICAL' AS severity, _miss_reason AS failure_reason, "
        + ", ".join(f"r_{c} AS raw_{c}" for c in DATA) + " FROM std_m WHERE _missing"
    )
    kept = lambda s, sf: C.reject_missing(_staged(s, sf))[0]
    q["dedup_keep_fullest"] = lambda s, sf: C.dedup_keep_fullest(kept(s, sf), score_cols=DATA)[0].select("_source_pos", "order_id")
    o["dedup_keep_fullest"] = W() + "SELECT _source_pos, order_id FROM ranked WHERE NOT _missing AND _rank = 1"
    q["detect_duplicates"] = lambda s, sf: C.detect_duplicates(kept(s, sf)).select("_source_pos", "order_id", "dup_count", "is_duplicate")
    o["detect_duplicates"] = W() + (
        "SELECT _source_pos, order_id, count(*) OVER (PARTITION BY order_id) AS dup_count, "
        "count(*) OVER (PARTITION BY order_id) > 1 AS is_duplicate FROM std_m WHERE NOT _missing"
    )
    q["dedup_rank"] = lambda s, sf: C.mark_duplicates(kept(s, sf), score_cols=DATA).select("_source_pos", "order_id", F.col("_keep").alias("is_kept"))
    o["dedup_rank"] = W() + "SELECT _source_pos, order_id, _rank = 1 AS is_kept FROM ranked WHERE NOT _missing"
    q["raw_backlink"] = lambda s, sf: _res(s, sf).error_log.select("source_pos", "stage", *[f"raw_{c}" for c in DATA])
    o["raw_backlink"] = W(PS.error_log_sql()) + "SELECT source_pos, stage, " + ", ".join(f"raw_{c}" for c in DATA) + " FROM error_log"

    # ---- enrichment: P9-P16, J5, J3
    q["synthetic_customer_name"] = lambda s, sf: std(s, sf).select("customer").distinct().select(
        "customer", S.synthetic_customer_name("customer").alias("customer_name"))
    o["synthetic_customer_name"] = W() + f"SELECT customer, {PS.names_sql('customer')[0]} AS customer_name FROM (SELECT DISTINCT customer FROM std)"
    q["customer_type"] = lambda s, sf: std(s, sf).select("customer").distinct().select("customer", S.customer_type("customer").alias("customer_type"))
    o["customer_type"] = W() + f"SELECT customer, {PS.names_sql('customer')[1]} AS customer_type FROM (SELECT DISTINCT customer FROM std)"
    sv = lambda s, sf, *c: _survivors(_audited(s, sf)).select("source_pos", *c)
    for key, cols in {
        "convert_currency": ("currency", "amount", "amount_usd"),
        "attach_cost": ("product", "cost_usd"),
        "profit_margin_columns": ("order_status", "profit_usd", "margin_pct"),
        "date_parts": ("order_year", "order_month", "order_quarter"),
        "margin_flags": ("is_loss_making", "is_high_margin"),
    }.items():
        q[key] = (lambda cc: lambda s, sf: sv(s, sf, *cc))(cols)
        o[key] = W() + f"SELECT source_pos, {', '.join(cols)} FROM audited WHERE {SURV}"
    q["iqr_anomaly"] = lambda s, sf: _survivors(_audited(s, sf, anomaly=True)).select("source_pos", "amount_usd", "is_anomaly")
    o["iqr_anomaly"] = W() + f"SELECT source_pos, amount_usd, is_anomaly FROM audited WHERE {SURV}"
    q["scalar_cross_join"] = lambda s, sf: _survivors(_audited(s, sf, anomaly=True)).groupBy("is_anomaly").agg(
        F.count(F.lit(1)).alias("rows"), F.min("amount_usd").alias("min_amount_usd"), F.max("amount_usd").alias("max_amount_usd"))
    o["scalar_cross_join"] = W() + (
        f"SELECT is_anomaly, count(*) AS rows, min(amount_usd) AS min_amount_usd, max(amount_usd) AS max_amount_usd "
        f"FROM audited WHERE {SURV} GROUP BY is_anomaly"
    )
    q["threshold_join"] = lambda s, sf: V.threshold_flags(_survivors(_audited(s, sf))).select("source_pos", "product", "amount_usd", "min_price")
    o["threshold_join"] = W() + (
        f"SELECT source_pos, product, amount_usd, min_price FROM (SELECT *, {PS._dbl_map('product', R.PRODUCT_MIN_PRICE)} AS min_price "
        f"FROM audited WHERE {SURV}) WHERE amount_usd < min_price"
    )

    # ---- validation: Q4-Q7
    q["validate_rules"] = lambda s, sf: _survivors(_audited(s, sf)).select(
        "source_pos", F.coalesce(F.col("failure_reason"), F.lit("")).alias("validation_issues"))
    o["validate_rules"] = W() + f"SELECT source_pos, validation_issues FROM audited WHERE {SURV}"
    q["max_severity"] = lambda s, sf: _survivors(_audited(s, sf)).select("source_pos", "severity")
    o["max_severity"] = W() + f"SELECT source_pos, severity FROM audited WHERE {SURV}"
    q["split_valid_rejected"] = lambda s, sf: V.split_valid_rejected(PL.stage_outputs(_raw_staging(s, sf), anomaly=False)["validated"])[1].select(
        "_source_pos", "severity", "failure_reason")
    o["split_valid_rejected"] = W() + "SELECT source_pos AS _source_pos, severity, failure_reason FROM audited WHERE stage = 'VALIDATE'"
    q["validation_summary"] = lambda s, sf: V.validation_summary(_survivors(_audited(s, sf)).withColumn(
        "severity", F.when(F.col("stage").isNull(), F.lit("OK")).otherwise(F.col("severity"))))
    o["validation_summary"] = W() + (
        f"SELECT total_rows, valid_rows, total_rows - valid_rows AS rejected_rows, coalesce({PS.pct_2dp('valid_rows', 'total_rows')}, 0.0) AS quality_score "
        f"FROM (SELECT count(*) AS total_rows, count_if(stage IS NULL) AS valid_rows FROM audited WHERE {SURV})"
    )

    # ---- outputs: Q6 gold, Q8 consolidated error log, U1, Q16
    q["sales_pipeline"] = lambda s, sf: _res(s, sf, anomaly=True).gold
    o["sales_pipeline"] = W(PS.gold_sql()) + "SELECT * FROM gold"
    q["error_log"] = lambda s, sf: _res(s, sf, anomaly=True).error_log
    o["error_log"] = W(PS.error_log_sql()) + "SELECT * FROM error_log"

    def _consolidated(s, sf):
        st = PL.stage_outputs(_raw_staging(s, sf), anomaly=False)
        u = PL.consolidate_rejections(st["clean_rejects"], st["dedup_drops"], st["validate_rejects"])
        return u.select("_source_pos", "stage", "severity", "failure_reason", F.col("_raw.order_id").alias("raw_order_id"), "amount_usd")

    q["consolidate_rejections"] = _consolidated
    o["consolidate_rejections"] = W(PS.error_log_sql()) + (
        "SELECT source_pos AS _source_pos, stage, severity, failure_reason, raw_order_id, amount_usd FROM error_log"
    )
    def _consolidated_all(s, sf):
        ensure_checkpoint_dir(s)
        st = PL.stage_outputs(_raw(s, sf))
        u = PL.consolidate_rejections(st["clean_rejects"], st["dedup_drops"], st["validate_rejects"])
        typed = [F.when(F.col("stage") == "VALIDATE", F.col(c)).alias(c) for c in GOLD]
        return u.select("_source_pos", "stage", "severity", "failure_reason", "validation_issues", *[F.col(f"_raw.{c}").alias(f"raw_{c}") for c in DATA], *typed)

    q["consolidate_rejections_all"] = _consolidated_all
    o["consolidate_rejections_all"] = W(PS.error_log_sql()) + "SELECT source_pos AS _source_pos, * EXCLUDE (source_pos) FROM error_log"
    q["union_rejections"] = lambda s, sf: _consolidated(s, sf).groupBy("stage").agg(F.count(F.lit(1)).alias("rows"))
    o["union_rejections"] = W(PS.error_log_sql()) + "SELECT stage, count(*) AS rows FROM error_log GROUP BY stage"

    # ---- audit: Q9-Q15
    el = W(PS.error_log_sql(), PS.gold_sql())
    q["reason_counts"] = lambda s, sf: A.reason_counts(_res(s, sf).error_log)
    o["reason_counts"] = el + "SELECT reason, count(*) AS count FROM (SELECT unnest(string_split(failure_reason, '; ')) AS reason FROM error_log) GROUP BY reason"
    q["severity_counts"] = lambda s, sf: A.severity_counts(_res(s, sf).error_log)
    labels = ", ".join(f"('{x}')" for x in R.REPORT_SEVERITIES)
    o["severity_counts"] = el + (
        f"SELECT coalesce(l.severity, c.severity) AS severity, CAST(coalesce(c.count, 0) AS BIGINT) AS count FROM (VALUES {labels}) l(severity) "
        "FULL JOIN (SELECT severity, count(*) AS count FROM error_log GROUP BY severity) c ON l.severity = c.severity"
    )
    dims_sql = ", ".join(
        f"{PS.pct_2dp(f'(raw_total_rows - count_if(coalesce(regexp_matches(failure_reason, {chr(39)}{rx}{chr(39)}), false)))', 'raw_total_rows')} AS {name}"
        for name, rx in R.QUALITY_DIMENSIONS.items()
    )
    counts = "(SELECT count(*) FROM raw_sales) AS raw_total_rows, (SELECT count(*) FROM gold) AS valid_rows_gold, (SELECT count(*) FROM error_log) AS rejected_rows_total"
    q["quality_dimensions"] = lambda s, sf: A.quality_dimensions(A.count_rows(_raw(s, sf), "raw_total_rows"), _res(s, sf).error_log)
    o["quality_dimensions"] = el + f"SELECT {dims_sql} FROM error_log, (SELECT count(*) AS raw_total_rows FROM raw_sales) r GROUP BY raw_total_rows"
    q["reconcile_counts"] = lambda s, sf: PL.counts(_res(s, sf))
    o["reconcile_counts"] = el + (
        "SELECT raw_total_rows, valid_rows_gold, rejected_rows_total, raw_total_rows - (valid_rows_gold + rejected_rows_total) AS mismatch_delta, "
        "CASE WHEN raw_total_rows - (valid_rows_gold + rejected_rows_total) = 0 THEN 'VERIFIED' ELSE 'ERROR_IN_CALCULATION' END AS checksum_status "
        f"FROM (SELECT {counts})"
    )
    status = (
        f"CASE WHEN {PS.pct_2dp('valid_rows_gold', 'raw_total_rows')} >= {R.PASS_THRESHOLD} THEN 'PASS' "
        f"WHEN {PS.pct_2dp('valid_rows_gold', 'raw_total_rows')} >= {R.WARN_THRESHOLD} THEN 'PASS_WITH_WARNINGS' ELSE 'FAIL' END"
    )
    q["pipeline_status"] = lambda s, sf: A.pipeline_status(PL.counts(_res(s, sf)))
    o["pipeline_status"] = el + f"SELECT {PS.pct_2dp('valid_rows_gold', 'raw_total_rows')} AS overall_quality_score, {status} AS pipeline_status FROM (SELECT {counts})"
    q["audit_report"] = lambda s, sf: PL.report(_res(s, sf))
    o["audit_report"] = el + (
        "SELECT CASE WHEN raw_total_rows - (valid_rows_gold + rejected_rows_total) = 0 THEN 'VERIFIED' ELSE 'ERROR_IN_CALCULATION' END AS checksum_status, "
        f"{status} AS pipeline_status, raw_total_rows, valid_rows_gold, rejected_rows_total, "
        "raw_total_rows - (valid_rows_gold + rejected_rows_total) AS mismatch_delta, d.*, "
        f"{PS.pct_2dp('valid_rows_gold', 'raw_total_rows')} AS overall_quality_score "
        f"FROM (SELECT {counts}) c, (SELECT {dims_sql} FROM error_log, (SELECT count(*) AS raw_total_rows FROM raw_sales) r GROUP BY raw_total_rows) d"
    )
    # the whole run from a file, with a report that the writes' counters give
    def _files(s, sf):
        out = _scratch(s, "run")
        IO.write_csv(_raw(s, sf), f"{out}/raw_sales.csv", "gzip", IO.GZIP_ROWS)
        return PL.run_files(s, [f"{out}/raw_sales_master.csv", f"{out}/raw_sales.csv"], out)

    q["observed_report"] = lambda s, sf: _files(s, sf).report
    o["observed_report"] = o["audit_report"]

    def _sections(s, sf):
        schema = (
            "report_metadata struct<audit_timestamp:string,checksum_status:string,pipeline_status:string>, summary_counts map<string,bigint>, "
            "data_quality_dimensions map<string,string>, severity_breakdown map<string,bigint>, rejection_reason_breakdown map<string,bigint>"
        )
        back = s.read.schema(schema).json(_files(s, sf).report_json)
        meta = F.create_map(*[x for n in ("checksum_status", "pipeline_status") for x in (F.lit(n), F.col(f"report_metadata.{n}"))])
        parts = {"report_metadata": meta} | {c: F.col(c).cast("map<string,string>") for c in back.columns[1:]}
        return back.select(F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(n), m) for n, m in parts.items()]))).alias("section", "m")).select(
            "section", F.explode("m").alias("name", "value"))

    q["report_sections"] = _sections
    flat = o["audit_report"][len(el):]
    pairs = lambda section, names, value: [f"SELECT '{section}' AS section, '{n}' AS name, {value.format(n)} AS value FROM flat" for n in names]
    o["report_sections"] = W(PS.error_log_sql(), PS.gold_sql(), f"flat AS ({flat})") + " UNION ALL ".join(
        pairs("report_metadata", ("checksum_status", "pipeline_status"), "{}")
        + pairs("summary_counts", ("raw_total_rows", "valid_rows_gold", "rejected_rows_total", "mismatch_delta"), "CAST({} AS VARCHAR)")
        + pairs("data_quality_dimensions", (*R.QUALITY_DIMENSIONS, "overall_quality_score"), "CAST({} AS VARCHAR) || '%'")
        + [f"SELECT 'severity_breakdown', severity, CAST(count AS VARCHAR) FROM ({o['severity_counts'][len(el):]})",
           f"SELECT 'rejection_reason_breakdown', reason, CAST(count AS VARCHAR) FROM ({o['reason_counts'][len(el):]})"]
    )
    gcols = GOLD
    q["gold_audit"] = lambda s, sf: (lambda r: A.gold_audit(r.gold, r.error_log))(_res(s, sf, anomaly=True))
    checks = [f"SELECT 'nulls:{c}' AS \"check\", CAST(count_if({c} IS NULL) AS BIGINT) AS failures FROM gold" for c in gcols] + [
        "SELECT 'duplicate_order_ids', CAST(count(*) - count(DISTINCT order_id) AS BIGINT) FROM gold",
        "SELECT 'profit_calculation', CAST(count_if(coalesce(abs(profit_usd - (amount_usd - cost_usd)) > 0.01, false)) AS BIGINT) FROM gold",
        "SELECT 'margin_bounds', CAST(count_if(coalesce(margin_pct < -100 OR margin_pct > 100, false)) AS BIGINT) FROM gold",
        "SELECT 'error_log_columns', CAST(0 AS BIGINT)",
    ]
    o["gold_audit"] = el + (
        "SELECT \"check\", failures, CASE WHEN failures = 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM ("
        + " UNION ALL ".join(checks) + ")"
    )

    # ---- sources and sinks: S1-S9 (write to scratch, read back)
    def _s1(s, sf):
        path = _scratch(s, "raw_csv")
        IO.write_csv(_raw(s, sf), path)
        return IO.read_raw_sales(s, path)

    q["read_raw_sales"] = _s1
    o["read_raw_sales"] = W() + "SELECT _source_pos, " + ", ".join(f'{PS.na(chr(34) + h + chr(34))} AS "{h}"' for h in T.RAW_HEADERS) + " FROM raw_sales"

    # fields with quotes, commas and line breaks, read in parallel splits
    broken = "CASE WHEN length(_source_pos) % 4 = 0 THEN 'said \"' || \"PaymentMethod\" || '\",' || chr(10) || \"PaymentMethod\" ELSE \"PaymentMethod\" END"

    def _line_breaks(s, sf):
        path = _scratch(s, "raw_csv")
        IO.write_csv(_raw(s, sf).withColumn("PaymentMethod", F.expr(broken.replace('"PaymentMethod"', "`PaymentMethod`"))), path)
        return IO.read_raw_sales(s, path)

    q["csv_line_breaks"] = _line_breaks
    o["csv_line_breaks"] = W() + "SELECT _source_pos, " + ", ".join(
        f'{PS.na(broken if h == "PaymentMethod" else chr(34) + h + chr(34))} AS "{h}"' for h in T.RAW_HEADERS) + " FROM raw_sales"

    def _positions(s, sf):
        # the rows in one order over all files, and then the numbers that reading gives them
        path = _scratch(s, "ordered_csv")
        rows = _raw(s, sf).withColumnRenamed("_source_pos", "Key").repartitionByRange("Key").sortWithinPartitions("Key")
        IO.write_csv(rows, path, "gzip", IO.GZIP_ROWS)
        return IO.read_raw_sales(s, path).select("Key", "OrderID", F.col("_source_pos").alias("position"))

    q["source_positions"] = _positions
    o["source_positions"] = W() + f"SELECT _source_pos AS \"Key\", {PS.na(chr(34) + 'OrderID' + chr(34))} AS \"OrderID\", row_number() OVER (ORDER BY _source_pos) - 1 AS position FROM raw_sales"

    def _gold_csv(s, sf):
        gold = _res(s, sf, anomaly=True).gold
        path = _scratch(s, "gold_csv")
        IO.write_gold(gold, path)
        return IO.read_csv_typed(s, path, gold.schema)

    q["write_gold"] = _gold_csv
    o["write_gold"] = W(PS.gold_sql()) + "SELECT * FROM gold"

    def _err_csv(s, sf):
        err = _res(s, sf, anomaly=True).error_log
        path = _scratch(s, "error_log_csv")
        IO.write_error_log(err, path)
        return IO.read_csv_typed(s, path, err.schema)

    q["write_error_log"] = _err_csv
    o["write_error_log"] = W(PS.error_log_sql()) + "SELECT * FROM error_log"

    orders_sql = (
        "SELECT order_id, CAST(order_date AS DATE) AS order_date, upper(order_status) AS order_status, customer AS customer_id, "
        f"{_cr('region')} AS region, {_rg(_cr('region'))} AS region_group, amount_usd AS revenue_usd, "
        + ", ".join(c for c in GOLD if c not in ("order_id", "order_date", "order_status", "customer", "region", "amount_usd"))
        + " FROM gold"
    )

    def _validated(s, sf):
        gold = _res(s, sf, anomaly=True).gold
        path = _scratch(s, "validated_csv")
        IO.write_gold(gold, path)
        return IO.read_validated(s, path, gold.schema)

    q["read_validated"] = _validated
    o["read_validated"] = W(PS.gold_sql()) + orders_sql
    q["rename_to_semantic"] = lambda s, sf: IO.to_orders(_res(s, sf, anomaly=True).gold)
    o["rename_to_semantic"] = W(PS.gold_sql()) + f"SELECT * FROM ({orders_sql})"

    def _warehouse(s, sf):
        path = _scratch(s, "warehouse")
        IO.load_warehouse(IO.to_orders(_res(s, sf, anomaly=True).gold), path)
        return IO.read_warehouse(s, path)

    q["load_warehouse"] = _warehouse
    o["load_warehouse"] = W(PS.gold_sql()) + orders_sql
    import datetime as _dt
    d0, d1 = _dt.date(1997, 1, 1), _dt.date(1998, 6, 30)
    q["read_warehouse"] = lambda s, sf: IO.prune_partitions(_warehouse(s, sf), d0, d1)
    o["read_warehouse"] = W(PS.gold_sql()) + f"SELECT * FROM ({orders_sql}) WHERE order_date BETWEEN DATE '{d0}' AND DATE '{d1}'"
    q["date_layout"] = lambda s, sf: _warehouse(s, sf).groupBy("order_year", "order_month").agg(
        F.count(F.lit(1)).alias("rows"), F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date"))
    o["date_layout"] = W(PS.gold_sql()) + (
        "SELECT order_year, order_month, count(*) AS rows, min(order_date) AS first_date, max(order_date) AS last_date "
        f"FROM ({orders_sql}) GROUP BY order_year, order_month"
    )

    def _report_json(s, sf):
        r = _res(s, sf, anomaly=True)
        rep = A.nested_report(PL.report(r), A.reason_counts(r.error_log), A.severity_counts(r.error_log))
        path = _scratch(s, "report_json")
        IO.write_report_json(rep, path)
        back = s.read.json(path)
        return back.select("summary_counts.*", "report_metadata.checksum_status", "report_metadata.pipeline_status")

    q["write_report_json"] = _report_json
    o["write_report_json"] = el + (
        "SELECT raw_total_rows, valid_rows_gold, rejected_rows_total, raw_total_rows - (valid_rows_gold + rejected_rows_total) AS mismatch_delta, "
        "CASE WHEN raw_total_rows - (valid_rows_gold + rejected_rows_total) = 0 THEN 'VERIFIED' ELSE 'ERROR_IN_CALCULATION' END AS checksum_status, "
        f"{status} AS pipeline_status FROM (SELECT {counts})"
    )

    def _export(s, sf):
        orders = T.sales(s, sf)
        path = _scratch(s, "export_csv")
        IO.export_orders_csv(orders, path)
        return IO.read_csv_typed(s, path, orders.select(*R.EXPORT_COLUMNS).schema)

    q["export_orders_csv"] = _export
    from .sql_text import with_sales
    o["export_orders_csv"] = with_sales() + f"SELECT {', '.join(R.EXPORT_COLUMNS)} FROM sales"

    def _parity(s, sf):
        gold = _res(s, sf, anomaly=True).gold
        wh = _scratch(s, "warehouse")
        IO.load_warehouse(IO.to_orders(gold), wh)
        csv = _scratch(s, "validated_csv")
        IO.write_gold(gold, csv)
        a = IO.read_warehouse(s, wh)
        b = IO.read_validated(s, csv, gold.schema).select(*a.columns)
        return IO.parity_diff(a, b).select("order_id", "side")

    q["source_parity"] = _parity

    def _parity_counts(s, sf):
        # the order table against its own warehouse round trip, as multisets
        orders = T.sales(s, sf)
        path = _scratch(s, "sales_warehouse")
        IO.load_warehouse(orders, path)
        back = IO.read_warehouse(s, path).select(*orders.columns)
        d = IO.parity_diff(orders, back).agg(
            F.count_if(F.col("side") == "left_only").alias("left_only"),
            F.count_if(F.col("side") == "right_only").alias("right_only"))
        return A.count_rows(orders, "left_rows").crossJoin(A.count_rows(back, "right_rows")).crossJoin(d)

    q["parity_diff"] = _parity_counts
    o["parity_diff"] = with_sales() + (
        "SELECT count(*) AS left_rows, count(*) AS right_rows, CAST(0 AS BIGINT) AS left_only, CAST(0 AS BIGINT) AS right_only FROM sales")
    def _planted(s, sf):
        # the order table against a copy with rows changed, dropped, repeated and added
        orders = T.sales(s, sf).select("order_id", "order_date", "order_status", "region", "revenue_usd")
        n = F.col("order_id").cast("long")
        copy = orders.where(n % 389 != 0).withColumn("revenue_usd", F.when(n % 401 == 0, F.col("revenue_usd") + 1).otherwise(F.col("revenue_usd")))
        copy = copy.withColumn("region", F.when(n % 409 != 0, F.col("region")))
        return orders, copy.unionAll(copy.where(n % 419 == 0)).unionAll(copy.where(n % 421 == 0).withColumn("order_id", F.concat(F.lit("x"), "order_id")))

    q["parity_digest_diff"] = lambda s, sf: D.digest_diff(*_planted(s, sf), ["order_id"])
    planted = with_sales(
        "a AS (SELECT order_id, order_date, order_status, region, revenue_usd, CAST(order_id AS BIGINT) AS k FROM sales)",
        "kept AS (SELECT order_id, order_date, order_status, CASE WHEN k % 409 <> 0 THEN region END AS region, "
        "CASE WHEN k % 401 = 0 THEN revenue_usd + 1 ELSE revenue_usd END AS revenue_usd, k FROM a WHERE k % 389 <> 0)",
        "b AS (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE k % 419 = 0 "
        "UNION ALL SELECT 'x' || order_id, order_date, order_status, region, revenue_usd, k FROM kept WHERE k % 421 = 0)",
    )
    cols = "order_id, order_date, order_status, region, revenue_usd"
    o["parity_digest_diff"] = planted + (
        f"SELECT *, 'left_only' AS side FROM (SELECT {cols} FROM a EXCEPT ALL SELECT {cols} FROM b) "
        f"UNION ALL SELECT *, 'right_only' AS side FROM (SELECT {cols} FROM b EXCEPT ALL SELECT {cols} FROM a)"
    )
    o["source_parity"] = "SELECT CAST(NULL AS VARCHAR) AS order_id, CAST(NULL AS VARCHAR) AS side WHERE FALSE"
    return q, o
