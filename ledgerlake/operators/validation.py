"""Validate stage: business rules -> reason codes and severity, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import reference_data as R
from ..functions import scalars as S
from .enrichment import zero_revenue_sign


#: Reason codes beside the missing fields and the price floors.
RULE_CODES = (
    "REDUNDANT_DUPLICATE_ORDER_ID", "INVALID_REVENUE_AMOUNT", "SUSPICIOUS_LOSS_MARGIN", "UNREALISTIC_PROFIT_MARGIN", "MARGIN_OUT_OF_RANGE",
    "EXCESSIVE_TRANSACTION_VALUE", "UNKNOWN_CURRENCY",
)


def _rules(df: DataFrame) -> list[tuple[Column, Column, str]]:
    """(predicate, code, severity) in reporting order. Predicates are NULL-safe."""
    amt, margin = F.col("amount_usd"), F.col("margin_pct")
    inf = zero_revenue_sign()
    rules = [(F.coalesce(amt <= 0, F.lit(False)), F.lit("INVALID_REVENUE_AMOUNT"), "CRITICAL")]
    if "margin_pct" in df.columns:
        rules += [
            (F.coalesce(margin < R.LOSS_MARGIN_PCT, inf == -1, F.lit(False)), F.lit("SUSPICIOUS_LOSS_MARGIN"), "SUSPICIOUS"),
            (F.coalesce(margin > R.UNREALISTIC_MARGIN_PCT, inf == 1, F.lit(False)), F.lit("UNREALISTIC_PROFIT_MARGIN"), "SUSPICIOUS"),
            (F.coalesce((margin < -R.MARGIN_BOUND_PCT) | (margin > R.MARGIN_BOUND_PCT), inf.isNotNull(), F.lit(False)),
             F.lit("MARGIN_OUT_OF_RANGE"), "CRITICAL"),
        ]
    if "product" in df.columns:
        floor = S.lookup("product", R.PRODUCT_MIN_PRICE)
        rules.append((F.coalesce(amt < floor, F.lit(False)),
                      F.concat(F.lit("UNIT_PRICE_LOW_"), S.product_code("product")), "SUSPICIOUS"))
    rules += [
        (F.coalesce(amt > R.EXCESSIVE_AMOUNT_USD, F.lit(False)), F.lit("EXCESSIVE_TRANSACTION_VALUE"), "SUSPICIOUS"),
        (~F.coalesce(F.col("currency").isin(list(R.KNOWN_CURRENCIES)), F.lit(False)), F.lit("UNKNOWN_CURRENCY"), "CRITICAL"),
    ]
    return rules


def validate_rules(df: DataFrame) -> DataFrame:
    """Adds ``validation_issues`` ("; "-joined codes, "" when clean) and
    ``severity`` (highest rank hit: OK < SUSPICIOUS < CRITICAL)."""
    rules = _rules(df)
    issues = F.concat_ws("; ", *[F.when(p, code) for p, code, _ in rules])
    rank = F.greatest(*[F.when(p, F.lit(R.SEVERITY_RANK[sev])).otherwise(F.lit(0)) for p, _, sev in rules], F.lit(0))
    return df.withColumns({"validation_issues": issues, "severity": max_severity(rank)})


def max_severity(rank: Column) -> Column:
    # one use of the rank: a filter on the label would work it out in each use
    return F.coalesce(S.lookup(rank, {r: name for name, r in R.SEVERITY_RANK.items()}), F.lit("OK"))


def threshold_flags(df: DataFrame) -> DataFrame:
    """The per-product price floor (equi on product, theta on amount)."""
    floor = S.lookup("product", R.PRODUCT_MIN_PRICE)
    return df.withColumn("min_price", floor).filter(F.col("amount_usd") < F.col("min_price"))


def split_valid_rejected(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.col("severity") == "OK"
    passed = validated.filter(ok).drop("validation_issues", "severity")
    rejected = validated.filter(~ok).withColumn("failure_reason", F.col("validation_issues"))
    return passed, rejected


def validation_summary(validated: DataFrame) -> DataFrame:
    """total, valid, rejected and the pass rate (2 dp; 0 on empty)."""
    agg = validated.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("severity") == "OK").alias("valid_rows"),
    )
    return agg.select(
        "total_rows", "valid_rows",
        (F.col("total_rows") - F.col("valid_rows")).alias("rejected_rows"),
        pct_2dp("valid_rows", "total_rows", F.lit(0.0)).alias("quality_score"),
    )


def round_2dp(x: Column) -> Column:
    """A double rounded to 2 decimals the way a Python ``round(x, 2)`` does:
    from the exact binary value, ties to even, back to the nearest double.
    ``format_number`` (Java DecimalFormat, HALF_EVEN on the exact value) gives
    those digits; ``round`` / ``bround`` start from the shortest decimal text
    of the double instead and differ near ties."""
    return F.regexp_replace(F.format_number(x, 2), ",", "").cast("double")


def pct_2dp(part: str, whole: str, empty: Column | None = None) -> Column:
    """round((part / whole) * 100, 2) in double arithmetic, as the report's
    percentages are defined; NULL (or ``empty``) when ``whole`` is 0."""
    ratio = F.expr(f"CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE)") * F.lit(100.0)
    res = F.when(F.col(whole) > 0, round_2dp(ratio))
    return res if empty is None else F.coalesce(res, empty)
