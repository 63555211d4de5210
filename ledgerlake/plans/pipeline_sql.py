"""DuckDB oracle text for the raw_sales fixture and the quality pipeline."""

from __future__ import annotations

from .. import reference_data as R
from ..functions import scalars as S
from ..sources import tables as T
from .sql_text import case_map, pick, q, title

K, N, P, SUP = "l.l_orderkey", "CAST(l.l_linenumber AS BIGINT)", "l.l_partkey", "l.l_suppkey"

_X = "CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * 0.25 AS DECIMAL(18,2))"


def _amount() -> str:
    t = f"CAST({_X} AS VARCHAR)"
    ip = f"CAST(floor({_X}) AS BIGINT)"
    cents = f"lpad(CAST(CAST(({_X} - {ip}) * 100 AS INTEGER) AS VARCHAR), 2, '0')"
    grouped = (
        f"(CASE WHEN {ip} >= 1000 THEN CAST({ip} // 1000 AS VARCHAR) || ',' || lpad(CAST({ip} % 1000 AS VARCHAR), 3, '0') "
        f"ELSE CAST({ip} AS VARCHAR) END)"
    )
    va = f"(({K} + 3 * {N}) % 20)"
    return (
        f"CASE {va} WHEN 8 THEN '$' || {grouped} || '.' || {cents} WHEN 9 THEN '(' || {t} || ')' "
        f"WHEN 10 THEN replace({t}, '.', ',') WHEN 11 THEN 'USD ' || {t} WHEN 12 THEN ' ' || {t} || ' ' "
        f"WHEN 13 THEN 'N/A' WHEN 14 THEN '' WHEN 15 THEN 'abc' WHEN 16 THEN {t} || '-' WHEN 17 THEN '0.00' "
        f"WHEN 18 THEN CAST(CAST({_X} * 10 AS DECIMAL(18,2)) AS VARCHAR) ELSE {t} END"
    )


def _order_date() -> str:
    d = "CAST(l.l_shipdate AS DATE)"
    vt = f"(({K} + 5 * {N}) % 16)"
    return (
        f"CASE {vt} WHEN 4 THEN strftime({d}, '%Y%m%dT101500') WHEN 13 THEN strftime({d}, '%-m.%-d.%Y') "
        f"WHEN 14 THEN strftime({d}, '%d-%b-%y') WHEN 15 THEN strftime({d}, '%Y-%m-%d 03:15 PM') "
        f"WHEN 5 THEN strftime({d}, '%m/%d/%Y') WHEN 6 THEN strftime({d}, '%d/%m/%Y') "
        f"WHEN 7 THEN strftime({d}, '%b %-d, %Y') WHEN 8 THEN strftime({d}, '%Y%m%d') "
        f"WHEN 9 THEN strftime({d}, '%Y-%m-%d 00:00:00') WHEN 10 THEN 'not a date' WHEN 11 THEN NULL "
        f"WHEN 12 THEN strftime({d}, '%Y') || '-13-' || strftime({d}, '%d') ELSE strftime({d}, '%Y-%m-%d') END"
    )


def raw_sales_cte() -> str:
    products = ", ".join(q(p) for p in R.PRODUCT_COSTS)
    cols = {
        "OrderID": f"CASE WHEN ({K} * 7 + {N}) % 53 = 0 THEN NULL WHEN ({K} + {N}) % 41 = 0 THEN 'N/A' "
                   f"ELSE 'ORD-' || CAST({K} AS VARCHAR) || '-' || CAST({N} AS VARCHAR) END",
        "OrderDate": _order_date(),
        "Amount": _amount(),
        "DiscountRate": f"CASE ({K} + {N}) % 3 WHEN 0 THEN CAST(CAST(l.l_discount AS DECIMAL(4,2)) AS VARCHAR) "
                        f"WHEN 1 THEN CAST(CAST(round(l.l_discount * 100) AS INTEGER) AS VARCHAR) || '%' END",
        "Currency": pick(T.RAW_CURRENCIES, f"{K} * 3 + {SUP}"),
        "Region": pick(T.RAW_REGIONS, f"{SUP} + {N}"),
        "Country": pick(T.RAW_COUNTRIES, SUP),
        "OrderStatus": pick(T.RAW_STATUSES, f"{K} + {N} * 7 + {SUP}"),
        "Customer": f"CASE WHEN ({K} + {SUP}) % 29 = 0 THEN NULL ELSE 'CUST-' || CAST({SUP} AS VARCHAR) END",
        "Product": f"coalesce(([{products}])[{P} % 13 + 1], 'Generic ' || p.p_name)",
        "Category": "p.p_type",
        "PaymentMethod": pick(T.RAW_PAYMENTS, N),
    }
    pos = (
        f"concat_ws('-', CAST({K} AS VARCHAR), CAST({N} AS VARCHAR), CAST({P} AS VARCHAR), CAST({SUP} AS VARCHAR), "
        "CAST(CAST(l.l_quantity AS BIGINT) AS VARCHAR), CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), "
        "strftime(CAST(l.l_shipdate AS DATE), '%Y%m%d'))"
    )
    body = ",\n    ".join([f"{pos} AS _source_pos"] + [f"{v} AS \"{k}\"" for k, v in cols.items()])
    return f"raw_sales AS (\n  SELECT {body}\n  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey\n)"


RAW_NAMES = {h: S.snake_case(h) for h in T.RAW_HEADERS}
DATA = list(RAW_NAMES.values())


def na(expr: str) -> str:
    return f"(CASE WHEN {expr} IN ({', '.join(q(t) for t in R.NA_TOKENS)}) THEN NULL ELSE {expr} END)"


def clean_numeric(s: str) -> str:
    kept = f"regexp_replace(regexp_replace({s}, '[()]', '', 'g'), '[^0-9,.\\-]+', '', 'g')"
    text = (
        f"(CASE WHEN contains({kept}, '.') AND contains({kept}, ',') THEN replace({kept}, ',', '') "
        f"WHEN contains({kept}, ',') THEN replace({kept}, ',', '.') ELSE {kept} END)"
    )
    v = f"TRY_CAST({text} AS DOUBLE)"
    return f"(CASE WHEN coalesce(regexp_matches({s}, '^\\s*\\(.*\\)\\s*$'), false) THEN -{v} ELSE {v} END)"


# Request dates, in order: ISO, day first, month first.
REQUEST_DATES = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y")


def parse_filter_date(s: str) -> str:
    return "coalesce(" + ", ".join(f"try_strptime(trim({s}), '{f}')" for f in REQUEST_DATES) + ")"


def parse_mixed_date(s: str) -> str:
    """A parser of its own: the shape of the text picks one reading."""
    t = f"trim({s})"
    part = lambda i: f"CAST(regexp_extract({t}, '^(\\d+)\\D(\\d+)\\D(\\d+)$', {i}) AS INTEGER)"
    ymd = f"printf('%04d-%02d-%02d', {part(3)}, CASE WHEN {part(1)} > 12 THEN {part(2)} ELSE {part(1)} END, CASE WHEN {part(1)} > 12 THEN {part(1)} ELSE {part(2)} END)"
    short = f"CAST(right({t}, 2) AS INTEGER)"
    century = f"CASE WHEN 2000 + {short} >= year(current_date) + 50 THEN 1900 + {short} ELSE 2000 + {short} END"
    shapes = {
        r"\d{4}-\d\d-\d\d": f"try_strptime({t}, '%Y-%m-%d')",
        r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d": f"try_strptime({t}, '%Y-%m-%d %H:%M:%S')",
        r"\d{4}-\d\d-\d\d \d\d:\d\d [AP]M": f"try_strptime({t}, '%Y-%m-%d %I:%M %p')",
        r"\d{8}": f"try_strptime({t}, '%Y%m%d')",
        r"\d{8}T\d{6}": f"try_strptime({t}, '%Y%m%dT%H%M%S')",
        r"\d{1,2}[./]\d{1,2}[./]\d{4}": f"try_strptime({ymd}, '%Y-%m-%d')",
        r"[A-Z][a-z]{2} \d{1,2}, \d{4}": f"try_strptime({t}, '%b %d, %Y')",
        r"\d\d-[A-Z][a-z]{2}-\d\d": f"try_strptime(left({t}, 7) || CAST({century} AS VARCHAR), '%d-%b-%Y')",
    }
    return "(CASE " + " ".join(f"WHEN regexp_full_match({t}, '{rx}') THEN {v}" for rx, v in shapes.items()) + " END)"


def normalize_region(s: str) -> str:
    e = f"upper(regexp_replace(trim({s}), '\\s+', ' ', 'g'))"
    return case_map(e, R.REGION_ALIASES, e)


def normalize_status(s: str) -> str:
    e = f"upper(trim({s}))"
    return case_map(e, R.STATUS_SYNONYMS, e)


def typed(name: str) -> str:
    c = f"r_{name}"
    return {
        "amount": clean_numeric(c),
        "discount_rate": clean_numeric(c),
        "order_date": parse_mixed_date(c),
        "currency": f"upper(trim({c}))",
        "region": normalize_region(c),
        "country": title(f"trim({c})"),
        "order_status": normalize_status(c),
    }.get(name, c)


def sha_mod(text: str, m: int) -> str:
    h = f"sha256({text})"
    acc = "CAST(0 AS BIGINT)"
    for i in range(8):
        acc = f"(({acc} * 4294967296 + CAST('0x' || substr({h}, {8 * i + 1}, 8) AS BIGINT)) % {m})"
    return acc


def names_sql(c: str) -> tuple[str, str]:
    first = "[" + ", ".join(q(x) for x in R.FIRST_NAMES) + "]"
    last = "[" + ", ".join(q(x) for x in R.LAST_NAMES) + "]"
    nl = len(R.LAST_NAMES)
    idx = sha_mod(f"'{R.NAME_SEED}-' || {c}", len(R.FIRST_NAMES) * nl)
    name = f"(CASE WHEN {c} IS NULL THEN NULL ELSE {first}[{idx} // {nl} + 1] || ' ' || {last}[{idx} % {nl} + 1] END)"
    b = sha_mod(f"'{R.NAME_SEED + 99}-' || {c}", 100)
    ctype = f"(CASE WHEN {c} IS NULL THEN NULL WHEN {b} < {R.B2B_SHARE_PCT} THEN 'B2B' ELSE 'B2C' END)"
    return name, ctype


def _dbl_map(expr: str, mapping) -> str:
    arms = " ".join(f"WHEN {q(k)} THEN CAST({v!r} AS DOUBLE)" for k, v in mapping.items())
    return f"(CASE {expr} {arms} END)"


def pipeline_ctes() -> list[str]:
    """CTEs: raw_sales, std (raw + typed), marked (dedup keep), enriched,
    fences, audited (outcome per raw row)."""
    std_cols = ", ".join(f"{na(q_ident(h))} AS r_{n}" for h, n in RAW_NAMES.items())
    typed_cols = ", ".join(f"{typed(n)} AS {n}" for n in DATA)
    score = " + ".join(f"CAST({n} IS NOT NULL AS INTEGER)" for n in DATA)
    miss = " OR ".join(f"{c} IS NULL" for c in R.CRITICAL_COLUMNS)
    reason = "'UNPARSEABLE_OR_MISSING_' || concat_ws('_', " + ", ".join(
        f"CASE WHEN {c} IS NULL THEN '{c.upper()}' END" for c in R.CRITICAL_COLUMNS) + ")"
    name, ctype = names_sql("customer")
    done = "upper(order_status) = 'COMPLETED'"
    amount_usd = f"amount * {_dbl_map('currency', R.EXCHANGE_RATES)}"
    cost = _dbl_map("product", R.PRODUCT_COSTS)
    floor = _dbl_map("product", R.PRODUCT_MIN_PRICE)
    inf_neg = "(amount_usd = 0 AND profit_usd < 0)"
    inf_pos = "(amount_usd = 0 AND profit_usd > 0)"
    rules = [
        ("coalesce(amount_usd <= 0, false)", "'INVALID_REVENUE_AMOUNT'", 2),
        (f"coalesce(margin_pct < {R.LOSS_MARGIN_PCT}, {inf_neg}, false)", "'SUSPICIOUS_LOSS_MARGIN'", 1),
        (f"coalesce(margin_pct > {R.UNREALISTIC_MARGIN_PCT}, {inf_pos}, false)", "'UNREALISTIC_PROFIT_MARGIN'", 1),
        ("coalesce(margin_pct < -100.0 OR margin_pct > 100.0, (amount_usd = 0 AND profit_usd <> 0), false)", "'MARGIN_OUT_OF_RANGE'", 2),
        (f"coalesce(amount_usd < {floor}, false)", "'UNIT_PRICE_LOW_' || replace(replace(upper(product), ' ', '_'), '.', '')", 1),
        (f"coalesce(amount_usd > {R.EXCESSIVE_AMOUNT_USD}, false)", "'EXCESSIVE_TRANSACTION_VALUE'", 1),
        (f"NOT coalesce(currency IN ({', '.join(q(c) for c in R.KNOWN_CURRENCIES)}), false)", "'UNKNOWN_CURRENCY'", 2),
    ]
    issues = "concat_ws('; ', " + ", ".join(f"CASE WHEN {p} THEN {c} END" for p, c, _ in rules) + ")"
    rank = "greatest(" + ", ".join(f"CASE WHEN {p} THEN {r} ELSE 0 END" for p, _, r in rules) + ", 0)"
    sev = f"(CASE {rank} WHEN 2 THEN 'CRITICAL' WHEN 1 THEN 'SUSPICIOUS' ELSE 'OK' END)"
    return [
        raw_sales_cte(),
        f"std0 AS (SELECT _source_pos, {std_cols} FROM raw_sales)",
        f"std AS (SELECT *, {typed_cols} FROM std0)",
        f"std_m AS (SELECT *, ({miss}) AS _missing, {reason} AS _miss_reason, {score} AS _score FROM std)",
        "ranked AS (SELECT *, CASE WHEN _missing THEN 1 ELSE ROW_NUMBER() OVER "
        "(PARTITION BY _missing, order_id ORDER BY _score DESC, _source_pos) END AS _rank FROM std_m)",
        f"enr0 AS (SELECT *, _missing OR _rank = 1 AS _keep, {name} AS customer_name, {ctype} AS customer_type, "
        f"{amount_usd} AS amount_usd, CAST({cost} AS DOUBLE) AS cost_usd FROM ranked)",
        "fences AS (SELECT quantile_cont(amount_usd, 0.25) AS q1, quantile_cont(amount_usd, 0.75) AS q3 "
        "FROM enr0 WHERE NOT _missing AND _keep AND amount_usd IS NOT NULL AND NOT isnan(amount_usd))",
        f"enr1 AS (SELECT *, CASE WHEN {done} THEN amount_usd - cost_usd END AS profit_usd, "
        f"CASE WHEN {done} THEN (amount_usd - cost_usd) / NULLIF(amount_usd, 0) * 100.0 END AS margin_pct, "
        "CAST(year(order_date) AS INTEGER) AS order_year, CAST(month(order_date) AS INTEGER) AS order_month, "
        "CAST(quarter(order_date) AS INTEGER) AS order_quarter FROM enr0)",
        "enr2 AS (SELECT e.*, coalesce(profit_usd < 0, false) AS is_loss_making, "
        f"coalesce(margin_pct > {R.HIGH_MARGIN_PCT}, {inf_pos}, false) AS is_high_margin, "
        "CASE WHEN f.q3 - f.q1 IS NULL OR f.q3 - f.q1 = 0 THEN false ELSE coalesce(amount_usd < f.q1 - 1.5 * (f.q3 - f.q1) "
        "OR amount_usd > f.q3 + 1.5 * (f.q3 - f.q1), false) END AS is_anomaly FROM enr1 e CROSS JOIN fences f)",
        f"val AS (SELECT *, {issues} AS validation_issues, {sev} AS severity_v FROM enr2)",
        "audited AS (SELECT _source_pos AS source_pos, "
        + ", ".join(f"r_{n}" for n in DATA) + ", "
        "CASE WHEN _missing THEN 'CLEAN' WHEN NOT _keep THEN 'DEDUP' WHEN severity_v <> 'OK' THEN 'VALIDATE' END AS stage, "
        "CASE WHEN _missing THEN 'CRITICAL' WHEN NOT _keep THEN 'WARNING' ELSE severity_v END AS severity, "
        "CASE WHEN _missing THEN _miss_reason WHEN NOT _keep THEN 'REDUNDANT_DUPLICATE_ORDER_ID' "
        "WHEN severity_v <> 'OK' THEN validation_issues END AS failure_reason, validation_issues, "
        + ", ".join(DATA) + ", customer_name, customer_type, amount_usd, cost_usd, profit_usd, margin_pct, "
        "order_year, order_month, order_quarter, is_loss_making, is_high_margin, is_anomaly FROM val)",
    ]


def q_ident(h: str) -> str:
    return f'"{h}"'


GOLD_COLS = DATA + [
    "customer_name", "customer_type", "amount_usd", "cost_usd", "profit_usd", "margin_pct",
    "order_year", "order_month", "order_quarter", "is_loss_making", "is_high_margin", "is_anomaly",
]


def with_pipeline(*extra: str) -> str:
    return "WITH " + ",\n".join([*pipeline_ctes(), *extra]) + "\n"


def gold_sql() -> str:
    return f"gold AS (SELECT {', '.join(GOLD_COLS)} FROM audited WHERE stage IS NULL)"


def error_log_sql() -> str:
    typed = ", ".join(f"CASE WHEN stage = 'VALIDATE' THEN {c} END AS {c}" for c in GOLD_COLS)
    return (
        "error_log AS (SELECT source_pos, stage, severity, failure_reason, "
        "CASE WHEN stage = 'VALIDATE' THEN validation_issues END AS validation_issues, "
        + ", ".join(f"r_{n} AS raw_{n}" for n in DATA) + f", {typed} FROM audited WHERE stage IS NOT NULL)"
    )


def pct_2dp(part: str, whole: str) -> str:
    # printf rounds the exact binary value half-to-even, as Python's round() does
    return f"(CASE WHEN {whole} > 0 THEN CAST(printf('%.2f', (CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE)) * 100.0) AS DOUBLE) END)"
