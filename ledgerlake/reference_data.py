"""Fixed business constants of the sales-quality domain.

Every value in the FIXED VALUES block below must stay exactly as written:
results (costs, currency conversion, reason codes, synthetic names) are only
comparable with the original application when these are identical. They are
small and bounded by construction, so the library turns them into literal
``map`` / ``array`` expressions (no join, no broadcast exchange, stays inside
whole-stage codegen).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the original application's constants)
# ---------------------------------------------------------------------------

# Currency -> USD conversion rate.
EXCHANGE_RATES: dict[str, float] = {
    "USD": 1.0,
    "EUR": 1.09,
    "GBP": 1.27,
    "NGN": 0.00065,
    "KES": 0.0075,
    "JPY": 0.0067,
}

# Currencies accepted by validation.
KNOWN_CURRENCIES: tuple[str, ...] = ("USD", "EUR", "GBP", "NGN", "KES", "JPY")

# Product -> unit cost in USD. Unknown products get a NULL cost.
PRODUCT_COSTS: dict[str, float] = {
    "MacBook Pro M3": 1800.0,
    "iPhone 15 Pro": 600.0,
    "Samsung S23 Ultra": 800.0,
    "Enterprise Server": 10000.0,
    "Network Switch": 3000.0,
    "Rack Cabinet": 800.0,
    "Herman Miller Chair": 900.0,
    "Electric Standing Desk": 500.0,
    "Conference Table": 1400.0,
    "Logitech MX Master": 50.0,
    "Sony WH-1000XM5": 250.0,
    "Thunderbolt Dock": 180.0,
}

# Product -> minimum plausible amount_usd (validation floor), in rule order.
PRODUCT_MIN_PRICE: dict[str, float] = {
    "MacBook Pro M3": 1000.0,
    "iPhone 15 Pro": 400.0,
    "Samsung S23 Ultra": 400.0,
    "Enterprise Server": 5000.0,
    "Network Switch": 1000.0,
    "Rack Cabinet": 400.0,
    "Herman Miller Chair": 500.0,
    "Electric Standing Desk": 300.0,
    "Conference Table": 800.0,
}

# Region spellings folded onto one code after trim/collapse/upper.
REGION_ALIASES: dict[str, str] = {
    "N AMERICA": "NORTH AMERICA",
    "N. AMERICA": "NORTH AMERICA",
    "NORTHAMERICA": "NORTH AMERICA",
    "ASIA PACIFIC": "APAC",
}

# Region code -> display name used by the warehouse and the metric layer.
REGION_CANONICAL: dict[str, str] = {
    "NORTH AMERICA": "North America",
    "APAC": "Asia-Pacific",
    "EMEA": "Europe, Middle East and Africa",
    "AFRICA": "Africa",
}

# Display name -> region group; anything else is OTHER.
REGION_GROUPS: dict[str, str] = {
    "North America": "AMERICAS",
    "Asia-Pacific": "APAC",
    "Europe, Middle East and Africa": "EMEA",
    "Africa": "EMEA",
}
REGION_GROUP_OTHER = "OTHER"
REGION_UNKNOWN = "Unknown"

# Order status synonyms (applied after trim + upper).
STATUS_SYNONYMS: dict[str, str] = {
    "COMPLETE": "COMPLETED",
    "DONE": "COMPLETED",
    "CANCELLED": "CANCELED",
}
STATUS_COMPLETED = "COMPLETED"

# Critical columns, in the order their names appear in a rejection reason.
CRITICAL_COLUMNS: tuple[str, ...] = ("order_id", "amount", "order_date", "currency")

# Validation thresholds.
LOSS_MARGIN_PCT = -50.0
UNREALISTIC_MARGIN_PCT = 85.0
MARGIN_BOUND_PCT = 100.0
EXCESSIVE_AMOUNT_USD = 50000.0
HIGH_MARGIN_PCT = 40.0
IQR_FENCE = 1.5

# Severity ranks (higher wins) and the labels the audit report always lists.
SEVERITY_RANK: dict[str, int] = {"OK": 0, "SUSPICIOUS": 1, "CRITICAL": 2}
REPORT_SEVERITIES: tuple[str, ...] = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "WARNING", "SUSPICIOUS")

# Quality dimension -> regex over failure_reason.
QUALITY_DIMENSIONS: dict[str, str] = {
    "completeness_score": "MISSING|NULL",
    "uniqueness_score": "DUPLICATE",
    "validity_score": "INVALID|OUT_OF_RANGE",
    "accuracy_score": "UNIT_PRICE|UNREALISTIC|SUSPICIOUS",
    "consistency_score": "DISCREPANCY|UNKNOWN_CURRENCY",
}
PASS_THRESHOLD = 80.0
WARN_THRESHOLD = 60.0

# Synthetic customer names: seed, and the two name lists whose cross product
# (first-name major, last-name minor: 60 x 60 = 3600 names) is indexed by
# sha256("<seed>-<customer id>") mod 3600.
NAME_SEED = 20260503
FIRST_NAMES: tuple[str, ...] = (
    "James", "Aisha", "Michael", "Fatima", "David", "Sofia", "Wei", "Carlos", "Amara", "Noah",
    "Zara", "Hassan", "Elena", "Mateo", "Priya", "Omar", "Nia", "Daniel", "Yara", "Samuel",
    "Linh", "Amina", "Diego", "Grace", "Kenji", "Leila", "Ethan", "Mina", "Tariq", "Chloe",
    "Ibrahim", "Hana", "Lucas", "Maya", "Zain", "Isabella", "Aditya", "Nadia", "Kwame", "Ava",
    "Emeka", "Yuki", "Ana", "Ahmed", "Mei", "Oliver", "Sara", "Amir", "Victoria", "Ravi",
    "Naomi", "Malik", "Julia", "Arjun", "Hyejin", "Thomas", "Halima", "George", "Rosa", "Santiago",
)
LAST_NAMES: tuple[str, ...] = (
    "Carter", "Bello", "Johnson", "Khan", "Smith", "Garcia", "Nguyen", "Patel", "Okafor", "Hernandez",
    "Kim", "Silva", "Brown", "Ahmed", "Wang", "Davis", "Martinez", "Singh", "Lopez", "Taylor",
    "Ibrahim", "Clark", "Morgan", "Chen", "Rossi", "Sato", "Kowalski", "Novak", "Mensah", "Dubois",
    "Andersson", "Nakamura", "Ivanov", "Haddad", "Hussain", "Jensen", "O'Connor", "Campbell", "Ali", "Rahman",
    "Gonzalez", "Fernandez", "Adebayo", "Ndlovu", "Okeke", "Chaudhry", "Sharma", "Banerjee", "Das", "Choi",
    "Park", "Lee", "Yamamoto", "Tanaka", "Suzuki", "Khanh", "Hoang", "Tran", "Bianchi", "Conti",
)
# Customer type: share of B2B customers (percent), drawn per customer.
B2B_SHARE_PCT = 70

# Strings a CSV reader treats as missing (pandas' default NA token list).
NA_TOKENS: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Metric registry: id -> (display name, unit, type).
METRICS: dict[str, tuple[str, str, str]] = {
    "revenue_total_usd": ("Total Revenue (USD)", "USD", "currency"),
    "profit_total_usd": ("Net Profit (USD)", "USD", "currency"),
    "profit_margin_pct": ("Profit Margin (%)", "PCT", "percentage"),
    "revenue_growth_pct": ("Revenue Growth (%)", "PCT", "percentage"),
}

# Box statistics: minimum points and outlier payload cap.
BOX_MIN_POINTS = 3
BOX_MAX_OUTLIERS = 200
# Listing and search payload sizes.
PAGE_SIZE = 50
TOP_K = 10
SEARCH_LIMIT = 20

# Orders export: column order of the CSV export.
EXPORT_COLUMNS: tuple[str, ...] = (
    "order_id", "order_date", "customer_name", "region", "region_group", "country",
    "revenue_usd", "cost_usd", "profit_usd", "margin_pct", "order_status",
    "payment_method", "category",
)

# ---------------------------------------------------------------------------
# end of FIXED VALUES
# ---------------------------------------------------------------------------

# Dimensions a breakdown may group on (allow-list instead of raw SQL text).
BREAKDOWN_DIMENSIONS: tuple[str, ...] = (
    "region", "region_group", "country", "customer_id", "category", "product",
    "payment_method", "order_status",
)
TIME_GRAINS: tuple[str, ...] = ("day", "week", "month")
#: Texts that mean true, lower-cased.
TRUTHY: tuple[str, ...] = ("true", "1", "yes", "y", "t")
