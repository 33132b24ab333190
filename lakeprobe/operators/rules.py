"""Rule tables and name rules.

Rules run as Spark expressions over column names, so the same code labels one
table or the profile catalog of a whole lake. Each rule list is plain data;
callers may pass their own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import norm_name

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal labels).
# Column categories, tested in this order on the normalised name; the first
# category with a matching alternative wins (substring search).
CATEGORY_RULES: tuple[tuple[str, str], ...] = (
    ("Identifiers", r"_id$|^id$|_no$|_num$|_ref$|_code$|identifier|serial|uuid|sku"),
    ("Dates", r"date|_dt$|^dt_|year|month|quarter|inception|expiry|renewal|start|end"),
    ("Claims", r"claim|clm|loss|paid|payment|reimburs|benefit|settlement|indemnity"),
    ("Exposure", r"exposure|expo|earned|duration|days_at_risk|risk_days|in_force|lapse"),
    ("Premium", r"premium|prm|gwp|nwp|written|price|rate|tariff|contribution"),
    ("Customer", r"customer|client|member|insured|policyholder|holder"),
    ("Policy", r"policy|cover|coverage|plan_type|product_code|scheme"),
    ("Product", r"product|line_of_business|lob|class|subclass|tier"),
    ("Pet", r"pet|breed|species|animal|cat\b|dog\b|rabbit"),
    ("Geography", r"province|state|region|country|postcode|zip|city|area|territory|district"),
    ("Behavioural", r"tenure|vintage|age|gender|sex|occupation|income|channel|source"),
    ("Potential Leakage", r"future|next_|post_claim|after_claim|outcome"),
    ("Potential Targets", r"target|label|y_|flag|indicator|propensity"),
)
# Names that force "Potential Leakage" whatever the first match was.
LEAKAGE_OVERRIDE = r"future|post_claim|outcome|next_period|after_loss"

# Claims columns, searched on the raw name, ignoring case.
CLAIM_AMOUNT = (r"claim.?(amount|paid|value|cost|payment|benefit|settlement|indemnity)|"
                r"paid.?amount|loss.?amount|benefit.?amount|total.?paid|amount.?paid|incurred")
CLAIM_COUNT = r"claim.?(count|cnt|num|number|freq|flag)|n_claims|num_claims|claims_count|clm_cnt"
CLAIM_FLAG = r"has_claim|claim_flag|claimed|is_claim|clm_flag|claim_indicator"
# Values of a flag column that mean "claimed".
CLAIM_TRUTH = ("1", "true", "yes", "y")

# Entity columns for the metadata counts: exact names first, then a pattern.
POLICY_EXACT = ("policy_id", "policy_no", "policyid")
POLICY_PATTERN = r"policy.?(id|no|num|number|ref)"
CUSTOMER_EXACT = ("customer_id", "client_id")
CUSTOMER_PATTERN = r"cust.?(id|no|num|ref)|customer.?id|client.?id"
# Claim column for the metadata claim rate.
META_CLAIM = r"claim.?(amount|paid|cost|value|cnt|count)"
# Columns scanned for the dataset date range.
META_DATE = r"date|dt|year|month"
# ---------------------------------------------------------------------------

CATEGORIES = tuple(c for c, _ in CATEGORY_RULES) + ("Other",)


def ci(pattern: str) -> str:
    """Case-insensitive form of a pattern."""
    return "(?i)" + pattern


def category_expr(name: Column, rules=CATEGORY_RULES,
                  leakage: str = LEAKAGE_OVERRIDE) -> Column:
    """R1 + R2: category of a column from its name."""
    n = norm_name(name)
    expr = None
    for label, pattern in rules:
        cond = n.rlike(ci(pattern))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    expr = expr.otherwise(F.lit("Other")) if expr is not None else F.lit("Other")
    return F.when(n.rlike(ci(leakage)), F.lit("Potential Leakage")).otherwise(expr)


def name_match(name: Column, pattern: str) -> Column:
    """T4: regex search on the raw name, ignoring case."""
    return name.rlike(ci(pattern))


def find_column(catalog, pattern: str, exact: tuple[str, ...] = (),
                keys=("dataset",)):
    """Per dataset, the column whose normalised name is first in ``exact``
    (first such column), else the first column whose raw name matches
    ``pattern``. Returns ``keys + (column,)``; datasets without a match are
    absent.
    """
    n = norm_name(F.col("column"))
    prio = None
    for i, e in enumerate(exact):
        prio = F.when(n == e, F.lit(i)) if prio is None else prio.when(n == e, F.lit(i))
    rx = F.when(name_match(F.col("column"), pattern), F.lit(len(exact)))
    prio = rx if prio is None else prio.otherwise(rx)
    return (
        catalog.withColumn("_prio", prio)
        .where(F.col("_prio").isNotNull())
        .groupBy(*keys)
        .agg(F.min_by("column", F.struct("_prio", "ordinal")).alias("column"))
    )


def claims_columns(catalog, keys=("dataset",)):
    """Per dataset the claim amount (numeric), flag (any type) and count
    (numeric) columns, each the first match in column order."""
    c = F.col("column")
    num = F.col("kind").isin("numeric", "boolean")
    return catalog.groupBy(*keys).agg(
        F.min_by(F.when(name_match(c, CLAIM_AMOUNT) & num, c),
                 F.when(name_match(c, CLAIM_AMOUNT) & num, F.col("ordinal"))).alias("amount_col"),
        F.min_by(F.when(name_match(c, CLAIM_FLAG), c),
                 F.when(name_match(c, CLAIM_FLAG), F.col("ordinal"))).alias("flag_col"),
        F.min_by(F.when(name_match(c, CLAIM_COUNT) & num, c),
                 F.when(name_match(c, CLAIM_COUNT) & num, F.col("ordinal"))).alias("count_col"),
    )
