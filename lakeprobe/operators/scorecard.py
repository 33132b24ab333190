"""Readiness score, findings and roadmap per dataset.

Inputs are small per-dataset tables: the profile catalog, check status rows,
a claims summary (``dataset, claiming_pct, skewness``; one row per dataset
where claims columns were found), targets and features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# ---------------------------------------------------------------------------
# Readiness bands (lowest total for each band).
BANDS = ((80, "ready"), (60, "usable"), (40, "needs review"), (0, "needs preparation"))
LARGE_ROWS = 100_000
# Findings sections in order.
SECTIONS = ("opportunities", "risks", "quality_issues", "analytical_risks",
            "business_observations")
# Roadmap steps in order: key, title, priority, effort, business value.
ROADMAP_STEPS = (
    ("portfolio", "Portfolio Overview", "High", "Low", "High"),
    ("remediation", "Data Quality Remediation", "High", "Medium", "High"),
    ("exposure", "Exposure Analysis", "High", "Medium", "High"),
    ("claims_validation", "Claims Validation", "High", "Low", "High"),
    ("claims_overview", "Claims Overview", "High", "Low", "High"),
    ("severity", "Claim Severity Analysis", "High", "Medium", "High"),
    ("frequency", "Claim Frequency Analysis", "High", "Medium", "High"),
    ("geography", "Geographic Analysis", "Medium", "Medium", "High"),
    ("pet", "Breed & Species Risk Analysis", "Medium", "Medium", "High"),
    ("premium", "Premium & Pricing Analysis", "Medium", "Medium", "High"),
    ("trends", "Experience Trends Over Time", "Medium", "Medium", "Medium"),
    ("expected_loss", "Expected Loss (Pure Premium) Analysis", "High", "Medium", "High"),
    ("segmentation", "Risk Segmentation & Clustering", "Medium", "High", "Medium"),
    ("targets", "Target Variable Analysis ({n} candidates)", "High", "Medium", "High"),
    ("modelling", "Modelling Readiness Assessment", "Medium", "Low", "High"),
)
# Titles of the findings; a count, rate or check name goes before or after.
TITLES = {
    "targets": " Modelling Targets Available",
    "high": " High-Value Features Identified",
    "large": "Large Dataset — Statistical Power Available",
    "leak": " Potential Leakage Features Detected",
    "sparse": " Sparse Columns — Credibility Risk",
    "skewed": "Highly Skewed Claim Distribution",
    "suspicious": " Suspicious Features Require Validation",
    "no_target": "No Clear Modelling Target Detected",
    "rate": "Claiming Rate: ",
    "geography": "Geographic Segmentation Available",
    "fail": "FAIL: ",
    "warn": "WARNING: ",
}
# ---------------------------------------------------------------------------


def _names(cond: Column, order: str, name: str) -> Column:
    """The names of the rows where ``cond`` holds, in order: as many as a table has
    columns at most."""
    picked = F.array_sort(F.collect_list(F.when(cond, F.struct(F.col(order).alias("o"), F.col(name).alias("c")))))
    return F.transform(picked, lambda x: x["c"])


def dataset_facts(catalog: DataFrame, status: DataFrame, claims: DataFrame,
                  targets: DataFrame, features: DataFrame) -> DataFrame:
    """One row per dataset with every count the rules below gate on."""
    cat = F.col("category")
    prof = catalog.groupBy("dataset").agg(
        F.max("rows").alias("rows"),
        F.avg("coverage_pct").alias("avg_cov"),
        F.count_distinct("category").alias("n_categories"),
        F.count_if(F.col("coverage_pct") < 30).alias("n_sparse"),
        _names(F.col("coverage_pct") < 30, "ordinal", "column").alias("sparse_columns"),
        _names(cat == "Geography", "ordinal", "column").alias("geo_columns"),
        F.max((cat == "Exposure").cast("int")).alias("has_exposure"),
        F.max((cat == "Premium").cast("int")).alias("has_premium"),
        F.max((cat == "Geography").cast("int")).alias("has_geo"),
        F.max((cat == "Pet").cast("int")).alias("has_pet"),
        F.max((cat == "Dates").cast("int")).alias("has_dates"))
    st = status.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_checks"),
        F.count_if(F.col("status") == "pass").alias("n_pass"),
        F.count_if(F.col("status") == "warn").alias("n_warn"),
        F.count_if(F.col("status") == "fail").alias("n_fail"))
    tg = targets.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_targets"),
                                        _names(F.lit(True), "target_rank", "name").alias("target_names"))
    kinds = {"high": "High Value", "leak": "Potential Leakage", "susp": "Suspicious"}
    ft = features.groupBy("dataset").agg(
        *[F.count_if(F.col("classification") == v).alias(f"n_{k}") for k, v in kinds.items()],
        *[_names(F.col("classification") == v, "feature_rank", "name").alias(f"{k}_columns") for k, v in kinds.items()])
    cl = claims.select("dataset", F.lit(1).alias("has_claims"), "claiming_pct", "skewness",
                       F.split("detected_fields", ",").alias("claim_columns"))
    out = prof.join(st, "dataset", "left").join(tg, "dataset", "left") \
        .join(ft, "dataset", "left").join(cl, "dataset", "left")
    return out.fillna(0, subset=["n_checks", "n_pass", "n_warn", "n_fail", "n_targets",
                                 "n_high", "n_leak", "n_susp", "has_claims"])


def readiness(facts: DataFrame) -> DataFrame:
    """Four parts of 25 points. Integer rounding is half-even."""
    d1 = F.least(F.lit(25), F.bround(F.col("avg_cov") / 4, 0)).cast("int")
    d2 = F.when(F.col("n_checks") > 0,
                F.least(F.lit(25), F.bround(F.col("n_pass") / F.col("n_checks") * 25, 0))
                ).otherwise(F.lit(12)).cast("int")
    d3 = F.when(F.col("n_targets") >= 2, 25).when(F.col("n_targets") == 1, 15).otherwise(5)
    d4 = F.least(F.lit(25), F.col("n_categories") * 3).cast("int")
    out = facts.select("dataset", F.coalesce(d1, F.lit(0)).alias("completeness"),
                       d2.alias("quality"), d3.alias("target_availability"),
                       d4.alias("structural_richness"))
    total = (F.col("completeness") + F.col("quality") + F.col("target_availability")
             + F.col("structural_richness"))
    band = None
    for lo, label in BANDS:
        band = F.when(F.col("score") >= lo, label) if band is None else band.when(F.col("score") >= lo, label)
    return out.withColumn("score", total.cast("int")).withColumn("band", band)


def _finding(facts: DataFrame, section: int, order: int, cond: Column, title: Column,
             impact: str, confidence: int, review: bool, note: Column | None = None,
             columns: str | None = None) -> DataFrame:
    named = F.array().cast("array<string>") if columns is None else F.coalesce(F.col(columns), F.array().cast("array<string>"))
    return facts.where(cond).select(
        "dataset", F.lit(SECTIONS[section]).alias("section"), F.lit(order).alias("_o"),
        title.alias("title"), F.lit(impact).alias("impact"),
        F.lit(confidence).alias("confidence"), F.lit(review).alias("human_review"),
        (F.lit(None).cast("string") if note is None else note).alias("note"), named.alias("columns"))


def findings(facts: DataFrame, status: DataFrame, max_fails: int = 5, max_warns: int = 4) -> DataFrame:
    """Findings in five sections. The quality section is a ranking: the first
    ``max_fails`` failed and ``max_warns`` warned checks in run order (L4); all of
    them are in the status table. ``note`` is ``low rate`` beside a claiming rate
    under 20 %. ``columns`` names the columns (or targets) that a finding is about, all
    of them, in the order of the table or of their ranking."""
    n = lambda c: F.col(c).cast("string")
    flagged = F.when(F.col("detail") != "", F.split("detail", ",")).otherwise(F.array().cast("array<string>")).alias("columns")
    parts = [
        _finding(facts, 0, 1, F.col("n_targets") >= 2,
                 F.concat(n("n_targets"), F.lit(TITLES["targets"])), "High", 90, True, columns="target_names"),
        _finding(facts, 0, 2, F.col("n_high") >= 5,
                 F.concat(n("n_high"), F.lit(TITLES["high"])), "High", 80, False, columns="high_columns"),
        _finding(facts, 0, 3, F.col("rows") >= LARGE_ROWS,
                 F.lit(TITLES["large"]), "Medium", 95, False),
        _finding(facts, 1, 1, F.col("n_leak") > 0,
                 F.concat(n("n_leak"), F.lit(TITLES["leak"])), "High", 75, True, columns="leak_columns"),
        _finding(facts, 1, 2, F.col("n_sparse") > 0,
                 F.concat(n("n_sparse"), F.lit(TITLES["sparse"])), "Medium", 90, False, columns="sparse_columns"),
        _finding(facts, 1, 3, F.coalesce(F.abs(F.col("skewness")) > 2, F.lit(False)),
                 F.lit(TITLES["skewed"]), "High", 85, True, columns="claim_columns"),
        _finding(facts, 3, 1, F.col("n_susp") > 0,
                 F.concat(n("n_susp"), F.lit(TITLES["suspicious"])), "High", 70, True, columns="susp_columns"),
        _finding(facts, 3, 2, F.col("n_targets") == 0,
                 F.lit(TITLES["no_target"]), "High", 80, True),
        _finding(facts, 4, 1, F.col("has_claims") == 1,
                 F.concat(F.lit(TITLES["rate"]), F.coalesce(n("claiming_pct"), F.lit("?")), F.lit("%")),
                 "Medium", 95, False, F.when(F.col("claiming_pct") < 20, "low rate"), columns="claim_columns"),
        _finding(facts, 4, 2, F.col("has_geo") == 1,
                 F.lit(TITLES["geography"]), "Medium", 85, False, columns="geo_columns"),
    ]
    w = Window.partitionBy("dataset", "status").orderBy("check_no")
    ranked = status.where(F.col("status").isin("fail", "warn")).withColumn("_k", F.row_number().over(w))
    fails = ranked.where((F.col("status") == "fail") & (F.col("_k") <= max_fails)).select(
        "dataset", F.lit(SECTIONS[2]).alias("section"), F.col("check_no").alias("_o"),
        F.concat(F.lit(TITLES["fail"]), F.col("check")).alias("title"), F.lit("High").alias("impact"),
        F.lit(95).alias("confidence"), F.lit(True).alias("human_review"), F.lit(None).cast("string").alias("note"), flagged)
    warns = ranked.where((F.col("status") == "warn") & (F.col("_k") <= max_warns)).select(
        "dataset", F.lit(SECTIONS[2]).alias("section"), (F.col("check_no") + 100).alias("_o"),
        F.concat(F.lit(TITLES["warn"]), F.col("check")).alias("title"), F.lit("Medium").alias("impact"),
        F.lit(85).alias("confidence"), F.lit(False).alias("human_review"), F.lit(None).cast("string").alias("note"), flagged)
    out = parts[0]
    for p in parts[1:] + [fails, warns]:
        out = out.unionByName(p)
    sec = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    w2 = Window.partitionBy("dataset", "section").orderBy("_o")
    return out.select(
        "dataset", sec.cast("int").alias("section_no"), "section",
        F.row_number().over(w2).cast("int").alias("item_no"), "title", "impact",
        F.col("confidence").cast("int").alias("confidence"), "human_review", "note", "columns")


def roadmap(facts: DataFrame) -> DataFrame:
    """The steps each dataset's contents call for, numbered."""
    spark = facts.sparkSession
    steps = spark.createDataFrame(
        [(i + 1,) + s for i, s in enumerate(ROADMAP_STEPS)],
        "step_order int, step_key string, title string, priority string, effort string, business_value string")
    claims = F.col("has_claims") == 1
    gate = (
        F.when(F.col("step_key") == "remediation", (F.col("n_fail") > 0) | (F.col("n_warn") > 3))
        .when(F.col("step_key") == "exposure", F.col("has_exposure") == 1)
        .when(F.col("step_key").isin("claims_validation", "claims_overview", "severity", "frequency"), claims)
        .when(F.col("step_key") == "geography", F.col("has_geo") == 1)
        .when(F.col("step_key") == "pet", F.col("has_pet") == 1)
        .when(F.col("step_key") == "premium", F.col("has_premium") == 1)
        .when(F.col("step_key") == "trends", F.col("has_dates") == 1)
        .when(F.col("step_key") == "expected_loss", claims & (F.col("has_exposure") == 1))
        .when(F.col("step_key") == "targets", F.col("n_targets") > 0)
        .otherwise(F.lit(True)))
    # 15 fixed steps: broadcast to every dataset row.
    both = facts.crossJoin(F.broadcast(steps)).where(gate)
    w = Window.partitionBy("dataset").orderBy("step_order")
    title = F.replace(F.col("title"), F.lit("{n}"), F.col("n_targets").cast("string"))
    return both.select(
        "dataset", F.row_number().over(w).cast("int").alias("step_no"), "step_key",
        title.alias("title"), "priority", "effort", "business_value")


def roadmap_summary(steps: DataFrame) -> DataFrame:
    """Step count and high-priority count per dataset."""
    return steps.groupBy("dataset").agg(
        F.count(F.lit(1)).cast("bigint").alias("steps"),
        F.count_if(F.col("priority") == "High").cast("bigint").alias("high_priority"))
