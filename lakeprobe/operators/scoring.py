"""Targets and feature classes over the profile catalog.

Input is the profile of one or many tables (one row per dataset and column);
every rule is a column expression or a per-dataset aggregate, so a lake of
tables is labelled in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rules import name_match

# ---------------------------------------------------------------------------
# Target rules.
FREQ_FLAG = r"claim.?(flag|ind|indicator|binary)|has.?claim|is.?claim|clm.?flag"
FREQ_COUNT = r"claim.?(count|cnt|num|freq)|n.?claim|num.?claim"
SEV_AMOUNT = r"claim.?(amount|paid|value|cost)|paid.?amount|loss.?amount|incurred"
SEV_COUNT = r"claim.?(count|cnt|num)|n.?claim|num.?claim"
EL_SEVERITY = r"claim.?(amount|paid|value|incurred|cost)"
EL_EXPOSURE = r"exposure|expo|earned|duration|days_at_risk"
EL_FREQUENCY = r"claim.?(count|cnt|freq|num)|n.?claim"
RETENTION = r"lapse|churn|cancel|renew|retain|termination|policy.?end"
# name, type, confidence of each target kind
T_FREQ_FLAG = ("Claim Frequency (Binary)", "Frequency Target", 92)
T_FREQ_COUNT = ("Claim Count (Frequency)", "Frequency Target", 88)
T_SEVERITY = ("Claim Severity", "Severity Target", 95, 82)
T_EXPECTED_LOSS = ("Expected Loss", "Expected Loss Target", 78)
T_RETENTION = ("Retention / Lapse", "Retention Target", 72)
T_EXPLICIT = ("Explicit Label", 75)

# Feature rules.
HIGH_VALUE = (r"age|pet.?age|animal.?age|gender|sex|breed|province|state|region|plan|product|"
              r"vintage|tenure|channel|income|occupation|sum.?insured|coverage.?amount")
LEAKAGE = (r"future|post.?claim|after.?claim|next.?period|outcome|result|paid.?amount|total.?paid|"
           r"benefit.?paid|loss.?ratio|claim.?ratio")
SUSPICIOUS = r"loss.?ratio|combined.?ratio|profit|margin|expense.?ratio|settlement.?ratio"
HIGH_VALUE_CATEGORIES = ("Geography", "Pet", "Behavioural", "Product", "Policy")
FEATURE_RANK = (("Potential Leakage", 0), ("Suspicious", 1), ("Low Value", 2),
                ("High Value", 3), ("Modelling Feature", 4))
LOW_COVERAGE = 20
# ---------------------------------------------------------------------------

TARGET_SCHEMA = ("dataset string, target_rank int, name string, type string, formula string, "
                 "confidence int, source_columns string")


def _first(cond: Column) -> Column:
    return F.min_by(F.when(cond, F.col("column")), F.when(cond, F.col("ordinal")))


def _last(cond: Column) -> Column:
    return F.max_by(F.when(cond, F.col("column")), F.when(cond, F.col("ordinal")))


def _srcs(*cols: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*cols)))), ",")


def targets(catalog: DataFrame) -> DataFrame:
    """Candidate targets per dataset, deduplicated by lower-case name
    (first kept), ranked by confidence (stable)."""
    c = F.col("column")
    numeric = F.col("kind") == "numeric"
    flag = name_match(c, FREQ_FLAG)
    freq_cond = flag | (name_match(c, FREQ_COUNT) & numeric)
    g = catalog.groupBy("dataset").agg(
        F.min_by(F.when(freq_cond, F.struct(c.alias("col"), flag.alias("is_flag"))),
                 F.when(freq_cond, F.col("ordinal"))).alias("freq"),
        _first(name_match(c, SEV_AMOUNT)).alias("sev_amt"),
        _first(name_match(c, SEV_COUNT)).alias("sev_cnt"),
        _last(name_match(c, EL_SEVERITY)).alias("el_sev"),
        _last(name_match(c, EL_EXPOSURE)).alias("el_exp"),
        _last(name_match(c, EL_FREQUENCY)).alias("el_freq"),
        _first(name_match(c, RETENTION)).alias("ret"),
    )
    fcol = F.col("freq.col")
    freq = g.where(F.col("freq").isNotNull()).select(
        "dataset", F.lit(1).alias("seq"),
        F.when(F.col("freq.is_flag"), T_FREQ_FLAG[0]).otherwise(T_FREQ_COUNT[0]).alias("name"),
        F.lit(T_FREQ_FLAG[1]).alias("type"),
        F.when(F.col("freq.is_flag"), F.concat(fcol, F.lit(" = 1 (claim occurred)")))
        .otherwise(F.concat(F.lit("SUM("), fcol, F.lit(") / Exposure"))).alias("formula"),
        F.when(F.col("freq.is_flag"), T_FREQ_FLAG[2]).otherwise(T_FREQ_COUNT[2]).alias("confidence"),
        _srcs(fcol).alias("source_columns"))
    has_cnt = F.col("sev_cnt").isNotNull()
    sev = g.where(F.col("sev_amt").isNotNull()).select(
        "dataset", F.lit(2).alias("seq"), F.lit(T_SEVERITY[0]).alias("name"),
        F.lit(T_SEVERITY[1]).alias("type"),
        F.when(has_cnt, F.concat_ws(" / ", "sev_amt", "sev_cnt"))
        .otherwise(F.concat(F.col("sev_amt"), F.lit(" (where claim > 0)"))).alias("formula"),
        F.when(has_cnt, T_SEVERITY[2]).otherwise(T_SEVERITY[3]).alias("confidence"),
        _srcs(F.col("sev_amt"), F.col("sev_cnt")).alias("source_columns"))
    el = g.where(F.col("el_sev").isNotNull() & F.col("el_exp").isNotNull()).select(
        "dataset", F.lit(3).alias("seq"), F.lit(T_EXPECTED_LOSS[0]).alias("name"),
        F.lit(T_EXPECTED_LOSS[1]).alias("type"),
        F.concat(F.lit("("), F.col("el_sev"), F.lit(" / "), F.col("el_exp"), F.lit(")"),
                 F.when(F.col("el_freq").isNotNull(), F.concat(F.lit(" × "), F.col("el_freq")))
                 .otherwise(F.lit(""))).alias("formula"),
        F.lit(T_EXPECTED_LOSS[2]).alias("confidence"),
        _srcs(F.col("el_sev"), F.col("el_exp"), F.col("el_freq")).alias("source_columns"))
    ret = g.where(F.col("ret").isNotNull()).select(
        "dataset", F.lit(4).alias("seq"), F.lit(T_RETENTION[0]).alias("name"),
        F.lit(T_RETENTION[1]).alias("type"),
        F.concat(F.col("ret"), F.lit(" (binary: lapsed vs. retained)")).alias("formula"),
        F.lit(T_RETENTION[2]).alias("confidence"), _srcs(F.col("ret")).alias("source_columns"))
    explicit = catalog.where(F.col("category") == "Potential Targets").select(
        "dataset", (F.lit(5) + F.col("ordinal")).alias("seq"), F.col("column").alias("name"),
        F.lit(T_EXPLICIT[0]).alias("type"), F.col("column").alias("formula"),
        F.lit(T_EXPLICIT[1]).alias("confidence"), F.col("column").alias("source_columns"))
    allt = freq.unionByName(sev).unionByName(el).unionByName(ret).unionByName(explicit)
    w_dup = Window.partitionBy("dataset", F.lower("name")).orderBy("seq")
    w_rank = Window.partitionBy("dataset").orderBy(F.col("confidence").desc(), F.col("seq"))
    # Windows here hold one dataset's candidates: a handful of rows.
    uniq = allt.withColumn("_d", F.row_number().over(w_dup)).where(F.col("_d") == 1)
    return uniq.withColumn("target_rank", F.row_number().over(w_rank)).select(
        "dataset", F.col("target_rank").cast("int").alias("target_rank"), "name", "type", "formula",
        F.col("confidence").cast("int").alias("confidence"), "source_columns")


def features(catalog: DataFrame) -> DataFrame:
    """Feature class and confidence for every column that is not a
    potential target, ranked by class then column order."""
    c, cat, cov = F.col("column"), F.col("category"), F.col("coverage_pct")
    high_conf = F.least(F.lit(95), F.lit(60) + F.floor(cov / 3).cast("int"))
    def cls(k: str, conf) -> Column:
        return F.struct(F.lit(k).alias("k"), (conf if isinstance(conf, Column) else F.lit(conf)).alias("c"))

    rule = (
        F.when(cat == "Identifiers", cls("Low Value", 95))
        .when(cat == "Potential Leakage", cls("Potential Leakage", 85))
        .when(cov < LOW_COVERAGE, cls("Low Value", 90))
        .when(F.col("constant"), cls("Low Value", 98))
        .when(name_match(c, LEAKAGE), cls("Potential Leakage", 75))
        .when(name_match(c, SUSPICIOUS), cls("Suspicious", 70))
        .when(name_match(c, HIGH_VALUE) | cat.isin(*HIGH_VALUE_CATEGORIES), cls("High Value", high_conf))
        .otherwise(cls("Modelling Feature", 55)))
    rank = None
    for k, r in FEATURE_RANK:
        rank = F.when(F.col("classification") == k, r) if rank is None else rank.when(F.col("classification") == k, r)
    scored = catalog.where(cat != "Potential Targets").withColumn("_r", rule).select(
        "dataset", "ordinal", F.col("column").alias("name"), "category",
        F.col("_r.k").alias("classification"), F.col("_r.c").cast("int").alias("confidence"))
    scored = scored.withColumn("class_rank", rank.otherwise(5).cast("int"))
    w = Window.partitionBy("dataset").orderBy("class_rank", "ordinal")
    return scored.withColumn("feature_rank", F.row_number().over(w).cast("int")).select(
        "dataset", "feature_rank", "name", "classification", "confidence", "class_rank")
