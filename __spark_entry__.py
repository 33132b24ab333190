"""

Every query reads the test tables under ``sf_dir`` (or the fixture views
Spark derives from them) in full. Double columns are rounded to 4 digits on
both sides so the value hash does not depend on last-bit float differences.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import oracles as O
from lakeprobe.operators import checks as Q
from lakeprobe.operators import distributions as D
from lakeprobe.operators import meta as M
from lakeprobe.operators.footers import coverage_of, footer_counts, footer_counts_of
from lakeprobe.operators.layouts import layout_votes, read_dates
from lakeprobe.operators.profile import coverage_summary, profile, samples
from lakeprobe.operators.rules import (CUSTOMER_EXACT, CUSTOMER_PATTERN, POLICY_EXACT,
                                       POLICY_PATTERN, claims_columns, find_column)
from lakeprobe.functions import parse_date, parse_number
from lakeprobe.plans.catalog import ProfileCatalog
from lakeprobe.plans.fixtures import dataset
from lakeprobe.operators.scoring import features, targets
from lakeprobe.plans.ingest import write_profiled
from lakeprobe.plans.report import assess, materialise, report, union_all
from lakeprobe.session import ensure_checkpoint_dir
from lakeprobe.sources.readers import read_csv, read_parquet, table
from lakeprobe.sources.sinks import write_document, write_report

try:  # the training-data operators are optional
    import corpus_pipeline
    from lakeprobe.llm import queries as LLM
except ModuleNotFoundError as gone:
    if gone.name not in ("corpus_pipeline", "lakeprobe.llm"):
        raise
    LLM = corpus_pipeline = None

AS_OF = O.AS_OF
ALL = O.TABLES + O.FIXTURE_NAMES
FX = O.FIXTURE_NAMES


def r4(df: DataFrame) -> DataFrame:
    """Round double columns to 4 digits."""
    return df.select([
        F.round(F.col(f"`{f.name}`"), 4).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the column profile of lineitem at sf0.001."""
    df = table(spark, "/root/testdata/sf0.001", "lineitem")
    return profile(df, "lineitem", as_of=AS_OF).select(
        "ordinal", "column", "dtype", "category", "non_null", "coverage_pct", "unique_values")


# ---------------------------------------------------------------------------
# helpers

def _profile(spark, sf, name, distinct=None):
    return profile(dataset(spark, sf, name), name, distinct=distinct, as_of=AS_OF)


def _catalog(spark, sf, names, distinct=None):
    """Profiles of ``names``."""
    return union_all([_profile(spark, sf, n, distinct) for n in names])


def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def _assess(spark, sf):
    return assess({n: dataset(spark, sf, n) for n in FX}, as_of=AS_OF, persist=True)


def _status(check: Callable, name: str = "dirty_fx", data: bool = False, distinct=None):
    def q(spark, sf):
        df = dataset(spark, sf, name)
        out = check(df, name) if data else check(profile(df, name, distinct=distinct, as_of=AS_OF))
        return r4(out)
    return q


# ---------------------------------------------------------------------------
# sources and sinks

def q_src_parquet_scan(spark, sf):
    df = table(spark, sf, "lineitem")
    return df.withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


def q_src_csv_roundtrip(spark, sf):
    path = _scratch(spark)
    odd = F.concat(F.col("c_name"), F.lit(', said "'), F.col("c_mktsegment"), F.lit('"\nand left'))
    (table(spark, sf, "customer").withColumn("c_name", odd).withColumn("is_rich", F.col("c_acctbal") > 5000)
     .write.option("header", True).option("escape", '"').csv(path))
    return read_csv(spark, path, multi_line=True)


def q_src_csv_encoding(spark, sf):
    path = _scratch(spark)
    (table(spark, sf, "customer").withColumn("c_name", F.concat("c_name", F.lit(" é")))
     .write.option("header", True).option("encoding", "ISO-8859-1").csv(path))
    return read_csv(spark, path)


def q_meta_shape(spark, sf):
    # the raw file scan; bytes on disk depend on the files and are tested apart
    shape = M.meta_shape(read_parquet(spark, f"{sf.rstrip('/')}/lineitem.parquet"), "lineitem", "PARQUET")
    return shape.select("dataset", "rows", "columns", "file_type", (F.col("bytes") > 0).alias("has_bytes"))


def q_sink_report_json(spark, sf):
    path = _scratch(spark)
    r = report(dataset(spark, sf, "dirty_fx"), "dirty_fx", as_of=AS_OF, persist=True)
    write_report(r, path)
    return r4(spark.read.json(f"{path}/check_status"))


def _document(spark, sf):
    """The report of dirty_fx as one JSON document, written and read back."""
    path = _scratch(spark)
    doc = write_document(report(dataset(spark, sf, "dirty_fx"), "dirty_fx", as_of=AS_OF, persist=True), path)
    return spark.read.schema(doc.schema).json(path)


def q_report_document(spark, sf):
    return r4(_document(spark, sf).select("dataset", F.inline("quality.checks")))


def q_report_document_columns(spark, sf):
    doc = _document(spark, sf).select("dataset", "readiness.score", F.size("findings").alias("n_findings"), F.inline("anatomy"))
    return r4(doc.select("dataset", "score", "n_findings", "ordinal", "column", "dtype", "category", "non_null", "coverage_pct", "unique_values"))


def q_finding_columns(spark, sf):
    """The columns that each finding is about, one row each."""
    return _assess(spark, sf)["findings"].select("dataset", "section", "item_no", F.posexplode("columns").alias("place", "column"))


# ---------------------------------------------------------------------------
# profile

def q_profile_columns(spark, sf):
    return _profile(spark, sf, "lineitem", "exact").select(
        "ordinal", "column", "dtype", "category", "non_null", "coverage_pct", "unique_values")


def q_profile_coverage(spark, sf):
    return r4(_profile(spark, sf, "lineitem").select("ordinal", "column", "rows", "non_null",
                                                     "coverage", "coverage_pct"))


def q_profile_distinct(spark, sf):
    return _profile(spark, sf, "dirty_fx", "exact").select("ordinal", "column", "unique_values")


def q_profile_types(spark, sf):
    return _catalog(spark, sf, ALL).select("dataset", "ordinal", "column", "dtype")


def q_profile_samples(spark, sf):
    return samples(dataset(spark, sf, "dirty_fx"), "event_id", 5, "dirty_fx").drop("dataset")


def q_coverage_summary(spark, sf):
    return coverage_summary(_catalog(spark, sf, ALL))


def q_rule_category(spark, sf):
    """Coverage by category, next to each column's category."""
    return r4(_catalog(spark, sf, ALL).select("dataset", "ordinal", "column", "category", "non_null", "coverage_pct"))


def _measured(cat, picked, name, metric):
    """The picked column of each dataset and one of its measures."""
    m = cat.select("dataset", F.col("column").alias(name), F.col(metric).alias(f"{name.rsplit('_', 1)[0]}_{metric}"))
    return picked.withColumnRenamed("column", name).join(m, ["dataset", name], "left")


def q_rule_find_column(spark, sf):
    cat = materialise(_catalog(spark, sf, ALL))
    pol = _measured(cat, find_column(cat, POLICY_PATTERN, POLICY_EXACT), "policy_column", "non_null")
    cus = _measured(cat, find_column(cat, CUSTOMER_PATTERN, CUSTOMER_EXACT), "customer_column", "non_null")
    return cat.select("dataset").distinct().join(pol, "dataset", "left").join(cus, "dataset", "left")


def q_rule_claims_columns(spark, sf):
    cat = materialise(_catalog(spark, sf, ALL))
    out = claims_columns(cat)
    for name in ("amount_col", "flag_col", "count_col"):
        m = cat.select("dataset", F.col("column").alias(name), F.col("non_null").alias(f"{name.split('_')[0]}_non_null"))
        out = out.join(m, ["dataset", name], "left")
    return out


def q_rule_targets(spark, sf):
    """Targets, with the rows in which all their source columns can have values."""
    cat = materialise(_catalog(spark, sf, FX))
    each = targets(cat).withColumn("column", F.explode(F.split("source_columns", ",")))
    least = each.join(cat.select("dataset", "column", "non_null"), ["dataset", "column"], "left").groupBy(
        "dataset", "target_rank").agg(F.min("non_null").alias("usable_rows"))
    return targets(cat).join(least, ["dataset", "target_rank"])


def q_rule_features(spark, sf):
    return features(_catalog(spark, sf, FX))


# ---------------------------------------------------------------------------
# claims and distributions

def _flag(cols):
    def q(spark, sf):
        df = dataset(spark, sf, "policy_fx")
        pred = D.claim_predicate(df, {"amount": None, "flag": None, "count": None, **cols})
        return df.agg(F.count_if(pred).cast("bigint").alias("claims"),
                      F.count(F.lit(1)).cast("bigint").alias("rows"))
    return q


def q_claims_rate(spark, sf):
    return D.claims_rate(dataset(spark, sf, "policy_fx"), "policy_fx")


def q_claims_amount_stats(spark, sf):
    return r4(D.claims_amount_stats(dataset(spark, sf, "policy_fx"), "policy_fx"))


def q_claims_skewness(spark, sf):
    return r4(D.claims_moments(dataset(spark, sf, "dirty_fx"), "dirty_fx").select("dataset", "n", "skewness"))


def q_claims_percentiles(spark, sf):
    return r4(D.claims_percentiles(dataset(spark, sf, "policy_fx"), "policy_fx"))


def q_claims_histogram(spark, sf):
    return r4(D.claims_histogram(dataset(spark, sf, "policy_fx"), "policy_fx"))


def q_category_distribution(spark, sf):
    return r4(D.category_distribution(table(spark, sf, "lineitem"), "l_quantity", "lineitem"))


def q_coverage_heatmaps(spark, sf):
    df = dataset(spark, sf, "policy_fx")
    return r4(D.coverage_heatmaps(df, profile(df, "policy_fx", as_of=AS_OF), "policy_fx"))


def q_meta_claim_rate(spark, sf):
    return M.claim_rate(dataset(spark, sf, "policy_fx"), "policy_fx")


def q_meta_unique_entities(spark, sf):
    return M.unique_entities(dataset(spark, sf, "policy_fx"), "policy_fx")


def q_meta_date_range(spark, sf):
    return M.date_range(dataset(spark, sf, "dirty_fx"), "dirty_fx")


# ---------------------------------------------------------------------------
# scalars

def q_scalar_parse_date(spark, sf):
    df = dataset(spark, sf, "dirty_fx")
    return df.select("event_id", "renewal_date",
                     parse_date(F.col("renewal_date")).cast("string").alias("parsed"))


def q_scalar_parse_number(spark, sf):
    df = dataset(spark, sf, "dirty_fx")
    return r4(df.select("event_id", "mixed_txt", parse_number(F.col("mixed_txt")).alias("parsed")))


def q_date_layout_read(spark, sf):
    """The text dates of orders, each column read by the layout of its vote."""
    cols = list(O.LAYOUT_COLUMNS[:4])
    df = read_dates(dataset(spark, sf, "layout_fx"), cols)
    return df.select("order_id", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in cols])


# ---------------------------------------------------------------------------
# the stored catalog

def _stored(spark, sf, names) -> ProfileCatalog:
    """A catalog of whole test tables, read from their files."""
    catalog = ProfileCatalog(spark, _scratch(spark))
    catalog.refresh_all({n: f"{sf.rstrip('/')}/{n}.parquet" for n in names}, as_of=AS_OF)
    return catalog


_STORED = ("dataset", "ordinal", "column", "dtype", "category", "rows", "non_null", "coverage_pct", "date_parsed",
           "num_parsed", "negatives", "bad_dates", "future_dates")


def q_catalog_refresh(spark, sf):
    """lineitem arrives in three appends; the catalog reads each file once."""
    path, catalog = _scratch(spark), ProfileCatalog(spark, _scratch(spark))
    li = table(spark, sf, "lineitem")
    for arrived in ("l_linenumber <= 2", "l_linenumber BETWEEN 3 AND 4", "l_linenumber > 4"):
        li.where(arrived).write.mode("append").parquet(path)
        catalog.refresh("lineitem", path, as_of=AS_OF)
    return r4(catalog.profile().select(*_STORED))


def q_catalog_lake(spark, sf):
    return r4(_stored(spark, sf, O.TABLES).profile().select(*_STORED))


def q_catalog_features(spark, sf):
    """Feature classes of every table from the stored profiles: no scan of data."""
    return features(_stored(spark, sf, O.TABLES).profile(distinct="sketch"))


def q_catalog_distinct(spark, sf):
    """Distinct values of unions of columns, from sketches, beside the exact counts."""
    groups = {g: list(pairs) for g, pairs in O.DISTINCT_GROUPS.items()}
    found = _stored(spark, sf, sorted({d for p in groups.values() for d, _ in p})).distinct(groups)
    exact = union_all([union_all([table(spark, sf, d).select(F.col(c).cast("string").alias("v")) for d, c in pairs]).agg(
        F.count_distinct("v").alias("exact")).select(F.lit(g).alias("name"), "exact") for g, pairs in groups.items()])
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(1), 0.05 * F.col("exact"))
    return found.join(exact, "name").select("name", "exact", near.alias("within_5_percent"))


def q_catalog_outliers(spark, sf):
    """Exact quartiles and outliers whose brackets come from stored sketches."""
    kll = _stored(spark, sf, ["lineitem"]).quantile_sketches().drop("dataset")
    return r4(Q.outlier_counts(table(spark, sf, "lineitem"), "lineitem", sketches=kll))


def q_profile_observed(spark, sf):
    """The profile of dirty_fx, observed while it is written."""
    return r4(write_profiled(dataset(spark, sf, "dirty_fx"), _scratch(spark), "dirty_fx", as_of=AS_OF).select(*_STORED))


def q_footer_checks(spark, sf):
    """Missing cells, sparse columns and coverage of every table from its footers."""
    counts = coverage_of(footer_counts_of(spark, {n: f"{sf.rstrip('/')}/{n}.parquet" for n in O.TABLES}))
    return r4(union_all([Q.check_missing(counts), Q.check_sparse(counts), Q.check_coverage(counts)]))


# ---------------------------------------------------------------------------
# rule layer over the three fixtures

def _rule(key):
    def q(spark, sf):
        return r4(_assess(spark, sf)[key])
    return q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = _queries()
    if LLM is not None:
        out |= LLM.queries() | {"pipeline": corpus_pipeline.run}
    return out


def _queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "src_parquet_scan": q_src_parquet_scan,
        "src_csv_roundtrip": q_src_csv_roundtrip,
        "src_csv_encoding": q_src_csv_encoding,
        "meta_shape": q_meta_shape,
        "sink_report_json": q_sink_report_json,
        "profile_columns": q_profile_columns,
        "profile_coverage": q_profile_coverage,
        "profile_distinct": q_profile_distinct,
        "profile_types": q_profile_types,
        "profile_samples": q_profile_samples,
        "coverage_summary": q_coverage_summary,
        "rule_category": q_rule_category,
        "rule_find_column": q_rule_find_column,
        "rule_claims_columns": q_rule_claims_columns,
        "claims_flag_amount": _flag({"amount": "claim_amount"}),
        "claims_flag_count": _flag({"count": "claim_count"}),
        "claims_flag_string": _flag({"flag": "has_claim"}),
        "claims_rate": q_claims_rate,
        "claims_amount_stats": q_claims_amount_stats,
        "claims_skewness": q_claims_skewness,
        "claims_percentiles": q_claims_percentiles,
        "claims_histogram": q_claims_histogram,
        "category_distribution": q_category_distribution,
        "coverage_heatmaps": q_coverage_heatmaps,
        "meta_claim_rate": q_meta_claim_rate,
        "meta_unique_entities": q_meta_unique_entities,
        "meta_date_range": q_meta_date_range,
        "check_missing": _status(Q.check_missing),
        "check_dup_rows": _status(Q.check_dup_rows, data=True),
        "check_dup_cols": _status(Q.check_dup_cols, data=True),
        "check_zero_variance": _status(Q.check_zero_variance),
        "check_sparse": _status(Q.check_sparse),
        "check_date_integrity": _status(Q.check_date_integrity),
        "check_outliers": _status(Q.check_outliers, data=True),
        "check_unexpected_nulls": _status(Q.check_unexpected_nulls),
        "check_mixed_types": _status(Q.check_mixed_types),
        "check_cardinality": _status(Q.check_cardinality, distinct="text"),
        "check_negatives": _status(Q.check_negatives),
        "check_coverage": _status(Q.check_coverage),
        "check_status_all": lambda spark, sf: r4(Q.run_checks(
            dataset(spark, sf, "dirty_fx"), _profile(spark, sf, "dirty_fx", "text"), "dirty_fx")),
        "check_detail": lambda spark, sf: r4(Q.check_detail(
            dataset(spark, sf, "dirty_fx"), _profile(spark, sf, "dirty_fx", "text"), "dirty_fx")),
        "outlier_counts": lambda spark, sf: r4(Q.outlier_counts(dataset(spark, sf, "dirty_fx"), "dirty_fx")),
        "date_detail": lambda spark, sf: Q.date_detail(_profile(spark, sf, "dirty_fx")),
        "claims_summary": lambda spark, sf: r4(union_all([D.claims_summary(dataset(spark, sf, n), n) for n in FX[:2]])),
        "scalar_parse_date": q_scalar_parse_date,
        "scalar_parse_number": q_scalar_parse_number,
        "rule_targets": q_rule_targets,
        "rule_features": q_rule_features,
        "readiness_score": _rule("readiness"),
        "findings": lambda spark, sf: _rule("findings")(spark, sf).drop("columns"),
        "finding_columns": q_finding_columns,
        "report_document": q_report_document,
        "report_document_columns": q_report_document_columns,
        "roadmap_steps": _rule("roadmap"),
        "roadmap_summary": _rule("roadmap_summary"),
        "category_top_parts": lambda spark, sf: r4(D.category_distribution(table(spark, sf, "lineitem"), "l_partkey", "lineitem")),
        "category_top_prices": lambda spark, sf: r4(D.category_distribution(table(spark, sf, "lineitem"), "l_extendedprice", "lineitem")),
        "date_layout_votes": lambda spark, sf: layout_votes(dataset(spark, sf, "layout_fx"), dataset="layout_fx"),
        "date_layout_profile": lambda spark, sf: _profile(spark, sf, "layout_fx").where("kind = 'string'").select(
            "ordinal", "column", "dtype", "date_layout", "date_parsed", "bad_dates", "layout_conflicts", "future_dates"),
        "date_layout_read": q_date_layout_read,
        "footer_counts": lambda spark, sf: footer_counts(spark, f"{sf.rstrip('/')}/lineitem.parquet", "lineitem"),
        "footer_checks": q_footer_checks,
        "profile_observed": q_profile_observed,
        "catalog_refresh": q_catalog_refresh,
        "catalog_lake": q_catalog_lake,
        "catalog_features": q_catalog_features,
        "catalog_distinct": q_catalog_distinct,
        "catalog_outliers": q_catalog_outliers,
    }


def oracle_sql() -> dict[str, str]:
    out = O.oracle_queries()
    if LLM is not None:
        out |= LLM.oracle_sql()
        if corpus_pipeline.ORACLE_SQL is not None:
            out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
