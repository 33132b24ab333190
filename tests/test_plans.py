"""Plan shape: the properties the scale design relies on."""

import re

from lakeprobe.operators import distributions as D
from lakeprobe.operators.profile import profile
from lakeprobe.plans.fixtures import dataset
from lakeprobe.sources.readers import read_parquet

from .conftest import SF, SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_is_one_scan(spark):
    df = read_parquet(spark, f"{SF}/lineitem.parquet")
    plan = _plan(profile(df, "lineitem", distinct=None, as_of="2024-01-10"))
    assert len(re.findall(r"FileScan parquet", plan)) == 1
    assert "Expand" not in plan


def test_distincts_copy_no_rows_and_shuffle_no_text(spark):
    df = read_parquet(spark, f"{SF}/documents.parquet")
    plan = _plan(profile(df, "documents", as_of="2024-01-10"))
    assert "Expand" not in plan
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert keys and not any("c1#" in k for k in keys)  # c1 is the text
    assert any("h1#" in k and "h2#" in k for k in keys)


def test_claims_read_only_needed_columns(spark):
    df = dataset(spark, SF, "policy_fx")
    plan = _plan(D.claims_amount_stats(df, "policy_fx"))
    schemas = set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan))
    assert schemas == {"struct<l_extendedprice:double,l_discount:double,l_returnflag:string>"}


def test_quantiles_broadcast_for_known_groups_only(spark):
    long = spark.range(100).selectExpr("'a' AS column", "CAST(id AS DOUBLE) AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "BroadcastExchange" in _plan(D.quantiles(long, ["column"], [0.5], few_groups=True))
        assert "BroadcastExchange" not in _plan(D.quantiles(long, ["column"], [0.5]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_few_values_reach_the_ranking(spark, monkeypatch):
    """2 million distinct values: the window that ranks them sees some thousand."""
    long = spark.range(2_000_000).selectExpr("'a' AS column", "CAST(id AS DOUBLE) * 1.5 AS v")
    q = D.quantiles(long, ["column"], [0.25, 0.5, 0.99], few_groups=True)
    got = [r["value"] for r in q.orderBy("q_no").collect()]
    assert got == [1.5 * 1_999_999 * p for p in (0.25, 0.5, 0.99)]
    monkeypatch.setattr(D, "SUB_BUCKETS", 1)
    coarse = D.quantiles(long, ["column"], [0.5], few_groups=True)
    assert coarse.first()["value"] == 1.5 * 1_999_999 / 2
    # per target: values of one of 4,096 steps of a bracket of 2 x 3 / accuracy
    assert 2_000_000 * 6e-4 / 4096 < 5_000


def test_a_missed_bracket_raises(spark, monkeypatch):
    import pytest
    long = spark.range(1000).selectExpr("'a' AS column", "CAST(id AS DOUBLE) AS v")
    real = D.F.percentile_approx
    monkeypatch.setattr(D.F, "percentile_approx", lambda c, p, a: D.F.transform(real(c, p, a), lambda x: x * 0 - 5.0))
    with pytest.raises(Exception, match="outside its bracket"):
        D.quantiles(long, ["column"], [0.5]).collect()


def test_the_report_scans_its_table_a_bounded_number_of_times(spark):
    from lakeprobe.plans.report import report
    df = dataset(spark, SF, "dirty_fx")
    parts = report(df, "dirty_fx", as_of="2024-01-10", distinct=None)
    heat = _plan(parts["heatmaps"])
    assert len(re.findall("FileScan parquet", heat)) <= 2 * 2  # two arms of the view; the counts are shared
    for name in ("findings", "readiness", "roadmap", "targets", "features", "check_status", "check_detail"):
        assert "FileScan parquet" not in _plan(parts[name]), name


def test_wide_profiles_run_in_compiled_code(spark):
    """Many text columns and others: each aggregate has generated code, in methods the JVM compiles."""
    row = {f"t{i}": "2024-01-02" if i % 2 else "7" for i in range(5)} | {f"n{i}": i for i in range(40)} | {"year_1": 2000}
    df = spark.createDataFrame([row, {**dict.fromkeys(row), "t0": "03/04/2024"}], ", ".join(
        f"{c} {'string' if c[0] == 't' else 'bigint'}" for c in row))
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        prof = profile(df, "wide", distinct=None, as_of="2024-01-10")
        query = prof._jdf.queryExecution().executedPlan()
        partial = [line for line in query.toString().split("\n") if "functions=[partial_" in line]
        debug = getattr(getattr(spark._jvm, "org.apache.spark.sql.execution.debug.package$"), "MODULE$")
        made = debug.codegenStringSeq(query)
        sizes = [made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())]
        rows = {r["column"]: r for r in prof.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
    assert partial and all(re.search(r"\*\(\d+\) HashAggregate", line) for line in partial)
    assert max(sizes) < 8000
    assert list(rows) == list(row) and [r["ordinal"] for r in rows.values()] == list(range(len(row)))
    assert all((r["rows"], r["non_null"]) == (2, 2 if c == "t0" else 1) for c, r in rows.items())
    assert rows["t1"]["date_layout"] == "ISO" and rows["t0"]["date_layout"] == "MM/dd/yyyy" and rows["t0"]["bad_dates"] == 1


def test_rules_over_the_catalog_scan_no_table_again(spark):
    import __spark_entry__ as entry
    for name in ("rule_targets", "rule_claims_columns", "rule_find_column"):
        assert "FileScan parquet" not in _plan(entry.queries()[name](spark, SF_SMALL)), name


def test_bracket_steps_are_counted_before_they_are_set_apart(spark):
    from pyspark.sql import functions as F
    rows = spark.range(1000).selectExpr("'a' AS column", "id % 3 AS m", "CASE WHEN id < 10 THEN id % 2 END AS b")
    got = D.mark_counts(rows, ["column"], {-1: F.col("m"), 0: F.col("b")})
    assert {(r["i"], r["b"]): r["cnt"] for r in got.collect()} == {(-1, 0): 334, (-1, 1): 333, (-1, 2): 333, (0, 0): 5, (0, 1): 5}
    plan = _plan(got)
    assert plan.index("Generate explode") < plan.index("partial_count(1)")  # the plan reads from the last step to the first


def test_outliers_are_counted_without_a_row_per_value(spark):
    from lakeprobe.operators import checks as Q
    nan, inf = float("nan"), float("inf")
    names = [f"n{i}" for i in range(30)]
    rows = [tuple(float(r * (i + 1)) for i in range(30)) for r in range(20)]
    rows += [tuple([nan, inf, None, 1e9] + [-1e9] * 26)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    got = {r["column"]: r["outliers"] for r in Q.outlier_counts(df, "t").collect()}
    assert got == {n: 0 if i in (0, 2) else 1 for i, n in enumerate(names)}
    fences = spark.createDataFrame([(n, 0.0, 1.0) for n in names[1:]], "column string, lo double, hi double")
    assert {r["column"]: r["outliers"] for r in Q._outside(df, names, fences).collect()}["n0"] == 0
    assert "Generate explode" not in _plan(Q._outside(df, names, fences))


def test_hash_sums_are_longs_and_tell_the_whole(spark):
    from pyspark.sql import functions as F
    from lakeprobe.operators import checks as Q
    for h in (-2 ** 63, -1, 0, 2 ** 63 - 1, 1 << 44, 123456789012345678):
        sums = spark.range(3).select(F.lit(h).cast("bigint").alias("h")).agg(*Q._hash_sums(F.col("h")))
        assert {t for _, t in sums.dtypes} == {"bigint"}
        a, b, c = sums.first()
        assert (a << 44) + (b << 22) + c == 3 * h
