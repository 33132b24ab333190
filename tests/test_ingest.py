"""Counts from footers, profiles observed while writing, wide tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakeprobe.operators.checks import dup_column_pairs
from lakeprobe.operators.footers import coverage_of, footer_counts, footer_counts_of, pushed
from lakeprobe.operators.profile import partials, profile
from lakeprobe.plans import ingest
from lakeprobe.plans.ingest import write_profiled
from lakeprobe.sources.readers import infer_types, table

from .conftest import SF
from .test_plans import _plan

AS_OF = "2024-01-10"


def test_footers_answer_without_a_scan(spark):
    one, cols = pushed(spark, f"{SF}/lineitem.parquet")
    plan = _plan(one)
    # nothing but the answers is read
    assert "BatchScan parquet" in plan and "[count(*)#" in plan and "min(l_orderkey)#" in plan
    assert "PushedAggregation: [COUNT(*)" in plan and len(cols) == 7
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def _mixed(spark):
    day = dt.date(2024, 1, 2)
    rows = [(1, 1.5, "a", [1], day, True), (None, float("nan"), None, None, None, None), (-7, None, "b", [None], dt.date(2023, 5, 6), False)]
    return spark.createDataFrame(rows, "`a k` int, f double, s string, n array<int>, d date, b boolean")


def test_footer_counts_with_nan_nested_and_nulls(spark, tmp_path):
    path = str(tmp_path / "t")
    _mixed(spark).write.parquet(path)
    got = {r["column"]: (r["rows"], r["non_null"], r["low"], r["high"]) for r in footer_counts(spark, path).collect()}
    assert got == {"a k": (3, 2, "-7", "1"), "f": (3, 1, None, None), "s": (3, 2, None, None), "n": (3, 2, None, None),
                   "d": (3, 2, "2023-05-06", "2024-01-02"), "b": (3, 2, None, None)}
    want = {r["column"]: (r["coverage"], r["coverage_pct"]) for r in profile(spark.read.parquet(path), distinct=None).collect()}
    assert {r["column"]: (r["coverage"], r["coverage_pct"]) for r in coverage_of(footer_counts(spark, path)).collect()} == want


def test_footer_counts_of_empty_and_partitioned_tables(spark, tmp_path):
    none, hive = str(tmp_path / "none"), str(tmp_path / "hive")
    _mixed(spark).limit(0).write.parquet(none)
    assert {(r["rows"], r["non_null"], r["low"]) for r in footer_counts(spark, none).collect()} == {(0, 0, None)}
    assert coverage_of(footer_counts(spark, none)).first()["coverage"] is None
    _mixed(spark).write.partitionBy("s").parquet(hive)
    got = {r["column"]: r["non_null"] for r in footer_counts(spark, hive).collect()}
    assert got == {"a k": 2, "f": 1, "n": 2, "d": 2, "b": 2, "s": 2}


def test_footers_of_many_datasets(spark):
    paths = {n: f"{SF}/{n}.parquet" for n in ("nation", "orders", "embeddings")}
    many = sorted(footer_counts_of(spark, paths).collect())
    assert many == sorted(r for n, p in paths.items() for r in footer_counts(spark, p, n).collect())
    assert footer_counts_of(spark, {}).collect() == []


def test_files_without_statistics_are_scanned(spark, tmp_path):
    path = str(tmp_path / "t")
    _mixed(spark).write.option("parquet.column.statistics.enabled", "false").option("parquet.statistics.enabled", "false").parquet(path)
    got = {r["column"]: (r["rows"], r["non_null"], r["low"]) for r in footer_counts(spark, path).collect()}
    assert got["a k"] == (3, 2, "-7") and got["s"] == (3, 2, None)


@pytest.mark.parametrize("name", ["dirty", "empty", "mixed"])
def test_observed_profile_is_the_profile(spark, tmp_path, name):
    df = _mixed(spark)
    if name == "empty":
        df = df.limit(0)
    if name == "dirty":
        df = table(spark, SF, "events").withColumn("sent date", F.date_format("ts", "dd/MM/yyyy")).repartition(5)
    path = str(tmp_path / "t")
    got = write_profiled(df, path, "t", AS_OF, batch=2)
    assert sorted(got.collect()) == sorted(profile(df, "t", distinct=None, as_of=AS_OF).collect())
    back = spark.read.parquet(path)
    assert back.columns == df.columns and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_observed_dates_beyond_python(spark, tmp_path, monkeypatch):
    """Digits that read as years after 9999 and before 1, to the ends of what a timestamp holds."""
    rows = [("89999", "0000", "+294247-01-10 04:00:54.775807"), ("1209", "-0044-03-15", "12345-06-07 08:09:10.000001"), (None, None, None)]
    df = spark.createDataFrame(rows, "late string, early string, t string")
    df = df.withColumn("t", F.col("t").cast("timestamp_ntz")).withColumn("b", F.col("early").cast("timestamp_ntz"))
    got = write_profiled(df, str(tmp_path / "t"), "t", AS_OF).collect()
    assert sorted(got) == sorted(profile(df, "t", distinct=None, as_of=AS_OF).collect())
    assert {r["column"]: (r["date_parsed"], r["future_dates"]) for r in got} == {"late": (2, 1), "early": (2, 0), "t": (None, 2), "b": (None, 0)}
    # what merges over parts of a table comes back to the microsecond
    monkeypatch.setattr(ingest, "finish_profile", lambda parts: parts)
    seen, want = write_profiled(df, str(tmp_path / "u"), "t", AS_OF), partials(df, AS_OF)
    text = lambda d: sorted(map(tuple, d.select("ordinal", F.col("last").cast("string"), F.col("layouts").cast("string")).collect()))
    assert text(seen) == text(want) and seen.drop("unique_values", "dataset").schema.simpleString() == want.schema.simpleString()


def test_observing_needs_no_second_scan(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)
    df = spark.range(1000).repartition(4).rdd.map(lambda r: (reads.add(1), (r[0], "2024-01-02"))[1]).toDF("k long, d string")
    p = write_profiled(df, str(tmp_path / "t"), "t", AS_OF, partition_by=["d"])
    assert reads.value == 1000 and p.where("column = 'd'").first()["date_layout"] == "ISO"


def test_two_thousand_columns(spark):
    """Duplicate columns and CSV types of a table far wider than one aggregate."""
    n = 2000
    exprs = [(F.col("id") * (i + 3) % 1009 + (7 if i % 100 == 0 else i)).cast("string").alias(f"c{i}") for i in range(n)]
    exprs[1500], exprs[1999] = exprs[3].alias("c1500"), exprs[3].alias("c1999")
    df = spark.range(5).select(*exprs)
    rows = df.collect()
    first, want = {}, []
    for i in range(n):
        values = tuple(r[i] for r in rows)
        if values in first:
            want.append((f"c{i}", f"c{first[values]}"))
        first.setdefault(values, i)
    assert dup_column_pairs(df) == want and want
    typed = infer_types(df)
    assert {t for _, t in typed.dtypes} == {"bigint"} and len(typed.columns) == n


def test_duplicate_columns_with_equal_values_in_other_order(spark):
    rows = [(1, 2, 1, "1", None, 2, None), (2, 1, 2, "2", None, 1, None), (2, 2, 2, "2", 3, 2, None)]
    df = spark.createDataFrame(rows, "a int, b int, c long, d string, e int, f int, g int")
    assert dup_column_pairs(df) == [("c", "a"), ("d", "a"), ("f", "b")]
    for batch in (1, 2, 3):
        assert dup_column_pairs(df, batch) == [("c", "a"), ("d", "a"), ("f", "b")]
