import math

import pytest

from lakeprobe.operators.profile import coverage_summary, profile, samples
from lakeprobe.operators.schema import categories_of
from lakeprobe.sources.readers import table

from .conftest import SF


def _rows(df):
    return {r["column"]: r for r in df.collect()}


def test_nan_null_allnull_constant(spark):
    data = [(1.0, None, 7, "a"), (float("nan"), None, 7, "a"), (None, None, 7, "a"), (2.0, None, 7, None)]
    df = spark.createDataFrame(data, "x double, z string, k int, s string")
    p = _rows(profile(df, "t", as_of="2024-01-10"))
    assert p["x"]["non_null"] == 2 and p["x"]["unique_values"] == 2
    assert p["x"]["coverage_pct"] == 50.0
    assert p["z"]["non_null"] == 0 and p["z"]["unique_values"] == 0 and p["z"]["dtype"] == "object"
    assert p["k"]["unique_values"] == 1 and p["k"]["dtype"] == "integer"
    assert p["s"]["coverage"] == 0.75


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    p = profile(df, "e").collect()
    assert len(p) == 2
    assert all(r["rows"] == 0 and r["coverage"] is None for r in p)


def test_nested_column(spark):
    df = table(spark, SF, "embeddings")
    p = _rows(profile(df, "embeddings"))
    assert p["embedding"]["dtype"] == "nested" and p["embedding"]["unique_values"] is None
    assert p["embedding"]["non_null"] == 500


def test_string_dates_detected(spark):
    df = spark.createDataFrame([("2024-01-0%d" % (i % 9 + 1),) for i in range(20)] + [("junk",)] * 5, "d string")
    p = _rows(profile(df))
    assert p["d"]["dtype"] == "datetime (string)"
    assert p["d"]["bad_dates"] == 5


@pytest.mark.parametrize("name,cat", [
    ("gender", "Dates"), ("l_extendedprice", "Dates"), ("earned_premium", "Exposure"),
    ("product_code", "Identifiers"), ("claim_flag", "Claims"), ("renewal_flag", "Dates"),
    ("capacity", "Geography"), ("quality_score", "Potential Targets"), ("language", "Behavioural"),
    ("estimate", "Other"), ("future_premium", "Potential Leakage"), ("Policy ID", "Identifiers"),
])
def test_category_names(spark, name, cat):
    df = spark.createDataFrame([(1,)], f"`{name}` int")
    assert categories_of(spark, df)[name] == cat


def test_lineitem_profile_and_summary(spark):
    df = table(spark, SF, "lineitem")
    prof = profile(df, "lineitem")
    p = _rows(prof)
    assert p["l_orderkey"]["unique_values"] == 14743
    assert p["l_returnflag"]["category"] == "Potential Targets"
    assert p["l_shipdate"]["dtype"] == "datetime"
    s = coverage_summary(prof).first()
    assert s["avg_coverage"] == 100.0 and s["fully_populated"] == 11 and s["sparse_columns"] == 0


def test_samples_first_by_key(spark):
    df = spark.createDataFrame([(i, None if i % 2 else f"v{i}") for i in range(100)], "id int, s string")
    got = [r["value"] for r in samples(df, "id", 5).where("column = 's'").orderBy("sample_no").collect()]
    assert got == ["v0", "v2", "v4", "v6", "v8"]
