"""T1 over a column: one layout a column, by vote."""

import datetime as dt

import pytest

from lakeprobe.functions import LAYOUTS, parse_date, parse_date_as
from lakeprobe.operators.layouts import layout_votes, read_dates
from lakeprobe.operators.meta import date_range
from lakeprobe.operators.profile import profile
from pyspark.sql import functions as F

from .test_plans import _plan


def _votes(df):
    return {(r["column"], r["layout"]): (r["votes"], r["chosen"]) for r in layout_votes(df).collect()}


def test_ambiguous_values_follow_the_decisive_ones(spark):
    df = spark.createDataFrame([("01/02/2024",)] * 5 + [("13/02/2024",), ("02/14/2024",), ("25/12/2024",), (None,), ("",), ("junk",)], "d string")
    assert _votes(df) == {("d", "MM/dd/yyyy"): (6, False), ("d", "dd/MM/yyyy"): (7, True)}
    got = [r["d"] for r in read_dates(df, ["d"]).collect()]
    assert got == [dt.datetime(2024, 2, 1)] * 5 + [dt.datetime(2024, 2, 13), None, dt.datetime(2024, 12, 25), None, None, None]
    per_value = df.select(parse_date(F.col("d")).alias("d")).first()[0]
    assert per_value == dt.datetime(2024, 1, 2)
    p = profile(df, as_of="2024-03-01").first()
    assert (p["date_layout"], p["date_parsed"], p["bad_dates"], p["layout_conflicts"], p["future_dates"]) == ("dd/MM/yyyy", 7, 3, 1, 1)


def test_ties_go_to_the_earlier_layout(spark):
    df = spark.createDataFrame([("01/02/2024",), ("13/02/2024",), ("02/13/2024",)], "d string")
    assert _votes(df)[("d", "MM/dd/yyyy")] == (2, True)
    df = spark.createDataFrame([("20240102",), ("2024/01/02",), ("2024-01-02",)], "d string")
    assert [v for k, v in sorted(_votes(df).items())] == [(1, True), (1, False), (1, False)]


def test_one_value_by_each_layout(spark):
    texts = ["2024-01-02", "2024/01/02", "01/02/2024", "01/02/2024", "20240102", "Jan 2 2024"]
    rows = spark.createDataFrame([(t, l) for t, l in zip(texts, LAYOUTS)] + [("2024-01-02", None), (None, "ISO"), ("x", "ISO")], "t string, l string")
    got = [r[0] for r in rows.select(parse_date_as(F.col("t"), F.col("l"))).collect()]
    want = dt.datetime(2024, 1, 2)
    assert got == [want, want, want, dt.datetime(2024, 2, 1), want, want, None, None, None]


def test_no_dates_no_text_empty(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "s string, k int")
    assert _votes(df) == {}
    assert [tuple(r) for r in read_dates(df, ["s"]).collect()] == [(None, 1), (None, 2)]
    assert layout_votes(df.select("k")).collect() == []
    assert read_dates(df, []).collect() == df.collect()
    with pytest.raises(ValueError, match="k, z"):
        read_dates(df, ["k", "z"])
    none = df.limit(0)
    assert _votes(none) == {} and read_dates(none, ["s"]).collect() == []
    p = {r["column"]: r for r in profile(none).collect()}
    assert p["s"]["date_layout"] is None and p["s"]["date_parsed"] == 0 and p["s"]["constant"] and p["k"]["date_parsed"] is None


def test_odd_names_and_date_range(spark):
    df = spark.createDataFrame([("13/02/2024", "x", "20/01/2023"), ("01/02/2024", "y", "x")], "`my date` string, `a.b` string, `A.B date` string")
    got = read_dates(df, ["my date"])
    assert got.columns == df.columns and got.dtypes[0][1] == "timestamp_ntz" and got.dtypes[1][1] == "string"
    r = date_range(df).first()
    assert (r["date_min"], r["date_max"]) == ("2023-01-20", "2024-02-13")


def test_vote_is_one_aggregate(spark):
    df = spark.createDataFrame([("13/02/2024",)], "d string")
    plan = _plan(layout_votes(df))
    assert plan.count("Exchange") <= 2 and "Expand" not in plan
    assert "BroadcastNestedLoopJoin" in _plan(read_dates(df, ["d"]))  # one row
