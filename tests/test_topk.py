"""L2: exact top-k by a bound on bucket counts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeprobe.operators import distributions as D


def _top(long, top=20, **kw):
    df, more = D.top_values(long, "key", top, **kw)
    return [tuple(r) for r in df.orderBy("key", "rank").select("key", "value", "count", "total", "rank").collect()], more


def _want(rows, top=20):
    out = []
    for key in sorted({k for k, _ in rows}):
        counts = Counter(v for k, v in rows if k == key)
        best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top]
        out += [(key, v, n, sum(counts.values()), i + 1) for i, (v, n) in enumerate(best)]
    return out


def test_the_bound_decides_on_skewed_values(spark):
    """300,000 distinct values, of which 25 are frequent: the shuffle is one row per
    bucket and those values that share a full bucket, and no third pass is made."""
    rare = spark.range(300_000).select(F.lit("a").alias("key"), F.col("id").alias("value"))
    often = spark.range(25).select(F.lit("a").alias("key"), (F.col("id") * 7919).alias("value"), F.explode(F.sequence(F.lit(1), 500 + F.col("id") * 10)))
    long = rare.union(often.drop("col"))
    got, more = _top(long, buckets=4096)
    assert more == 0
    assert [(v, n) for _, v, n, _, _ in got] == [((24 - i) * 7919, 741 - 10 * i) for i in range(20)]


def test_values_of_one_frequency_are_all_counted(spark):
    long = spark.range(50_000).select(F.lit("a").alias("key"), (F.col("id") % 25_000).alias("value"))
    got, more = _top(long, buckets=256)
    assert more == 256 - 40   # the bound proves nothing: every other bucket is counted
    assert got == [("a", i, 2, 50_000, i + 1) for i in range(20)]


@pytest.mark.parametrize("buckets", [1, 3, 64, 1 << 16])
def test_against_counts(spark, buckets):
    rows = [("a", f"v{(i * i) % 97}") for i in range(3000)] + [("b", f"w{i % 30}") for i in range(900)] + [("c", "x"), ("c", "y"), ("c", "x")]
    long = spark.createDataFrame(rows, "key string, value string").repartition(4)
    got, _ = _top(long, buckets=buckets)
    assert got == _want(rows)


def test_a_tie_for_the_last_place_goes_by_value(spark):
    rows = [("a", i) for i in range(200) for _ in range(3)]
    long = spark.createDataFrame(rows, "key string, value int")
    assert _top(long, top=5, buckets=1000)[0] == _want(rows, 5)


def test_shares_of_floats_few_values_and_no_rows(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (None,), (2.5,)], "`my x` double")
    got = [(r["rank"], r["label"], r["count"], r["pct"]) for r in D.category_distribution(df, "my x").orderBy("rank").collect()]
    assert got == [(1, "0.0", 2, 66.7), (2, "2.5", 1, 33.3)]
    assert D.category_distribution(df.limit(0), "my x").collect() == []
    assert D.category_distribution(df.where("`my x` IS NULL"), "my x").collect() == []
