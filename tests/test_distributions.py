import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeprobe.operators import distributions as D


def _q(spark, values, probs, method="exact"):
    df = spark.createDataFrame([(float(v),) for v in values], "v double").withColumn("column", F.lit("c"))
    rows = D.quantiles(df, ["column"], probs, method).orderBy("q_no").collect()
    return [r["value"] for r in rows]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 1000])
def test_exact_quantiles_match_numpy(spark, n):
    rnd = random.Random(n)
    vals = [rnd.lognormvariate(3, 1) for _ in range(n)]
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    got = _q(spark, vals, probs)
    want = np.quantile(np.array(vals), probs)
    assert np.allclose(got, want, rtol=1e-12, atol=1e-9)


def test_exact_quantiles_hot_value(spark):
    # one value holds a third of all rows
    rnd = random.Random(7)
    vals = [42.0] * 3000 + [rnd.uniform(0, 100) for _ in range(6000)]
    probs = [0.1, 0.25, 0.5, 0.75, 0.95]
    assert np.allclose(_q(spark, vals, probs), np.quantile(np.array(vals), probs))


def _claims_df(spark, amounts):
    return spark.createDataFrame([(float(a) if a is not None else None,) for a in amounts], "claim_amount double")


def test_skewness_rules(spark):
    three = D.claims_amount_stats(_claims_df(spark, [1, 2, 9]), "t").first()
    assert three["skewness"] is None and three["n"] == 3
    const = D.claims_amount_stats(_claims_df(spark, [5, 5, 5, 5, 5]), "t").first()
    assert const["skewness"] == 0.0
    vals = [1, 2, 3, 4, 10, 50]
    s = D.claims_amount_stats(_claims_df(spark, vals + [None, 0, -3]), "t").first()
    x = np.array(vals, dtype=float)
    n = len(x)
    m2, m3 = ((x - x.mean()) ** 2).mean(), ((x - x.mean()) ** 3).mean()
    adj = m3 / m2 ** 1.5 * np.sqrt(n * (n - 1)) / (n - 2)
    assert s["skewness"] == pytest.approx(adj, rel=1e-10)
    assert s["median_claim"] == pytest.approx(np.median(x))


def test_histogram_rules(spark):
    assert D.claims_histogram(_claims_df(spark, range(1, 11)), "t").count() == 0
    same = D.claims_histogram(_claims_df(spark, [7] * 11), "t").orderBy("bin").collect()
    assert len(same) == 20 and same[0]["lo"] == 6.5 and same[-1]["hi"] == 7.5
    assert sum(r["count"] for r in same) == 11
    vals = list(np.random.default_rng(3).gamma(2.0, 100.0, 5000))
    got = [r["count"] for r in D.claims_histogram(_claims_df(spark, vals), "t").orderBy("bin").collect()]
    want, _ = np.histogram(np.array(vals), bins=20)
    assert got == list(want)


def test_category_share_label_cut_and_ties(spark):
    rows = [("a" * 25 + "1",)] * 3 + [("a" * 25 + "2",)] * 3 + [("b",)] * 3 + [("c",)] * 1 + [(None,)] * 10
    df = spark.createDataFrame(rows, "s string")
    out = D.category_distribution(df, "s", "t").orderBy("rank").collect()
    assert [r["label"] for r in out] == ["a" * 20, "a" * 20, "b", "c"]
    assert [r["pct"] for r in out] == [30.0, 30.0, 30.0, 10.0]


def test_no_positive_amount_gives_nulls(spark):
    df = spark.createDataFrame([(0.0, 1), (-2.0, 2)], "claim_amount double, policy_id int")
    rows = D.claims_amount_stats(df, "t").collect()
    assert [tuple(r) for r in rows] == [("t", 0, None, None, None, None, None)]
