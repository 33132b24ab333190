import pytest

from lakeprobe.operators import checks as Q
from lakeprobe.operators import meta as M
from lakeprobe.operators.profile import profile
from lakeprobe.plans.fixtures import dataset

from .conftest import SF


@pytest.fixture(scope="module")
def dirty(spark):
    df = dataset(spark, SF, "dirty_fx")
    prof = profile(df, "dirty_fx", as_of="2024-01-10").cache()
    status = {r["check_no"]: r for r in Q.run_checks(df, prof, "dirty_fx").collect()}
    return df, prof, status


def test_planted_problems(dirty):
    _, _, st = dirty
    assert st[2]["flagged"] == 200 and st[2]["status"] == "warn"
    assert st[3]["detail"] == "paid_amount_copy=claim_amount"
    assert st[4]["detail"] == "const_txt"
    assert st[5]["detail"] == "sparse_score"
    assert st[6]["value"] == 600
    assert st[8]["detail"] == "policy_no"
    assert st[9]["detail"] == "mixed_txt" and st[10]["detail"] == "mixed_txt"
    assert st[11]["value"] == 1852
    assert [st[i]["check"] for i in range(1, 13)] == list(Q.CHECK_NAMES)


def test_outlier_detail(dirty, spark):
    df, _, _ = dirty
    r = Q.outlier_counts(df, "dirty_fx").where("column = 'claim_amount'").first()
    assert r["q1"] == pytest.approx(14.56) and r["q3"] == pytest.approx(69.1125) and r["outliers"] == 86


def test_empty_table_statuses(spark):
    df = spark.createDataFrame([], "a double, b string")
    st = {r["check_no"]: r["status"] for r in Q.run_checks(df, profile(df, "e"), "e").collect()}
    assert st == {i: "pass" if i == 2 else "fail" for i in range(1, 13)}
    rows = Q.run_checks(df, profile(df, "e"), "e").where("check_no <> 2").collect()
    assert all(r["value"] is None and r["flagged"] == 0 for r in rows)


def test_late_columns_are_checked(spark):
    wide = spark.range(50).selectExpr(*[f"IF(id = 7 AND {i} = 24, 1e9, id + 0.5) AS n{i}" for i in range(30)])
    assert Q.check_outliers(wide, "w").first()["detail"] == "n24"
    days = spark.range(9).selectExpr(*[f"timestamp_ntz'{2999 if i == 6 else 2020}-01-01' AS date{i}" for i in range(7)])
    r = Q.check_date_integrity(profile(days, "d", distinct=None, as_of="2024-01-10")).first()
    assert (r["status"], r["detail"]) == ("warn", "date6")


def test_any_column_names(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 1, 'x'), (2, 2, 'x') AS t(a, b, c)").toDF("a`b", "Amount", "amount")
    prof = profile(df, "t", as_of="2024-01-10")
    assert {(r["column"], r["unique_values"]) for r in prof.collect()} == {("a`b", 2), ("Amount", 2), ("amount", 1)}
    st = {r["check_no"]: r for r in Q.run_checks(df, prof, "t").collect()}
    assert st[3]["detail"] == "Amount=a`b" and st[4]["detail"] == "amount"


def test_equal_maps_in_another_order(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1)")
    assert Q.check_dup_rows(df, "t").first()["flagged"] == 1


def test_detail_rows(dirty, spark):
    df, prof, _ = dirty
    got = {(r["check_no"], r["column"], r["metric"]): r["value"] for r in Q.check_detail(df, prof, "dirty_fx").collect()}
    assert got[3, "paid_amount_copy", "equal_to_place"] == 4
    assert got[6, "renewal_date", "bad_dates"] + got[6, "event_date", "future_dates"] > 0
    assert got[7, "claim_amount", "outliers"] == 86 and got[11, "net_premium", "negatives"] == 1852


def test_dup_rows_null_and_nan(spark):
    df = spark.createDataFrame([(None, float("nan")), (None, float("nan")), (1.0, None), (None, 1.0)], "a double, b double")
    assert Q.check_dup_rows(df, "t").first()["flagged"] == 1


def test_dup_cols_text_forms(spark):
    df = spark.createDataFrame([(1, "1", 1, 2), (2, "2", 2, 1), (None, None, None, 3)], "a int, b string, c int, d int")
    assert sorted(Q.dup_column_pairs(df)) == [("b", "a"), ("c", "a")]
    perm = spark.createDataFrame([(1, 2), (2, 1)], "x int, y int")
    assert Q.dup_column_pairs(perm) == []


def test_meta_on_fixture(spark):
    df = dataset(spark, SF, "policy_fx")
    u = M.unique_entities(df, "policy_fx").first()
    assert (u["unique_policies"], u["unique_customers"]) == (14743, 100)
    c = M.claim_rate(df, "policy_fx").first()
    assert c["claiming_entities"] == 19040
    d = M.date_range(dataset(spark, SF, "dirty_fx"), "dirty_fx").first()
    assert d["date_range"] == "2024-01-01 → 2024-01-30"


def test_meta_in_one_row(spark):
    df = dataset(spark, SF, "policy_fx")
    r = M.meta(df, "policy_fx", "PARQUET").first()
    assert (r["rows"], r["columns"], r["file_type"], r["unique_policies"]) == (df.count(), 12, "PARQUET", 14743)
    assert r["bytes"] > 0 and r["claiming_entities"] == M.claim_rate(df, "policy_fx").first()["claiming_entities"]
    assert r["date_range"] == M.date_range(df, "policy_fx").first()["date_range"]


def test_report_sink_roundtrip(spark):
    import os
    import tempfile

    from lakeprobe.plans.report import report
    from lakeprobe.sources.sinks import write_report
    from .conftest import SF_SMALL

    r = report(dataset(spark, SF_SMALL, "dirty_fx"), "dirty_fx", as_of="2024-01-10")
    out = tempfile.mkdtemp(prefix="lp-sink-", dir="/tmp")
    written = write_report(r, out)
    assert len(written) == len(r) and os.path.isdir(f"{out}/check_status")
    back = spark.read.json(f"{out}/check_status")
    assert back.count() == 12
