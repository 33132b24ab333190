from lakeprobe.operators.scoring import features, targets


def _catalog(spark, cols):
    rows = [("d", i, n, k, cat, cov, u, u <= 1) for i, (n, k, cat, cov, u) in enumerate(cols)]
    return spark.createDataFrame(rows, "dataset string, ordinal int, column string, kind string, "
                                       "category string, coverage_pct double, unique_values bigint, constant boolean")


def test_targets_merge_and_order(spark):
    cat = _catalog(spark, [
        ("claim_flag", "numeric", "Claims", 100.0, 2), ("claim_amount", "numeric", "Claims", 100.0, 50),
        ("claim_count", "numeric", "Claims", 100.0, 3), ("exposure", "numeric", "Exposure", 100.0, 9),
        ("lapse_ind", "string", "Exposure", 100.0, 2), ("target", "numeric", "Potential Targets", 100.0, 2),
        ("Target", "numeric", "Potential Targets", 100.0, 2)])
    rows = targets(cat).orderBy("target_rank").collect()
    assert [(r["name"], r["confidence"]) for r in rows] == [
        ("Claim Severity", 95), ("Claim Frequency (Binary)", 92), ("Expected Loss", 78),
        ("target", 75), ("Retention / Lapse", 72)]
    assert rows[0]["formula"] == "claim_amount / claim_count"
    assert rows[2]["source_columns"] == "claim_amount,claim_count,exposure"


def test_feature_classes(spark):
    cat = _catalog(spark, [
        ("policy_id", "numeric", "Identifiers", 100.0, 10), ("future_x", "numeric", "Potential Leakage", 100.0, 10),
        ("label", "numeric", "Potential Targets", 100.0, 2), ("thin", "numeric", "Other", 10.0, 5),
        ("const", "string", "Other", 100.0, 1), ("paid_amount", "numeric", "Claims", 100.0, 9),
        ("loss_ratio", "numeric", "Claims", 100.0, 9), ("profit", "numeric", "Other", 100.0, 9),
        ("region", "string", "Geography", 90.0, 9), ("misc", "numeric", "Other", 100.0, 9)])
    got = {r["name"]: (r["classification"], r["confidence"]) for r in features(cat).collect()}
    assert "label" not in got
    assert got["policy_id"] == ("Low Value", 95) and got["future_x"] == ("Potential Leakage", 85)
    assert got["thin"] == ("Low Value", 90) and got["const"] == ("Low Value", 98)
    assert got["paid_amount"] == ("Potential Leakage", 75) and got["loss_ratio"] == ("Potential Leakage", 75)
    assert got["profit"] == ("Suspicious", 70) and got["region"] == ("High Value", 90)
    assert got["misc"] == ("Modelling Feature", 55)
