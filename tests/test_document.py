"""S6 as one document per dataset; R13 with its columns."""

import json
import os

from pyspark.sql import functions as F

from lakeprobe.plans.fixtures import dataset
from lakeprobe.plans.report import assess, nan_to_null, report, report_document
from lakeprobe.sources.sinks import write_document

from .conftest import SF_SMALL


def _lines(path):
    return [json.loads(line) for f in sorted(os.listdir(path)) if f.endswith(".json") for line in open(f"{path}/{f}")]


def test_one_object_per_dataset(spark, tmp_path):
    results = report(dataset(spark, SF_SMALL, "policy_fx"), "policy_fx", as_of="2024-01-10")
    doc = write_document(results, str(tmp_path / "doc"))
    (obj,) = _lines(tmp_path / "doc")
    assert list(obj) == ["dataset", "meta", "anatomy", "quality", "coverage", "claims", "targets", "features", "readiness", "roadmap", "findings"]
    assert [c["ordinal"] for c in obj["anatomy"]] == list(range(12))
    assert [c["check_no"] for c in obj["quality"]["checks"]] == list(range(1, 13))
    assert [b["bin"] for b in obj["claims"]["histogram"]] == list(range(1, 21))
    assert obj["claims"]["summary"]["detected_fields"] and obj["meta"]["rows"] == results["profile"].first()["rows"]
    assert [s["step_no"] for s in obj["roadmap"]["steps"]] == list(range(1, obj["roadmap"]["summary"]["steps"] + 1))
    back = spark.read.schema(doc.schema).json(str(tmp_path / "doc"))
    for path, name in (("anatomy", "profile"), ("quality.checks", "check_status"), ("targets", "targets"), ("findings", "findings")):
        got = back.select("dataset", F.inline(path))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, results[name].select(*got.columns).collect()))


def test_many_datasets_and_missing_parts(spark, tmp_path):
    tables = {"a": spark.createDataFrame([(1, "x")], "k int, s string"), "b": spark.createDataFrame([], "claim_amount double"),
              "c": spark.createDataFrame([(float("nan"), 2.0)], "claim_amount double, v double")}
    write_document(assess(tables), str(tmp_path / "doc"))
    got = {o["dataset"]: o for o in _lines(tmp_path / "doc")}
    assert sorted(got) == ["a", "b", "c"]
    assert "meta" not in got["a"] and got["a"]["claims"]["summary"] is None and got["a"]["claims"]["percentiles"] == []
    assert got["b"]["claims"]["summary"]["avg_claim"] is None and got["b"]["anatomy"][0]["coverage"] is None
    assert got["a"]["targets"] == [] and got["a"]["quality"]["outliers"] == []


def test_nan_is_null_at_every_depth(spark, tmp_path):
    nan = float("nan")
    df = spark.createDataFrame([(nan, [nan, 1.0, None], (nan, [(nan,)]), {"k": nan}, "NaN")],
                               "a double, b array<float>, c struct<x:double,y:array<struct<z:double>>>, `d.e` map<string,double>, s string")
    r = nan_to_null(df)
    assert r.schema == df.schema or [f.dataType.simpleString() for f in r.schema] == [f.dataType.simpleString() for f in df.schema]
    row = r.first()
    assert row["a"] is None and row["b"] == [None, 1.0, None] and row["c"]["x"] is None and row["c"]["y"][0]["z"] is None
    assert row["d.e"] == {"k": None} and row["s"] == "NaN"
    none = spark.createDataFrame([(None, None)], "c struct<x:double>, b array<double>")
    assert tuple(nan_to_null(none).first()) == (None, None)


def test_findings_name_their_columns(spark):
    df = spark.createDataFrame([(i, None, None if i else 1.0, i % 3, "a", i) for i in range(20)],
                               "policy_id int, empty_one string, thin double, future_loss int, region string, target_y int")
    out = assess({"t": df})
    got = {r["title"].lstrip("0123456789 "): r["columns"] for r in out["findings"].collect()}
    assert got["Sparse Columns — Credibility Risk"] == ["empty_one", "thin"]
    assert got["Potential Leakage Features Detected"] == ["future_loss"]
    assert got["Geographic Segmentation Available"] == ["region"]
    status = {r["check"]: r["detail"] for r in out["check_status"].collect()}
    for title, columns in got.items():
        if title.startswith(("FAIL: ", "WARNING: ")):
            assert ",".join(columns) == status[title.split(": ")[1]]


def test_document_is_sized_by_the_schema(spark):
    results = report(dataset(spark, SF_SMALL, "dirty_fx"), "dirty_fx", as_of="2024-01-10", distinct=None)
    assert report_document({k: results[k] for k in ("profile", "check_status")}).columns == ["dataset", "anatomy", "quality"]


def test_the_reported_view_is_profiled_in_generated_code(spark, tmp_path):
    import re
    from lakeprobe.operators.profile import profile
    spark.createDataFrame([(i, f"u{i % 3}", float(i)) for i in range(100)], "event_id bigint, event_type string, value double").selectExpr(
        "*", "event_id AS user_id", "timestamp_ntz'2024-01-01' AS ts", "'{}' AS props").write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        prof = profile(dataset(spark, str(tmp_path), "dirty_fx"), "dirty_fx", distinct=None, as_of="2024-01-10")
        plan = prof._jdf.queryExecution().executedPlan().toString()
        rows = {r["column"]: r for r in prof.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
    partial = [line for line in plan.split("\n") if "functions=[partial_" in line]
    assert partial and all(re.search(r"\*\(\d+\) HashAggregate", line) for line in partial)
    assert len(rows) == 12 and {r["rows"] for r in rows.values()} == {102}
    assert rows["renewal_date"]["date_parsed"] == 96 and rows["sparse_score"]["non_null"] == 26
