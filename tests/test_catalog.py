"""The stored catalog: refreshes, merges, sketches."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from lakeprobe.operators import checks as Q
from lakeprobe.operators import distributions as D
from lakeprobe.operators.profile import profile
from lakeprobe.plans.catalog import ProfileCatalog, Refresh
from lakeprobe.plans.report import assess
from lakeprobe.sources.readers import table

from .conftest import SF
from .test_plans import _plan

AS_OF = "2024-01-10"
ROWS = [(1, "13/02/2024", 1.5, None), (2, "01/02/2024", float("nan"), "x"), (None, None, -2.0, "x"), (2, "2023-05-06", 0.0, "1.5")]
SCHEMA = "k int, `sent date` string, v double, s string"


@pytest.fixture
def catalog(spark, tmp_path):
    return ProfileCatalog(spark, str(tmp_path / "catalog"))


def _append(spark, path, rows, schema=SCHEMA, files=1):
    spark.createDataFrame(rows, schema).coalesce(files).write.mode("append").parquet(path)


def _files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def _same(catalog, spark, path, name="t", as_of=AS_OF):
    got = catalog.profile([name]).collect()
    want = profile(spark.read.parquet(path), name, distinct=None, as_of=as_of).collect()
    assert sorted(got) == sorted(want)


def test_only_new_files_are_read(spark, catalog, tmp_path):
    path = str(tmp_path / "a+b %20 c")   # URIs would change the name
    _append(spark, path, ROWS)
    assert catalog.refresh("t", path, AS_OF) == Refresh(1, 1, 0)
    _same(catalog, spark, path)
    # from here on the old file cannot be read: same size and time, other bytes
    old = _files(path)[0]
    content, stat = open(old, "rb").read(), os.stat(old)
    with open(old, "wb") as f:
        f.write(b"x" * len(content))
    os.utime(old, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    _append(spark, path + "2", [(7, "14/02/2024", 3.0, "y")] * 5)
    # sorts first, so that Spark takes the schema from it
    shutil.copy(_files(path + "2")[0], os.path.join(path, "a [new] {1}*.parquet"))
    assert catalog.refresh("t", path, AS_OF) == Refresh(2, 1, 0)
    assert catalog.refresh("t", path, AS_OF) == Refresh(2, 0, 0)
    with open(old, "wb") as f:
        f.write(content)
    os.utime(old, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    _same(catalog, spark, path)


def test_changed_and_removed_files(spark, catalog, tmp_path):
    path = str(tmp_path / "t")
    for i in range(3):
        _append(spark, path, [(i, "2024-01-0%d" % (i + 1), float(i), "z")] * (i + 1))
    assert catalog.refresh("t", path, AS_OF) == Refresh(3, 3, 0)
    gone, changed = _files(path)[:2]
    os.remove(gone)
    _append(spark, path + "2", ROWS)
    shutil.copy(_files(path + "2")[0], changed)
    hidden = os.path.join(path, f".{os.path.basename(changed)}.crc")
    os.remove(hidden)
    assert catalog.refresh("t", path, AS_OF) == Refresh(2, 1, 1)
    _same(catalog, spark, path)


def test_a_moved_clock_counts_future_dates_anew(spark, catalog, tmp_path):
    path = str(tmp_path / "t")
    _append(spark, path, [(1, "2024-01-05", 1.0, "a"), (2, "2024-02-01", 1.0, "a")])
    _append(spark, path, [(3, "2023-12-31", 1.0, "a")])
    future = lambda: {r["column"]: r["future_dates"] for r in catalog.profile(["t"]).collect()}["sent date"]
    assert catalog.refresh("t", path, "2024-01-01").read == 2 and future() == 2
    # only the file with later dates is read again
    assert catalog.refresh("t", path, "2024-01-10").read == 1 and future() == 1
    # nothing lies after this clock: nothing is read, nothing is future
    assert catalog.refresh("t", path, "2024-03-01").read == 0 and future() == 0
    _same(catalog, spark, path, as_of="2024-03-01")
    # the counts by this clock are still there
    assert catalog.refresh("t", path, "2024-01-10").read == 0 and future() == 1
    assert catalog.refresh("t", path, "2023-06-01").read == 2 and future() == 3


def test_other_schema_reads_all(spark, catalog, tmp_path):
    path = str(tmp_path / "t")
    _append(spark, path, ROWS)
    catalog.refresh("t", path, AS_OF)
    shutil.rmtree(path)
    _append(spark, path, [(1, 2)], "k long, z int")
    assert catalog.refresh("t", path, AS_OF) == Refresh(1, 1, 1)
    _same(catalog, spark, path)


def test_partitioned_folders_many_datasets_and_empty_tables(spark, catalog, tmp_path):
    df = spark.createDataFrame([(i, f"v{i % 3}", i % 2) for i in range(20)], "a int, b string, p int")
    hive, none = str(tmp_path / "hive"), str(tmp_path / "none")
    df.write.partitionBy("p").parquet(hive)
    df.limit(0).write.parquet(none)
    got = catalog.refresh_all({"2024": hive, "no/rows=0": none}, AS_OF)
    assert got["2024"].files == got["2024"].read >= 2
    assert [r["dataset"] for r in catalog.datasets().orderBy("dataset").collect()] == ["2024", "no/rows=0"]
    both = profile(spark.read.parquet(hive), "2024", distinct=None, as_of=AS_OF).unionByName(
        profile(spark.read.parquet(none), "no/rows=0", distinct=None, as_of=AS_OF))
    assert sorted(catalog.profile().collect()) == sorted(both.collect())
    sketched = {(r["dataset"], r["column"]): r["unique_values"] for r in catalog.profile(distinct="sketch").collect()}
    assert sketched[("2024", "a")] == 20 and sketched[("2024", "b")] == 3 and sketched[("no/rows=0", "a")] == 0
    assert catalog.profile(["not there"]).collect() == []


def test_a_refresh_that_dies_leaves_nothing(spark, catalog, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    _append(spark, path, ROWS)
    catalog.refresh("t", path, AS_OF)
    before = sorted(catalog.profile(["t"]).collect())
    _append(spark, path, ROWS * 3)
    real = ProfileCatalog._write

    def dies(self, df, name, *rest):
        if name == "commits":
            raise RuntimeError("lost")
        real(self, df, name, *rest)
    monkeypatch.setattr(ProfileCatalog, "_write", dies)
    with pytest.raises(RuntimeError, match="lost"):
        catalog.refresh("t", path, AS_OF)
    assert sorted(catalog.profile(["t"]).collect()) == before
    monkeypatch.setattr(ProfileCatalog, "_write", real)
    assert catalog.refresh("t", path, AS_OF).read == 1
    _same(catalog, spark, path)
    assert catalog.vacuum() == 4   # the dead refresh's files and parts, the first one's files and commit
    _same(catalog, spark, path)
    assert catalog.vacuum() == 0


def test_profile_scans_no_data(spark, catalog, tmp_path):
    path = str(tmp_path / "t")
    _append(spark, path, ROWS)
    catalog.refresh("t", path, AS_OF)
    plan = _plan(catalog.profile())
    assert path not in plan
    assert "quantile_sketch" not in plan.split("ReadSchema")[-1] and "distinct_sketch" not in plan
    assert "dynamicpruning" in plan or "PartitionFilters" in plan


def test_distinct_sketches_merge_over_tables(spark, catalog, tmp_path):
    frames = {"a": spark.range(0, 60_000).selectExpr("CAST(id AS INT) AS x", "CAST(id AS FLOAT) AS y"),
              "b": spark.range(30_000, 90_000).selectExpr("id AS x", "CAST(id AS DOUBLE) AS y"),
              "c": spark.range(5).selectExpr("CAST(NULL AS BIGINT) AS x", "CAST('NaN' AS DOUBLE) AS y")}
    for name, df in frames.items():
        df.repartition(3).write.parquet(str(tmp_path / name))
    catalog.refresh_all({n: str(tmp_path / n) for n in frames}, AS_OF)
    groups = {f"{c}{n}": [(d, c) for d in n] for c in "xy" for n in ("a", "ab", "abc", "c")}
    got = {r["name"]: r["estimate"] for r in catalog.distinct(groups).collect()}
    for g, n in {"a": 60_000, "ab": 90_000, "abc": 90_000, "c": 0}.items():
        for c in "xy":
            assert abs(got[c + g] - n) <= 0.05 * n, (c, g)   # three standard errors of 2^12 registers


def _long(spark, values):
    return spark.createDataFrame([("a", float(v)) for v in values], "column string, v double").repartition(5)


def test_rank_error_of_merged_sketches(spark):
    rng, k = random.Random(3), 128
    for shape in (lambda: rng.gauss(0, 1), lambda: rng.randrange(20), lambda: rng.random() ** 9):
        values = sorted(shape() for _ in range(20_000))
        df = _long(spark, values).withColumn("part", F.pmod(F.hash("v", F.rand(1)), F.lit(7)))
        parts = df.groupBy("column", "part").agg(F.kll_sketch_agg_double("v", F.lit(k)).alias("s"))
        one = parts.groupBy("column").agg(F.kll_merge_agg_double("s").alias("sketch"))
        ps = [0.01, 0.25, 0.5, 0.9, 0.99]
        got = one.select(F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, ps)))).first()[0]
        for p, x in zip(ps, got):
            below, upto = sum(v < x for v in values) / len(values), sum(v <= x for v in values) / len(values)
            assert below - 3 * D.rank_error(k) <= p <= upto + 3 * D.rank_error(k)


@pytest.mark.parametrize("n", [1, 2, 5, 40, 3000, 50_000])
def test_exact_quantiles_from_sketches(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.gauss(0, 100), rng.randrange(9)]) for _ in range(n)]
    long = _long(spark, values)
    sketches = long.groupBy("column").agg(F.kll_sketch_agg_double("v", F.lit(64)).alias("sketch"))
    ps = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = D.quantiles(long, ["column"], ps, few_groups=True, sketches=sketches, sketch_k=64)
    want = long.agg(F.percentile("v", F.array(*map(F.lit, ps)))).first()[0]
    assert [r["value"] for r in got.orderBy("q_no").collect()] == pytest.approx(want, rel=1e-12)


def test_other_values_than_the_sketches_raise(spark):
    long = _long(spark, range(500))
    sketches = _long(spark, range(400)).groupBy("column").agg(F.kll_sketch_agg_double("v").alias("sketch"))
    with pytest.raises(Exception, match="not those of the sketches|outside its bracket"):
        D.quantiles(long, ["column"], [0.5], sketches=sketches, sketch_k=200).collect()


def test_one_read_less_with_sketches(spark, catalog):
    catalog.refresh("lineitem", f"{SF}/lineitem.parquet", AS_OF)
    df = table(spark, SF, "lineitem")
    kll = catalog.quantile_sketches().drop("dataset")
    want = sorted(Q.outlier_counts(df, "lineitem").collect())
    calls = []
    real = D.F.percentile_approx
    D.F.percentile_approx = lambda *a: calls.append(a) or real(*a)
    try:
        got = sorted(Q.outlier_counts(df, "lineitem", sketches=kll).collect())
    finally:
        D.F.percentile_approx = real
    assert got == want and not calls


def test_assess_from_the_catalog(spark, catalog, tmp_path):
    names = ["orders", "events"]
    catalog.refresh_all({n: f"{SF}/{n}.parquet" for n in names}, AS_OF)
    tables = {n: table(spark, SF, n) for n in names}
    stored, scanned = assess(tables, catalog=catalog), assess(tables, as_of=AS_OF)
    for key in ("check_status", "targets", "features", "readiness", "findings", "roadmap", "outliers"):
        assert sorted(stored[key].collect(), key=repr) == sorted(scanned[key].collect(), key=repr), key
