"""Bench: headline profiling jobs on the test tables; prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lakeprobe.operators import checks as Q  # noqa: E402
from lakeprobe.operators import distributions as D  # noqa: E402
from lakeprobe.operators.profile import profile  # noqa: E402
from lakeprobe.plans.catalog import ProfileCatalog  # noqa: E402
from lakeprobe.plans.fixtures import TABLES, dataset  # noqa: E402
from lakeprobe.plans.report import assess, report, union_all  # noqa: E402
from lakeprobe.session import ensure_checkpoint_dir, get_session  # noqa: E402

AS_OF = "2024-01-10"


def collect_all(dfs):
    return sum(len(d.collect()) for d in dfs)


def catalog_lake(spark, sf):
    """All tables into a new catalog, once more without changes, and their profiles."""
    catalog = ProfileCatalog(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex}")
    paths = {t: f"{sf.rstrip('/')}/{t}.parquet" for t in TABLES}
    catalog.refresh_all(paths, AS_OF)
    catalog.refresh_all(paths, AS_OF)
    return catalog.profile(distinct="sketch").collect()


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    # each test table is one row group, so one task; deal it to all cores, as a user would
    ds = lambda n: dataset(spark, sf, n).repartition(int(cpus))

    jobs = {
        "profile_lineitem": lambda: profile(ds("lineitem"), "lineitem", as_of=AS_OF).collect(),
        "profile_lake": lambda: union_all([profile(ds(t), t, as_of=AS_OF) for t in TABLES]).collect(),
        "checks_lineitem": lambda: Q.run_checks(ds("lineitem"), profile(ds("lineitem"), "lineitem", as_of=AS_OF),
                                                "lineitem").collect(),
        "claims_policy": lambda: collect_all([
            D.claims_summary(ds("policy_fx"), "policy_fx"), D.claims_percentiles(ds("policy_fx"), "policy_fx"),
            D.claims_histogram(ds("policy_fx"), "policy_fx")]),
        "shares_lineitem": lambda: collect_all([
            D.category_distribution(ds("lineitem"), c, "lineitem") for c in ("l_quantity", "l_returnflag", "l_partkey")]),
        "report_dirty": lambda: collect_all(report(ds("dirty_fx"), "dirty_fx", as_of=AS_OF).values()),
        "rules_fixtures": lambda: collect_all(
            assess({n: ds(n) for n in ("policy_fx", "dirty_fx", "labelled_fx")}, as_of=AS_OF).values()),
        "catalog_lake": lambda: catalog_lake(spark, sf),
    }
    # warm-up: JVM, codegen caches, file listing
    profile(ds("region"), "region").collect()
    times = {}
    for name, job in jobs.items():
        t = time.time()
        job()
        times[name] = round(time.time() - t, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    sf_val = sf.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_val, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
