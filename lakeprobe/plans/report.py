"""Whole reports (S7): every step over one table, or over a lake of tables.

The data layer runs per table (one profile scan, plus the duplicate, outlier
and claims passes); the rule layer then runs once over the union of all
tables' small results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import checks as Q
from ..operators import distributions as D
from ..operators import meta as M
from ..operators import scorecard as S
from ..operators.profile import coverage_summary, profile
from ..operators.scoring import features, targets
from ..session import ensure_checkpoint_dir
from .catalog import ProfileCatalog


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def materialise(df: DataFrame) -> DataFrame:
    """Write a small result to the shared checkpoint folder and read it back,
    so later steps neither rescan the table nor lose it with an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _layers(tables: dict[str, DataFrame], as_of, method: str, distinct: str | None, persist: bool,
            catalog: ProfileCatalog | None) -> dict[str, DataFrame]:
    """The data layer of every table, each pass made once: profile, outliers,
    duplicate columns, statuses and claims. A ``catalog`` has the profiles and the
    sketches that exact quartiles start from."""
    keep = materialise if persist else (lambda d: d)
    profiles, statuses, claims, outliers, details, percentiles = [], [], [], [], [], []
    stored = keep(catalog.profile(list(tables), distinct="sketch")) if catalog else None
    sketches = keep(catalog.quantile_sketches(list(tables))) if catalog else None
    for name, df in tables.items():
        if catalog:
            prof, kll = stored.where(F.col("dataset") == name), sketches.where(F.col("dataset") == name).drop("dataset")
            counts = keep(Q.outlier_counts(df, name, method, sketches=kll, sketch_k=catalog.sketches.quantile_k))
        else:
            prof = keep(profile(df, name, distinct=distinct, as_of=as_of))
            counts = keep(Q.outlier_counts(df, name, method))
        pairs = Q.dup_column_pairs(df)
        profiles.append(prof)
        outliers.append(counts)
        statuses.append(Q.run_checks(df, prof, name, method, persist=False, counts=counts, pairs=pairs))
        details.append(Q.check_detail(df, prof, name, method, counts=counts, pairs=pairs))
        percentiles.append(keep(D.claims_percentiles(df, name, method)))
        claims.append(D.claims_summary(df, name, method, percentiles[-1]))
    return {"profile": union_all(profiles), "check_status": keep(union_all(statuses)), "claims": keep(union_all(claims)),
            "outliers": union_all(outliers), "check_detail": union_all(details),
            "claim_percentiles": union_all(percentiles)}


def assess(tables: dict[str, DataFrame], as_of=None, method: str = "exact",
           distinct: str | None = "text", persist: bool = True, catalog: ProfileCatalog | None = None) -> dict[str, DataFrame]:
    """Profile, checks and claims per table; targets, features, readiness,
    findings and roadmap over all of them. The rules read distinct counts of text
    columns only, so ``distinct`` is ``text`` by default.

    With a ``catalog`` that holds datasets of the same names and the same files, no
    table is scanned for its profile: that comes from the catalog, by its clock and
    with distinct counts from its sketches."""
    keep = materialise if persist else (lambda d: d)
    out = _layers(tables, as_of, method, distinct, persist, catalog)
    prof, status, cl = out["profile"], out["check_status"], out["claims"]
    # read by every rule below: schema-sized, stored once
    tg, ft = keep(targets(prof)), keep(features(prof))
    facts = keep(S.dataset_facts(prof, status, cl, tg, ft))
    steps = keep(S.roadmap(facts))
    return out | {
        "targets": tg, "features": ft, "readiness": S.readiness(facts), "findings": S.findings(facts, status),
        "roadmap": steps, "roadmap_summary": S.roadmap_summary(steps),
        "coverage": coverage_summary(prof),
    }


def report(df: DataFrame, dataset: str = "data", as_of=None, method: str = "exact",
           distinct: str | None = "exact", persist: bool = True, file_type: str | None = None) -> dict[str, DataFrame]:
    """The full report of one table as a dict of DataFrames."""
    out = assess({dataset: df}, as_of=as_of, method=method, distinct=distinct, persist=persist)
    prof = out["profile"]
    out.update({
        "meta": M.meta(df, dataset, file_type),
        "heatmaps": D.coverage_heatmaps(df, prof, dataset),
        "claim_histogram": D.claims_histogram(df, dataset),
        "date_checks": Q.date_detail(prof),
    })
    return out


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL before writing, in float columns and at any depth of
    nested ones."""
    def walk(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.FloatType, T.DoubleType)):
            return F.when(~F.isnan(c), c)
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: walk(x, t.elementType))
        if isinstance(t, T.MapType):
            return F.transform_values(c, lambda k, v: walk(v, t.valueType))
        if isinstance(t, T.StructType) and t.fields:
            return F.when(c.isNotNull(), F.struct(*[walk(c.getField(f.name), f.dataType).alias(f.name) for f in t.fields]))
        return c
    return df.select([walk(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType).alias(f.name) for f in df.schema.fields])


# The sections of a report document: (section, field or none, result table, order or none
# for a table of one row per dataset).
DOCUMENT = (
    ("meta", None, "meta", None),
    ("anatomy", None, "profile", ("ordinal",)),
    ("quality", "checks", "check_status", ("check_no",)),
    ("quality", "detail", "check_detail", ("check_no", "column", "metric")),
    ("quality", "outliers", "outliers", ("column",)),
    ("quality", "dates", "date_checks", ("ordinal",)),
    ("coverage", "summary", "coverage", None),
    ("coverage", "heatmaps", "heatmaps", ("category", "rank")),
    ("claims", "summary", "claims", None),
    ("claims", "percentiles", "claim_percentiles", ("q_no",)),
    ("claims", "histogram", "claim_histogram", ("bin",)),
    ("targets", None, "targets", ("target_rank",)),
    ("features", None, "features", ("feature_rank",)),
    ("readiness", None, "readiness", None),
    ("roadmap", "steps", "roadmap", ("step_no",)),
    ("roadmap", "summary", "roadmap_summary", None),
    ("findings", None, "findings", ("section_no", "item_no")),
)


def report_document(results: dict[str, DataFrame]) -> DataFrame:
    """One row per dataset, all result tables of ``report`` or ``assess`` nested:
    ``dataset`` and a column per section of ``DOCUMENT`` whose tables are there.

    Tables of many rows become arrays in their order, tables of one row structs (NULL
    without it). NaN is NULL at every depth. All of it is sized by the schema of the
    dataset, never by its rows; the datasets are those of the profile.
    """
    tables, sections = [], {}
    for section, field, name, order in DOCUMENT:
        if name not in results:
            continue
        df = nan_to_null(results[name])
        rest = [c for c in df.columns if c != "dataset"]
        column = f"_{len(tables)}"
        if order is None:
            got = df.select("dataset", F.struct(*rest).alias(column))
            value = F.col(column)
        else:
            # sorted by the order columns, then shown as the table is
            first = [F.col(c).alias(f"_{i}") for i, c in enumerate(order)]
            got = df.groupBy("dataset").agg(F.array_sort(
                F.collect_list(F.struct(*first, F.struct(*rest).alias("row"))), lambda a, b: _by(a, b, len(order))).alias(column))
            value = F.transform(F.coalesce(column, F.array().cast(got.schema[column].dataType)), lambda x: x["row"])
        tables.append(got)
        sections.setdefault(section, []).append((field, value))
    base = results["profile"].select("dataset").distinct()
    for got in tables:
        base = base.join(got, "dataset", "left")
    nested = lambda parts: parts[0][1] if parts[0][0] is None else F.struct(*[v.alias(f) for f, v in parts])
    return base.select("dataset", *[nested(parts).alias(section) for section, parts in sections.items()])


def _by(a: Column, b: Column, n: int) -> Column:
    """Comparison of two structs by their first ``n`` fields."""
    out = F.lit(0)
    for i in reversed(range(n)):
        x, y = a[f"_{i}"], b[f"_{i}"]
        out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
    return out
