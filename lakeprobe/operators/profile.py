"""Column profile: the one shared scan (C1-C3, C5, C6, Q6 metrics).

``profile(df, dataset)`` runs one aggregate of fixed-width counts over the table,
without a shuffle of values, and returns one row per column. Distinct counts are
taken apart from it, one pruned column at a time, and only where they are read.

The aggregate's rows (``partials``) merge: sums, least and largest values and
sketches of parts of a table give those of the whole (``merged``). A stored catalog
keeps them per file (``plans/catalog.py``).

Dates in text are read by one layout a column, the one that reads most of its values
(ties: in the order of ``LAYOUTS``), so an ambiguous day and month is decided for the
whole column. Values that only other layouts read are bad dates.
"""

from __future__ import annotations

import datetime as _dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.nulls import clean
from ..functions.parse import LAYOUTS, parse_layouts, parse_number
from .rules import category_expr
from .schema import ColumnInfo, by_position, columns_of

# Profile rows, in order.
PROFILE_COLUMNS = (
    "dataset", "ordinal", "column", "spark_type", "kind", "dtype", "category",
    "rows", "non_null", "coverage", "coverage_pct", "unique_values",
    "date_parsed", "num_parsed", "negatives", "bad_dates", "future_dates", "constant",
    "date_layout", "layout_conflicts",
)

_YEAR = "year"


def as_of_lit(as_of) -> Column:
    """Clock for future-date tests; pass a value so results repeat."""
    if as_of is None:
        return F.current_timestamp().cast("timestamp_ntz")
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        return F.lit(as_of).cast("timestamp_ntz")
    if isinstance(as_of, _dt.datetime):
        return F.lit(as_of.replace(tzinfo=None)).cast("timestamp_ntz")
    return F.lit(as_of).cast("timestamp_ntz")


def _as_date(ci: ColumnInfo, c: Column) -> tuple[Column | None, Column | None]:
    """(timestamp, bad-value flag) of columns that are dates by type, or Nones.
    Integer ``year`` columns in 1900..2100 become 1 January; other numbers are not
    dates."""
    if ci.kind == "temporal":
        return c.cast("timestamp_ntz"), F.lit(False)
    if ci.is_integer and re.search(_YEAR, ci.name, re.I):
        ok = c.between(1900, 2100)
        p = F.when(ok, F.make_timestamp_ntz(c.cast("int"), F.lit(1), F.lit(1),
                                            F.lit(0), F.lit(0), F.lit(0)))
        return p, c.isNotNull() & ~ok
    return None, None


_LAYOUT = "array<struct<n:bigint,future:bigint,last:timestamp_ntz>>"


def column_metrics(ci: ColumnInfo, as_of: Column, sketches: Sketches | None = None) -> Column:
    """Aggregates of one column of ``by_position(df)``; of text, its values read by all
    layouts must be there as ``d<ordinal>``."""
    c = F.col(ci.ref)
    x = clean(c, ci.dtype)
    none = F.lit(None).cast("bigint")
    parsed, bad = _as_date(ci, c)
    text = ci.kind == "string"
    low = high = none
    if ci.kind != "nested":  # at most one value: one hash
        h = F.when(x.isNotNull(), F.xxhash64(x))
        low, high = F.min(h), F.max(h)
    counts = {
        "non_null": F.count(x),
        "num_parsed": F.count(parse_number(c)) if text else none,
        "negatives": F.count_if(x < 0) if ci.kind == "numeric" else none,
        "bad": F.lit(0) if parsed is None else F.count_if(bad),
        "future": F.lit(0) if parsed is None else F.count_if(parsed > as_of),
    }
    layouts, any_date = F.lit(None).cast(_LAYOUT), none
    if text:
        each = [F.get(F.col(f"d{ci.ordinal}"), F.lit(i)) for i in range(len(LAYOUTS))]
        layouts = F.array(*[F.struct(F.count(d).alias("n"), F.count_if(d > as_of).alias("future"), F.max(d).alias("last")) for d in each])
        any_date = F.count(F.coalesce(*each))
    last = F.lit(None).cast("timestamp_ntz") if parsed is None else F.max(parsed)
    distinct, quantile = (F.lit(None).cast("binary"),) * 2
    if sketches and ci.kind != "nested":
        # equal values of any width have equal hashes
        wide = {"numeric": "bigint" if ci.is_integer else "double" if ci.is_float else None, "temporal": "timestamp_ntz"}.get(ci.kind)
        value = x.cast(wide) if wide else x
        value = F.when(value == 0, F.lit(0.0)).otherwise(value) if ci.is_float else value
        distinct = F.hll_sketch_agg(F.when(x.isNotNull(), F.xxhash64(value)), F.lit(sketches.lg_k))
        if ci.kind == "numeric":
            quantile = F.kll_sketch_agg_double(x.cast("double"), F.lit(sketches.quantile_k))
    return F.struct(
        F.lit(ci.ordinal).alias("ordinal"), F.lit(ci.name).alias("column"),
        F.lit(ci.dtype.simpleString()).alias("spark_type"), F.lit(ci.kind).alias("kind"),
        F.lit(ci.label).alias("type_label"),
        *[v.cast("bigint").alias(k) for k, v in counts.items()], last.alias("last"),
        any_date.alias("any_date"), layouts.cast(_LAYOUT).alias("layouts"),
        low.alias("low"), high.alias("high"), distinct.alias("distinct_sketch"), quantile.alias("quantile_sketch"))


def partial_schema() -> str:
    """Schema of ``partials`` of a whole table."""
    return ("rows bigint, ordinal int, column string, spark_type string, kind string, type_label string, non_null bigint, "
            "num_parsed bigint, negatives bigint, bad bigint, future bigint, last timestamp_ntz, any_date bigint, "
            f"layouts {_LAYOUT}, low bigint, high bigint, distinct_sketch binary, quantile_sketch binary")


@dataclass(frozen=True)
class Sketches:
    """What a catalog's sketches keep: ``2 ** lg_k`` registers for distinct values
    (standard error about 1.04 / sqrt of that), and KLL's ``k`` for quantiles."""
    lg_k: int = 12
    quantile_k: int = 1024


# Spark generates code for an aggregate of at most 100 fields (``spark.sql.codegen.maxFields``),
# and the JVM compiles a method of at most 8,000 bytes; this many aggregates keep to both.
MOST_AGGREGATES = 90


def _aggregates(ci: ColumnInfo) -> int:
    """Aggregates that ``column_metrics`` takes of a column."""
    if ci.kind == "string":
        return 5 + 3 * len(LAYOUTS)
    if ci.kind == "nested":
        return 1
    dates = 3 if _as_date(ci, F.col(ci.ref))[0] is not None else 0
    return 3 + (ci.kind == "numeric") + dates


def partials(df: DataFrame, as_of=None, by: Column | None = None, sketches: Sketches | None = None,
             batch: int = 200) -> DataFrame:
    """One row per column of what merges over parts of a table, or, with ``by`` (a
    column of ``df``, such as the file's path), one per column and its value ``part``.

    ``batch`` columns go into one aggregate (a text column counts as five), and without
    sketches at most ``MOST_AGGREGATES``; a wider table is scanned once per batch, for
    its columns alone, so generated code stays small enough to be compiled.
    """
    cols, clock = columns_of(df), as_of_lit(as_of)
    part = [] if by is None else [by.alias("part")]
    named = df.select(*part, *[F.col("`" + f.name.replace("`", "``") + "`").alias(ci.ref)
                               for f, ci in zip(df.schema.fields, cols)]) if part else by_position(df)
    batches, size, taken = [[]], 0, 0
    for ci in cols:
        wide, takes = 5 if ci.kind == "string" else 1, 0 if sketches else _aggregates(ci)
        if batches[-1] and (size + wide > batch or taken + takes > MOST_AGGREGATES):
            batches.append([])
            size = taken = 0
        batches[-1].append(ci)
        size, taken = size + wide, taken + takes
    out = None
    for some in batches:
        # each text is read by all layouts once, before the aggregates use it
        text = [ci for ci in some if ci.kind == "string"]
        columns = [*(["part"] if part else []), *[ci.ref for ci in some]]
        p = named.select(*columns, *[F.trim(F.col(ci.ref).cast("string")).alias(f"s{ci.ordinal}") for ci in text])
        p = p.select(*columns, *[parse_layouts(F.col(f"s{ci.ordinal}"), trimmed=True).alias(f"d{ci.ordinal}") for ci in text])
        structs = [column_metrics(ci, clock, sketches) for ci in some]
        keys = ["part"] if part else []
        got = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.array(*structs).alias("m")).select(*keys, "rows", F.inline("m"))
        out = got if out is None else out.unionByName(got)
    return out


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``partials`` of parts of tables, merged to one row per ``keys`` and column."""
    names = ["ordinal", "column", "spark_type", "kind", "type_label"]
    layout = lambda i, f: F.get(F.col("layouts"), F.lit(i)).getField(f)
    layouts = F.array(*[F.struct(F.sum(layout(i, "n")).alias("n"), F.sum(layout(i, "future")).alias("future"),
                                 F.max(layout(i, "last")).alias("last")) for i in range(len(LAYOUTS))])
    return parts.groupBy(*keys, *names).agg(
        *[F.sum(c).alias(c) for c in ("rows", "non_null", "num_parsed", "negatives", "bad", "future", "any_date")],
        F.max("last").alias("last"), layouts.cast(_LAYOUT).alias("layouts"), F.min("low").alias("low"), F.max("high").alias("high"))


def distinct_counts(df: DataFrame, cols: list[ColumnInfo] | None = None, method: str = "exact") -> DataFrame:
    """``(ordinal, unique_values)`` of the non-null values of each column.

    Each column is a pruned scan of its own, grouped by the value, or by two
    64-bit hashes of it for text, so no text is shuffled and no row is copied per
    column. Nested columns have none. ``method="approx"`` is one HyperLogLog++ pass.
    """
    p = by_position(df)
    cols = [ci for ci in (columns_of(df) if cols is None else cols)
            if ci.kind != "nested" and "map<" not in ci.dtype.simpleString()]
    schema = "ordinal int, unique_values bigint"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    if method == "approx":
        both = [F.struct(F.lit(ci.ordinal).alias("ordinal"),
                         F.approx_count_distinct(clean(F.col(ci.ref), ci.dtype), 0.05).alias("unique_values")) for ci in cols]
        return p.agg(F.array(*both).alias("m")).select(F.inline("m"))
    out = None
    for ci in cols:
        x = clean(F.col(ci.ref), ci.dtype)
        if ci.kind in ("string", "other"):
            one = p.where(x.isNotNull()).select(F.xxhash64(F.lit(1), x).alias("h1"), F.xxhash64(F.lit(2), x).alias("h2"))
            count = F.count_distinct("h1", "h2")
        else:
            one, count = p.select(x.alias("x")), F.count_distinct("x")
        row = one.agg(count.cast("bigint").alias("unique_values")).select(F.lit(ci.ordinal).alias("ordinal"), "unique_values")
        out = row if out is None else out.unionByName(row)
    return out


def profile(df: DataFrame, dataset: str = "data", distinct: str | None = "exact",
            as_of=None, batch: int = 200) -> DataFrame:
    """One row per column (see ``PROFILE_COLUMNS``).

    ``distinct``: ``exact`` or ``approx`` counts the distinct values of all
    columns, ``text`` those of text columns exactly, None of none
    (``unique_values`` is then NULL).
    """
    out = partials(df, as_of, batch=batch)
    if distinct is None:
        out = out.withColumn("unique_values", F.lit(None).cast("bigint"))
    else:
        wanted = [ci for ci in columns_of(df) if distinct != "text" or ci.kind == "string"]
        counts = distinct_counts(df, wanted, "approx" if distinct == "approx" else "exact")
        out = out.join(counts, "ordinal", "left")
    return finish_profile(out.withColumn("dataset", F.lit(dataset)))


def finish_profile(stats: DataFrame) -> DataFrame:
    """Derived fields from the raw counts of whole tables: the date layout that wins,
    type label, coverage, category."""
    non_null, rows = F.col("non_null"), F.col("rows")
    text = F.col("kind") == "string"
    most = F.array_max(F.transform("layouts", lambda s: s["n"]))
    # the first layout of the largest count
    place = F.array_position(F.transform("layouts", lambda s: s["n"]), most).cast("int")
    win = lambda f: F.element_at("layouts", place).getField(f)
    parsed = F.when(text, F.coalesce(most, F.lit(0)))
    stats = stats.withColumn("date_parsed", parsed).withColumns({
        "bad_dates": F.when(text, non_null - F.col("date_parsed")).otherwise(F.col("bad")),
        "future_dates": F.when(text, F.coalesce(win("future"), F.lit(0))).otherwise(F.col("future")),
        "date_layout": F.when(F.col("date_parsed") > 0, F.element_at(F.array(*map(F.lit, LAYOUTS)), place)),
        "layout_conflicts": F.when(text, F.coalesce("any_date", F.lit(0)) - F.col("date_parsed")),
        "constant": F.when(F.col("kind") != "nested", F.coalesce(F.col("low") == F.col("high"), F.lit(True))),
    })
    dtype = F.when(text & (F.col("date_parsed") > non_null * 0.7), F.lit("datetime (string)")).otherwise(F.col("type_label"))
    # Empty table: coverage is undefined (NULL), not an error.
    coverage = F.when(rows > 0, non_null / rows)
    return stats.select(
        "dataset", F.col("ordinal").cast("int").alias("ordinal"),
        "column", "spark_type", "kind",
        dtype.alias("dtype"),
        category_expr(F.col("column")).alias("category"),
        rows.cast("bigint").alias("rows"),
        non_null,
        coverage.alias("coverage"),
        F.round(coverage * 100, 1).alias("coverage_pct"),
        *PROFILE_COLUMNS[PROFILE_COLUMNS.index("unique_values"):],
    )


def samples(df: DataFrame, order_by: str, n: int = 5, dataset: str = "data") -> DataFrame:
    """C4: first ``n`` non-null values (as text) of every column, in the order
    of ``order_by``, then of the text.

    Each column is a scan of two columns with a bounded top-n; the few rows left
    are numbered together.
    """
    p, cols = by_position(df), columns_of(df)
    key = F.col(cols[df.columns.index(order_by)].ref)
    out = None
    for c in cols:
        if c.kind == "nested":
            continue
        top = p.select(key.alias("_key"), clean(F.col(c.ref), c.dtype).cast("string").alias("value")).where(
            F.col("value").isNotNull()).orderBy("_key", "value").limit(n)
        top = top.select(F.lit(c.ordinal).alias("ordinal"), F.lit(c.name).alias("column"), "_key", "value")
        out = top if out is None else out.unionByName(top)
    if out is None:
        return df.sparkSession.createDataFrame([], "dataset string, ordinal int, column string, sample_no int, value string")
    w = Window.partitionBy("ordinal").orderBy("_key", "value")
    return out.select(F.lit(dataset).alias("dataset"), "ordinal", "column",
                      F.row_number().over(w).cast("int").alias("sample_no"), "value")


def coverage_summary(prof: DataFrame) -> DataFrame:
    """Per dataset, mean of rounded coverage (1 dp), columns >= 99 %,
    columns < 30 %."""
    return prof.groupBy("dataset").agg(
        F.round(F.avg("coverage_pct"), 1).alias("avg_coverage"),
        F.count_if(F.col("coverage_pct") >= 99).cast("bigint").alias("fully_populated"),
        F.count_if(F.col("coverage_pct") < 30).cast("bigint").alias("sparse_columns"),
    )
