"""The twelve quality checks (Q1-Q13).

Nine of them read only the profile (one row per column). Duplicate rows (Q2),
duplicate columns (Q3) and outliers (Q7) need their own passes over the data.
Every check returns status rows
``dataset, check_no, check, status, value, flagged, detail``: ``value`` is the
check's headline number, ``flagged`` the count of flagged items and
``detail`` the flagged columns (sorted, comma-joined).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.nulls import clean
from .distributions import numeric_long, quantiles
from .schema import by_position, columns_of

# Check names in run order.
CHECK_NAMES = (
    "Missing Values",
    "Duplicate Rows",
    "Duplicate Columns",
    "Zero Variance Variables",
    "Sparse Variables",
    "Date Integrity",
    "Outliers (IQR Method)",
    "Unexpected Null Patterns",
    "Mixed Data Types",
    "High Cardinality Categoricals",
    "Negative Values in Positive-Expected Fields",
    "Overall Population Coverage",
)
# Limits of the checks.
IQR_FACTOR = 3
KEY_CATEGORIES = ("Identifiers", "Dates", "Exposure")
POSITIVE_CATEGORIES = ("Claims", "Exposure", "Premium")

STATUS_SCHEMA = ("dataset string, check_no int, check string, status string, "
                 "value double, flagged bigint, detail string")


def _status(df: DataFrame, no: int, status: Column, value: Column, flagged: Column,
            detail: Column) -> DataFrame:
    """Status rows of a check. A table without rows (``rows`` is 0) fails with a
    NULL value; ``df`` without ``rows`` has its own rule."""
    if "rows" in df.columns:
        none = F.col("rows") == 0
        status = F.when(none, F.lit("fail")).otherwise(status)
        value = F.when(~none, value)
        flagged, detail = F.when(none, F.lit(0)).otherwise(flagged), F.when(none, F.lit("")).otherwise(detail)
    return df.select(
        "dataset", F.lit(no).cast("int").alias("check_no"),
        F.lit(CHECK_NAMES[no - 1]).alias("check"), status.alias("status"),
        value.cast("double").alias("value"), flagged.cast("bigint").alias("flagged"),
        detail.alias("detail"))


def _flag_list(cond: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("column")))), ",")


def _per_dataset(prof: DataFrame, *aggs: Column) -> DataFrame:
    return prof.groupBy("dataset").agg(*aggs, F.max("rows").alias("rows"))


def check_missing(prof: DataFrame) -> DataFrame:
    """Q1: missing cells over all cells; <5 % pass, <20 % warn, else fail."""
    cells = F.sum(F.col("rows"))
    missing = F.sum(F.col("rows") - F.col("non_null"))
    g = _per_dataset(prof, F.when(cells > 0, missing * 100.0 / cells).alias("v"),
                     F.count_if(F.col("non_null") < F.col("rows")).alias("f"),
                     _flag_list(F.col("non_null") < F.col("rows")).alias("d"))
    v = F.col("v")
    st = F.when(v < 5, "pass").when(v < 20, "warn").otherwise("fail")
    return _status(g, 1, st, v, F.col("f"), F.col("d"))


def zero_variance() -> Column:
    return F.col("kind").isin("numeric", "string") & F.col("constant")


def check_zero_variance(prof: DataFrame) -> DataFrame:
    """Q4: numeric and text columns with at most one distinct value."""
    cond = zero_variance()
    g = _per_dataset(prof, F.count_if(cond).alias("f"), _flag_list(cond).alias("d"))
    return _status(g, 4, F.when(F.col("f") == 0, "pass").otherwise("warn"),
                   F.col("f"), F.col("f"), F.col("d"))


def check_sparse(prof: DataFrame) -> DataFrame:
    """Q5: columns under 30 % populated; none pass, <5 warn, else fail."""
    cond = F.col("coverage") < 0.30
    g = _per_dataset(prof, F.count_if(cond).alias("f"), _flag_list(cond).alias("d"))
    f = F.col("f")
    st = F.when(f == 0, "pass").when(f < 5, "warn").otherwise("fail")
    return _status(g, 5, st, f, f, F.col("d"))


def date_columns(prof: DataFrame, limit: int | None = None) -> DataFrame:
    """Q6 columns: those whose category or type names a date, all of them or the
    first ``limit``."""
    cond = F.lower("category").contains("date") | F.lower("dtype").contains("date")
    if limit is None:
        return prof.where(cond)
    w = Window.partitionBy("dataset").orderBy("ordinal")
    return prof.where(cond).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def check_date_integrity(prof: DataFrame, limit: int | None = None) -> DataFrame:
    """Q6: nulls, unparseable and future values in date columns."""
    dc = date_columns(prof, limit).withColumn("null_dates", F.col("rows") - F.col("non_null"))
    issue = (F.col("null_dates") + F.col("bad_dates") > 0) | (F.col("future_dates") > 0)
    g = dc.groupBy("dataset").agg(
        F.sum(F.col("null_dates") + F.col("bad_dates")).alias("v"),
        F.count_if(issue).alias("f"), _flag_list(issue).alias("d"))
    full = prof.groupBy("dataset").agg(F.max("rows").alias("rows")).join(g, "dataset", "left")
    f = F.coalesce(F.col("f"), F.lit(0))
    return _status(full, 6, F.when(f == 0, "pass").otherwise("warn"),
                   F.coalesce(F.col("v"), F.lit(0)), f, F.coalesce(F.col("d"), F.lit("")))


def date_detail(prof: DataFrame) -> DataFrame:
    """Q6 per column: null, unparseable, their sum, and future values."""
    return date_columns(prof).select(
        "dataset", "ordinal", "column",
        (F.col("rows") - F.col("non_null")).alias("null_dates"), "bad_dates",
        (F.col("rows") - F.col("non_null") + F.col("bad_dates")).alias("unparseable"),
        "future_dates")


def check_unexpected_nulls(prof: DataFrame) -> DataFrame:
    """Q8: key columns (Identifiers, Dates, Exposure) under 95 % coverage."""
    cond = F.col("category").isin(*KEY_CATEGORIES) & (F.col("coverage_pct") < 95)
    g = _per_dataset(prof, F.count_if(cond).alias("f"), _flag_list(cond).alias("d"))
    return _status(g, 8, F.when(F.col("f") == 0, "pass").otherwise("warn"),
                   F.col("f"), F.col("f"), F.col("d"))


def mixed_types() -> Column:
    return ((F.col("kind") == "string") & (F.col("num_parsed") > 0)
            & (F.col("num_parsed") < F.col("non_null") * 0.9))


def check_mixed_types(prof: DataFrame) -> DataFrame:
    """Q9: text columns where some but under 90 % of values are numbers."""
    cond = mixed_types()
    g = _per_dataset(prof, F.count_if(cond).alias("f"), _flag_list(cond).alias("d"))
    return _status(g, 9, F.when(F.col("f") == 0, "pass").otherwise("warn"),
                   F.col("f"), F.col("f"), F.col("d"))


def high_cardinality() -> Column:
    return ((F.col("dtype") == "object") & (F.col("category") != "Identifiers")
            & (F.col("unique_values") > 100))


def check_cardinality(prof: DataFrame) -> DataFrame:
    """Q10: text (``object``) columns, not identifiers, over 100 values."""
    cond = high_cardinality()
    g = _per_dataset(prof, F.count_if(cond).alias("f"), _flag_list(cond).alias("d"))
    return _status(g, 10, F.when(F.col("f") == 0, "pass").otherwise("warn"),
                   F.col("f"), F.col("f"), F.col("d"))


def negative_values() -> Column:
    return (F.col("category").isin(*POSITIVE_CATEGORIES) & (F.col("kind") == "numeric")
            & (F.col("negatives") > 0))


def check_negatives(prof: DataFrame) -> DataFrame:
    """Q11: negatives in numeric Claims / Exposure / Premium columns."""
    cond = negative_values()
    g = _per_dataset(prof, F.count_if(cond).alias("f"), _flag_list(cond).alias("d"),
                     F.sum(F.when(cond, F.col("negatives"))).alias("v"))
    return _status(g, 11, F.when(F.col("f") == 0, "pass").otherwise("warn"),
                   F.coalesce(F.col("v"), F.lit(0)), F.col("f"), F.col("d"))


def check_coverage(prof: DataFrame) -> DataFrame:
    """Q12: mean raw coverage; >=85 pass, >=60 warn, else fail; flagged is
    the count of columns under 50 %."""
    cond = F.col("coverage") < 0.5
    g = _per_dataset(prof, F.avg(F.col("coverage") * 100).alias("v"),
                     F.count_if(cond).alias("f"), _flag_list(cond).alias("d"))
    v = F.col("v")
    st = F.when(v >= 85, "pass").when(v >= 60, "warn").otherwise("fail")
    return _status(g, 12, st, v, F.col("f"), F.col("d"))


# --------------------------------------------------------------------------
# Checks with their own passes over the data

def plain_text(col: Column, dtype: T.DataType) -> Column:
    """Nested values as JSON, the entries of maps sorted by key at every depth."""
    def walk(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: walk(x, t.elementType))
        if isinstance(t, T.StructType):
            fields = [walk(c.getField(f.name), f.dataType).alias(f.name) for f in t.fields]
            return F.when(c.isNotNull(), F.struct(*fields)) if fields else c
        if isinstance(t, T.MapType):
            return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(
                F.to_json(F.struct(walk(e["key"], t.keyType).alias("k"))).alias("k"),
                F.to_json(F.struct(walk(e["value"], t.valueType).alias("v"))).alias("v"))))
        return c
    return F.to_json(F.struct(walk(col, dtype).alias("x")))


def _row_key(df: DataFrame) -> list[Column]:
    """Per column of ``by_position(df)``, (is-null flag, value) with floats
    normalised (NaN kept as one value, -0.0 as 0.0) and nested values as text."""
    parts = []
    for c in columns_of(df):
        col = F.col(c.ref)
        null = col.isNull()
        if c.is_float:
            col = F.when(col == 0, F.lit(0.0).cast(c.dtype)).otherwise(col)
        elif c.kind == "nested":
            col = F.when(~null, plain_text(col, c.dtype))
        parts += [null, col]
    return parts


def check_dup_rows(df: DataFrame, dataset: str = "data") -> DataFrame:
    """Q2: rows equal to an earlier row (null = null, NaN = NaN).

    Rows are grouped by a 128-bit fingerprint (two independent 64-bit
    hashes of every column with its null flag) instead of their full
    content: the shuffle carries 16 bytes per distinct row however wide the
    table, and map-side partial aggregation folds hot rows before it.
    """
    key = _row_key(df)
    fp = by_position(df).select(F.xxhash64(F.lit("a"), *key).alias("h1"),
                   F.xxhash64(F.lit("b"), *key).alias("h2"))
    g = fp.agg(F.count(F.lit(1)).alias("n"),
               F.count_distinct("h1", "h2").alias("u")).select(
        F.lit(dataset).alias("dataset"), (F.col("n") - F.col("u")).alias("dups"), "n")
    dups, n = F.col("dups"), F.col("n")
    pct = F.when(n > 0, F.round(dups * 100.0 / n, 2)).otherwise(F.lit(0.0))
    st = F.when(dups == 0, "pass").when(pct < 5, "warn").otherwise("fail")
    return _status(g, 2, st, pct, dups, F.lit(""))


def _text(c) -> Column:
    col = F.col(c.ref)
    if c.kind == "nested":
        return F.when(col.isNotNull(), plain_text(col, c.dtype))
    return col.cast("string")


def dup_column_pairs(df: DataFrame, batch: int = 200) -> list[tuple[str, str]]:
    """Q3 pairs (later column, first column with equal content).

    Columns are compared by their text form with null = null, over all rows. Pass 1
    takes, per column, its non-null count and sums of its values' hashes, which are blind
    to order, ``batch`` columns in one aggregate and pruned to them. Of the
    columns that agree in both, pass 2 takes two sums of ``hash(text, row
    fingerprint)``, the fingerprint being that of those columns. Only columns that agree
    again are compared value by value in pass 3. The driver reads one small row per
    batch, never the data.
    """
    cols = columns_of(df)
    p = by_position(df)

    def alike(groups: list[list], aggs) -> list[list]:
        """Groups cut by what ``aggs`` gives for each column, in order; single ones go."""
        found, flat = {}, [c for g in groups for c in g]
        for start in range(0, len(flat), batch):
            some = flat[start:start + batch]
            found |= aggs(some).first().asDict()
        out = []
        for g in groups:
            by = {}
            for c in g:
                by.setdefault(found[f"k{c.ordinal}"], []).append(c)
            out += [same for same in by.values() if len(same) > 1]
        return out

    def blind(some: list) -> DataFrame:
        return p.select(*[_text(c).alias(c.ref) for c in some]).agg(*[
            F.struct(F.count(c.ref), *_hash_sums(F.xxhash64(c.ref))).cast("string").alias(f"k{c.ordinal}") for c in some])

    groups = alike([cols], blind)
    if not groups:
        return []
    left = [c for g in groups for c in g]
    base = p.select(*[_text(c).alias(c.ref) for c in left])
    marks = [x for c in left for x in (F.col(c.ref).isNull(), F.col(c.ref))]
    rows = base.select("*", F.xxhash64(F.lit("r1"), *marks).alias("_r1"), F.xxhash64(F.lit("r2"), *marks).alias("_r2"))

    def aware(some: list) -> DataFrame:
        return rows.agg(*[F.struct(*[x for r in ("_r1", "_r2") for x in _hash_sums(
            F.xxhash64(F.col(c.ref).isNull(), F.col(c.ref), F.col(r)))]).cast("string").alias(f"k{c.ordinal}") for c in some])

    groups = alike(groups, aware)
    cands = [(c, g[0]) for g in groups for c in g[1:]]
    out = []
    for start in range(0, len(cands), batch):
        some = cands[start:start + batch]
        verify = base.agg(*[F.count_if(~F.col(a.ref).eqNullSafe(F.col(b.ref))).alias(f"p{i}") for i, (a, b) in enumerate(some)]).first()
        out += [(a, b) for i, (a, b) in enumerate(some) if verify[f"p{i}"] == 0]
    return [(a.name, b.name) for a, b in sorted(out, key=lambda x: x[0].ordinal)]


def check_dup_cols(df: DataFrame, dataset: str = "data", pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Q3: duplicate column pairs; none pass, else warn."""
    pairs = dup_column_pairs(df) if pairs is None else pairs
    detail = ",".join(f"{a}={b}" for a, b in sorted(pairs))
    g = df.limit(1).agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(dataset).alias("dataset"), "rows", F.lit(len(pairs)).alias("f"), F.lit(detail).alias("d"))
    return _status(g, 3, F.when(F.col("f") == 0, "pass").otherwise("warn"),
                   F.col("f"), F.col("f"), F.col("d"))


def _hash_sums(h: Column) -> list[Column]:
    """Sums of a hash's three parts of 22 bits: as telling as the sum of the whole, in
    plain longs that hold 2^41 rows."""
    return [F.sum(F.shiftright(h, 44)), *[F.sum(F.shiftright(h, k).bitwiseAND(F.lit((1 << 22) - 1))) for k in (22, 0)]]


OUTLIER_SCHEMA = "dataset string, column string, q1 double, q3 double, lo double, hi double, outliers bigint"


def outlier_counts(df: DataFrame, dataset: str = "data", method: str = "exact",
                   limit: int | None = None, sketches: DataFrame | None = None, sketch_k: int = 1024) -> DataFrame:
    """Q7 per column: quartiles, fences at 3 x IQR (exclusive) and the count
    outside them, for all numeric columns or the first ``limit``; IQR 0 is
    skipped. ``sketches`` (``column, sketch``, as a catalog stores them) save one
    of the reads that exact quartiles take."""
    num = [c.name for c in columns_of(df) if c.kind == "numeric"][:limit]
    if not num:
        return df.sparkSession.createDataFrame([], OUTLIER_SCHEMA)
    long = numeric_long(df, num)
    q = quantiles(long, ["column"], [0.25, 0.75], method, few_groups=True, sketches=sketches, sketch_k=sketch_k)
    b = q.groupBy("column").agg(
        F.max(F.when(F.col("q_no") == 0, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("q_no") == 1, F.col("value"))).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    b = b.where(iqr != 0).select("column", "q1", "q3", (F.col("q1") - IQR_FACTOR * iqr).alias("lo"),
                                 (F.col("q3") + IQR_FACTOR * iqr).alias("hi"))
    out = _outside(df, num, b)
    return b.join(out, "column", "left").select(
        F.lit(dataset).alias("dataset"), "column", "q1", "q3", "lo", "hi",
        F.coalesce("outliers", F.lit(0)).cast("bigint").alias("outliers"))


def _outside(df: DataFrame, num: list[str], fences: DataFrame, batch: int = 25) -> DataFrame:
    """``column, outliers``: the values of the columns ``num`` outside their fences, one
    aggregate for ``batch`` columns (few enough for generated code), pruned to them. The
    fences of a batch are one row, joined by broadcast."""
    cols, out = [c for c in columns_of(df) if c.name in num], None
    for start in range(0, len(cols), batch):
        some = cols[start:start + batch]
        edges = fences.agg(*[F.max(F.when(F.col("column") == c.name, F.col(e))).alias(f"{e}{c.ordinal}") for c in some for e in ("lo", "hi")])
        values = by_position(df).select(*[clean(F.col(c.ref), c.dtype).cast("double").alias(c.ref) for c in some])
        counts = values.crossJoin(F.broadcast(edges)).agg(*[
            F.count_if((F.col(c.ref) < F.col(f"lo{c.ordinal}")) | (F.col(c.ref) > F.col(f"hi{c.ordinal}"))).alias(c.ref) for c in some])
        got = counts.select(F.inline(F.array(*[F.struct(F.lit(c.name).alias("column"), F.col(c.ref).alias("outliers")) for c in some])))
        out = got if out is None else out.unionByName(got)
    return out.groupBy("column").agg(F.sum("outliers").alias("outliers"))


def check_outliers(df: DataFrame, dataset: str = "data", method: str = "exact",
                   counts: DataFrame | None = None) -> DataFrame:
    """Q7: columns with outliers; none pass, <5 warn, else fail. ``counts`` is the
    table's ``outlier_counts`` where it is there already."""
    oc = outlier_counts(df, dataset, method) if counts is None else counts
    cond = F.col("outliers") > 0
    rows = df.limit(1).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(dataset).alias("dataset"), "rows")
    g = rows.join(oc.groupBy("dataset").agg(F.count_if(cond).alias("f"), _flag_list(cond).alias("d"),
                                            F.sum("outliers").alias("v")), "dataset", "left")
    f = F.coalesce(F.col("f"), F.lit(0))
    st = F.when(f == 0, "pass").when(f < 5, "warn").otherwise("fail")
    return _status(g, 7, st, F.coalesce(F.col("v"), F.lit(0)), f, F.coalesce(F.col("d"), F.lit("")))


def check_detail(df: DataFrame, prof: DataFrame, dataset: str = "data", method: str = "exact",
                 counts: DataFrame | None = None, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per flagged column and number: ``dataset, check_no, check, column,
    metric, value``. Duplicate columns give the place of the first equal column;
    Q2 has no columns and so no rows here."""
    oc = outlier_counts(df, dataset, method) if counts is None else counts
    pairs = dup_column_pairs(df) if pairs is None else pairs
    place = {c.name: c.ordinal for c in columns_of(df)}
    null_dates = F.col("rows") - F.col("non_null")
    rules = [
        (1, F.col("non_null") < F.col("rows"), {"missing": null_dates}),
        (4, zero_variance(), {"non_null": F.col("non_null")}),
        (5, F.col("coverage") < 0.30, {"coverage": F.col("coverage")}),
        (8, F.col("category").isin(*KEY_CATEGORIES) & (F.col("coverage_pct") < 95), {"coverage_pct": F.col("coverage_pct")}),
        (9, mixed_types(), {"numeric_share": F.col("num_parsed") / F.col("non_null")}),
        (10, high_cardinality(), {"unique_values": F.col("unique_values")}),
        (11, negative_values(), {"negatives": F.col("negatives")}),
        (12, F.col("coverage") < 0.5, {"coverage": F.col("coverage")}),
    ]

    def rows(src: DataFrame, no: int, cond: Column, metrics: dict[str, Column]) -> DataFrame:
        pairs_ = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in metrics.items()])
        return src.where(cond).select(F.lit(dataset).alias("dataset"), F.lit(no).alias("check_no"),
                                      F.lit(CHECK_NAMES[no - 1]).alias("check"), "column", F.inline(pairs_))

    dates = date_columns(prof).where("rows > 0")
    issue = (null_dates + F.col("bad_dates") > 0) | (F.col("future_dates") > 0)
    out = rows(dates, 6, issue, {"null_dates": null_dates, "bad_dates": F.col("bad_dates"),
                                 "unparseable": null_dates + F.col("bad_dates"), "future_dates": F.col("future_dates")})
    for no, cond, metrics in rules:
        out = out.unionByName(rows(prof.where("rows > 0"), no, cond, metrics))
    out = out.unionByName(rows(oc, 7, F.col("outliers") > 0, {k: F.col(k) for k in ("outliers", "q1", "q3", "lo", "hi")}))
    same = df.sparkSession.createDataFrame([(a, place[b]) for a, b in pairs], "column string, first int")
    return out.unionByName(rows(same, 3, F.lit(True), {"equal_to_place": F.col("first")}))


def run_checks(df: DataFrame, prof: DataFrame, dataset: str = "data", method: str = "exact",
               persist: bool = True, counts: DataFrame | None = None,
               pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Q13: all twelve status rows in run order.

    Nine checks read the profile; with ``persist`` it is first written to
    the shared checkpoint folder once, so the table is scanned for it once
    (and a lost executor does not trigger a rescan).
    """
    if persist:
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(df.sparkSession)
        prof = prof.checkpoint(eager=True)
    parts = [
        check_missing(prof), check_dup_rows(df, dataset), check_dup_cols(df, dataset, pairs),
        check_zero_variance(prof), check_sparse(prof), check_date_integrity(prof),
        check_outliers(df, dataset, method, counts), check_unexpected_nulls(prof),
        check_mixed_types(prof), check_cardinality(prof), check_negatives(prof),
        check_coverage(prof),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
