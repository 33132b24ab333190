"""Dataset facts."""

from __future__ import annotations

import logging
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import clean
from ..functions.parse import LAYOUTS, parse_layouts
from ..functions.text import size_label, ymd
from .profile import _as_date
from .rules import (CUSTOMER_EXACT, CUSTOMER_PATTERN, META_CLAIM, META_DATE,
                    POLICY_EXACT, POLICY_PATTERN, find_column, name_match)
from .schema import by_position, columns_of, schema_frame

# Fixed value: a date column counts when over 30 % of rows parse.
DATE_SHARE = 0.3


def _has_file_metadata(df: DataFrame) -> bool:
    """True when ``df`` is a file scan that exposes ``_metadata``."""
    quiet = logging.getLogger("DataFrameQueryContextLogger")
    level = quiet.level
    quiet.setLevel(logging.CRITICAL)
    try:
        df.select("_metadata.file_size").schema
        return True
    except Exception:
        return False
    finally:
        quiet.setLevel(level)


def meta_shape(df: DataFrame, dataset: str = "data", file_type: str | None = None) -> DataFrame:
    """Rows, columns and bytes on disk (sum over the distinct files the
    scan reads, from the hidden ``_metadata`` column of file sources)."""
    ncols = len(df.columns)
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    if _has_file_metadata(df):
        files = df.select(F.col("_metadata.file_path").alias("p"),
                          F.col("_metadata.file_size").alias("s")).distinct()
        size = files.agg(F.sum("s").cast("bigint").alias("bytes"))
    else:
        # A view, join or repartitioned scan: sum the sizes of the files it
        # reads from the file system listing (None for in-memory data).
        from ..sources.readers import input_bytes
        total = input_bytes(df) if df.inputFiles() else None
        size = df.sparkSession.createDataFrame([(total,)], "bytes bigint")
    return rows.crossJoin(size).select(
        F.lit(dataset).alias("dataset"), F.col("rows").cast("bigint").alias("rows"),
        F.lit(ncols).cast("int").alias("columns"), "bytes",
        size_label(F.col("bytes")).alias("file_size"),
        F.lit(file_type).cast("string").alias("file_type"))


def _pick(df: DataFrame, pattern: str, exact: tuple) -> str | None:
    """P1 on the table's schema (a local relation of names, no scan)."""
    r = find_column(schema_frame(df.sparkSession, df, "_"), pattern, exact).first()
    return r["column"] if r else None


def unique_entities(df: DataFrame, dataset: str = "data") -> DataFrame:
    """Distinct policies and customers (NULL when no such column)."""
    info = {c.name: c for c in columns_of(df)}
    pol = _pick(df, POLICY_PATTERN, POLICY_EXACT)
    cus = _pick(df, CUSTOMER_PATTERN, CUSTOMER_EXACT)

    def nd(c):
        if c is None or info[c].kind == "nested":
            return F.lit(None).cast("bigint")
        return F.count_distinct(clean(F.col(info[c].ref), info[c].dtype)).cast("bigint")

    return by_position(df).agg(nd(pol).alias("unique_policies"), nd(cus).alias("unique_customers")).select(
        F.lit(dataset).alias("dataset"), F.lit(pol).cast("string").alias("policy_column"),
        F.lit(cus).cast("string").alias("customer_column"), "unique_policies", "unique_customers")


def _claim_facts(df: DataFrame) -> tuple[str | None, list, list]:
    """The first column named like a claim amount or count, and the aggregate
    of its claiming rows: values > 0 (numbers), true (booleans), not empty (text)."""
    cols = columns_of(df)
    sf = schema_frame(df.sparkSession, df, "_")
    r = sf.where(name_match(F.col("column"), META_CLAIM)).orderBy("ordinal").select("ordinal").first()
    if r is None:
        return None, [], [F.lit(None).cast("bigint").alias("claiming_entities"), F.lit(None).cast("double").alias("claim_rate")]
    info = cols[r["ordinal"]]
    c = F.col(info.ref)
    if info.kind == "numeric":
        x = clean(c, info.dtype)
        pred = x.isNotNull() & (x > 0)
    elif info.kind == "boolean":
        pred = F.coalesce(c, F.lit(False))
    elif info.kind == "string":
        pred = c.isNotNull() & (c != "")
    else:
        pred = c.isNotNull()
    rate = F.round(F.when(F.col("n") > 0, F.col("k") * 100.0 / F.col("n")), 2)
    return info.name, [F.count_if(pred).alias("k")], [F.col("k").cast("bigint").alias("claiming_entities"), rate.alias("claim_rate")]


def _date_facts(df: DataFrame) -> tuple[list, list, list]:
    """The parsed columns, aggregates and results of the earliest and latest date
    over columns named like dates whose values parse in over 30 % of rows. Text is
    read by the layout that reads most of the column."""
    read, aggs = [], []
    facts = lambda d: F.struct(F.count(d).alias("k"), F.min(d).alias("a"), F.max(d).alias("b"))
    for ci in columns_of(df):
        if ci.kind == "nested" or not re.search(META_DATE, ci.name, re.I):
            continue
        if ci.kind == "string":
            name = f"d{ci.ordinal}"
            read.append(parse_layouts(F.col(ci.ref)).alias(name))
            aggs.append(F.array(*[facts(F.get(F.col(name), F.lit(i))) for i in range(len(LAYOUTS))]).alias(f"t{len(aggs)}"))
            continue
        parsed, _ = _as_date(ci, F.col(ci.ref))
        if parsed is not None:
            aggs.append(F.array(facts(parsed)).alias(f"t{len(aggs)}"))
    if not aggs:
        none = F.lit(None).cast("string")
        return [], [], [none.alias("date_min"), none.alias("date_max")]

    def over(field: str) -> Column:
        each = []
        for i in range(len(aggs)):
            k = F.transform(f"t{i}", lambda x: x["k"])
            best = F.element_at(f"t{i}", F.array_position(k, F.array_max(k)).cast("int"))
            each.append(F.when(best["k"] > F.col("n") * DATE_SHARE, best[field]))
        return F.array(*each)

    return read, aggs, [ymd(F.array_min(over("a"))).alias("date_min"), ymd(F.array_max(over("b"))).alias("date_max")]


def claims_and_dates(df: DataFrame, dataset: str = "data") -> DataFrame:
    """A8 and A9 in one aggregate, with the rows (part of S5)."""
    column, claim_aggs, claims = _claim_facts(df)
    read, date_aggs, dates = _date_facts(df)
    g = by_position(df).select("*", *read).agg(F.count(F.lit(1)).alias("n"), *claim_aggs, *date_aggs)
    out = g.select(F.lit(dataset).alias("dataset"), F.col("n").cast("bigint").alias("rows"),
                   F.lit(column).cast("string").alias("claim_column"), *claims, *dates)
    return out.withColumn("date_range", F.when(F.col("date_min").isNotNull(), F.concat_ws(" → ", "date_min", "date_max")))


def claim_rate(df: DataFrame, dataset: str = "data") -> DataFrame:
    """A8 alone."""
    column, aggs, out = _claim_facts(df)
    return by_position(df).agg(F.count(F.lit(1)).alias("n"), *aggs).select(
        F.lit(dataset).alias("dataset"), F.lit(column).cast("string").alias("claim_column"), *out)


def date_range(df: DataFrame, dataset: str = "data") -> DataFrame:
    """A9 alone."""
    read, aggs, out = _date_facts(df)
    g = by_position(df).select("*", *read).agg(F.count(F.lit(1)).alias("n"), *aggs).select(F.lit(dataset).alias("dataset"), *out)
    return g.withColumn("date_range", F.when(F.col("date_min").isNotNull(), F.concat_ws(" → ", "date_min", "date_max")))


def meta(df: DataFrame, dataset: str = "data", file_type: str | None = None) -> DataFrame:
    """S5, C7, A8 and A9 in one row: one aggregate, one of distinct counts, and the
    size of the files from their listing."""
    from ..sources.readers import input_bytes
    total = input_bytes(df) if df.inputFiles() else None
    size = F.lit(total).cast("bigint")
    facts = claims_and_dates(df, dataset).withColumns({
        "columns": F.lit(len(df.columns)).cast("int"), "bytes": size, "file_size": size_label(size),
        "file_type": F.lit(file_type).cast("string")})
    return facts.join(unique_entities(df, dataset), "dataset")
