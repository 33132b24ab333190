"""Counts from Parquet footers (S5, Q1, Q5, Q12, C2, C6) without reading data.

Spark's second Parquet reader answers COUNT, and MIN and MAX of some types, from the
footers of the files. What footers do not know exactly is read: NaN in float columns
(missing here, a value there) and nested columns. That scan reads those columns only.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import clean
from .schema import ColumnInfo, by_position, columns_of

SCHEMA = "dataset string, ordinal int, column string, rows bigint, non_null bigint, low string, high string"


def _ranged(ci: ColumnInfo) -> bool:
    """Types whose least and largest value a footer holds exactly."""
    return ci.is_integer or isinstance(ci.dtype, T.DateType)


def pushed(spark: SparkSession, path: str, ranges: bool = True) -> tuple[DataFrame, list[ColumnInfo]]:
    """One row of counts (and ranges) that footers answer, and the columns it is about.
    The reader and its push-down are set in a session of their own, so that the
    caller's settings stay."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    df = own.read.parquet(path)
    # columns that are folders, not in the files: footers would count their NULLs
    folders = {unquote(k) for f in df.inputFiles()[:1] for k in re.findall(r"/([^/=]+)=", f)}
    cols = [ci for ci in columns_of(df) if ci.kind != "nested" and not ci.is_float and ci.name not in folders]
    ref = lambda ci: F.col("`" + ci.name.replace("`", "``") + "`")
    aggs = [F.count(ref(ci)).alias(f"n{ci.ordinal}") for ci in cols]
    aggs += [f(ref(ci)).alias(f"{k}{ci.ordinal}") for ci in cols if ranges and _ranged(ci) for k, f in (("a", F.min), ("b", F.max))]
    return df.agg(F.count(F.lit(1)).alias("rows"), *aggs), cols


def _answered(one: DataFrame) -> dict:
    """The footers' answers; none where some footer does not hold them."""
    try:
        return one.first().asDict()
    except (PySparkException, Py4JJavaError) as e:
        if "aggregatePushdown" not in str(e):
            raise
        return {}


def footer_counts(spark: SparkSession, path: str, dataset: str = "data") -> DataFrame:
    """``(dataset, ordinal, column, rows, non_null, low, high)`` of the Parquet files of
    ``path``; ``low`` and ``high`` (as text) of whole-number and date columns only.

    A footer has no range of a column without values, and some writers leave out
    statistics: what is not answered is scanned, its columns only. A row per column
    passes the driver.
    """
    found = _answered(pushed(spark, path)[0]) or _answered(pushed(spark, path, ranges=False)[0])
    df = spark.read.parquet(path)
    p, cols = by_position(df), columns_of(df)
    wanted = {"rows": F.count(F.lit(1))}
    for ci in cols:
        wanted[f"n{ci.ordinal}"] = F.count(clean(F.col(ci.ref), ci.dtype))
        if _ranged(ci):
            wanted |= {f"a{ci.ordinal}": F.min(ci.ref), f"b{ci.ordinal}": F.max(ci.ref)}
    rest = [agg.alias(name) for name, agg in wanted.items() if name not in found]
    if rest:
        found |= p.agg(*rest).first().asDict()
    text = lambda v: None if v is None else str(v)
    # files without row groups answer NULL
    rows = [(dataset, ci.ordinal, ci.name, found["rows"] or 0, found[f"n{ci.ordinal}"] or 0, text(found.get(f"a{ci.ordinal}")), text(found.get(f"b{ci.ordinal}")))
            for ci in cols]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def footer_counts_of(spark: SparkSession, paths: dict[str, str], at_once: int = 4) -> DataFrame:
    """``footer_counts`` of many datasets, ``at_once`` of them at a time."""
    with ThreadPoolExecutor(at_once) as pool:
        each = list(pool.map(lambda item: footer_counts(spark, item[1], item[0]), paths.items()))
    return reduce(lambda a, b: a.unionByName(b), each) if each else spark.createDataFrame([], SCHEMA)


def coverage_of(counts: DataFrame) -> DataFrame:
    """``footer_counts`` with the raw and rounded coverage that the checks of missing
    cells (Q1), sparse columns (Q5) and mean coverage (Q12) and the summary (C6) read."""
    share = F.when(F.col("rows") > 0, F.col("non_null") / F.col("rows"))
    return counts.withColumn("coverage", share).withColumn("coverage_pct", F.round(share * 100, 1))
