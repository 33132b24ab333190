"""Date layouts of text columns by a vote (T1 over a column, C5, Q6).

A value such as ``01/02/2024`` fits two layouts. Which one is meant is decided for the
whole column: every value votes for all layouts that read it, in one aggregate, and the
layout with most votes reads the column (ties: in the order of ``LAYOUTS``, month first
before day first). Values that only other layouts read do not parse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import LAYOUTS, parse_date_as, parse_layouts
from .schema import ColumnInfo, by_position, columns_of


def _text_columns(df: DataFrame, columns: list[str] | None) -> list[ColumnInfo]:
    cols = [ci for ci in columns_of(df) if ci.kind == "string" and (columns is None or ci.name in columns)]
    if columns is not None and (missing := set(columns) - {ci.name for ci in cols}):
        raise ValueError(f"no text columns: {', '.join(sorted(missing))}")
    return cols


def _votes(df: DataFrame, cols: list[ColumnInfo]) -> DataFrame:
    """One row: of each column ``v<ordinal>``, the votes of each layout in order."""
    read = by_position(df).select(*[parse_layouts(F.col(ci.ref)).alias(ci.ref) for ci in cols])
    return read.agg(*[F.array(*[F.count(F.get(ci.ref, F.lit(i))) for i in range(len(LAYOUTS))]).alias(f"v{ci.ordinal}")
                      for ci in cols])


def _winner(votes: str):
    """Name of the layout with most votes; NULL when no value was read."""
    most = F.array_max(votes)
    return F.when(most > 0, F.element_at(F.array(*map(F.lit, LAYOUTS)), F.array_position(votes, most).cast("int")))


def layout_votes(df: DataFrame, columns: list[str] | None = None, dataset: str = "data") -> DataFrame:
    """``(dataset, ordinal, column, layout, votes, chosen)``: one row per text column
    (or those of ``columns``) and layout that reads at least one of its values."""
    cols = _text_columns(df, columns)
    if not cols:
        return df.sparkSession.createDataFrame([], "dataset string, ordinal int, column string, layout string, votes bigint, chosen boolean")
    names = F.array(*map(F.lit, LAYOUTS))
    each = F.array(*[F.struct(F.lit(ci.ordinal).alias("ordinal"), F.lit(ci.name).alias("column"),
                              F.col(f"v{ci.ordinal}").alias("all"), _winner(f"v{ci.ordinal}").alias("best")) for ci in cols])
    rows = _votes(df, cols).select(F.inline(each))
    rows = rows.select("ordinal", "column", "best", F.posexplode("all").alias("i", "votes"))
    return rows.where("votes > 0").withColumn("layout", F.element_at(names, F.col("i") + 1)).select(
        F.lit(dataset).alias("dataset"), "ordinal", "column", "layout", "votes", (F.col("layout") == F.col("best")).alias("chosen"))


def read_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the text ``columns`` read as ``timestamp_ntz`` by the layout of the
    vote; what it does not read is NULL. Stays lazy: the vote is one row, broadcast."""
    cols = {ci.ordinal: ci for ci in _text_columns(df, columns)}
    if not cols:
        return df
    votes = _votes(df, list(cols.values())).select(*[_winner(f"v{i}").alias(f"w{i}") for i in cols])
    rows = by_position(df).crossJoin(F.broadcast(votes))
    return rows.select(*[(parse_date_as(F.col(ci.ref), F.col(f"w{ci.ordinal}")) if ci.ordinal in cols else F.col(ci.ref)).alias(ci.name)
                         for ci in columns_of(df)])
