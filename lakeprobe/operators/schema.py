"""Schema-only planning: column kinds and type labels from ``df.schema`` (P6,
part of C5). Nothing here reads data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .rules import category_expr


@dataclass(frozen=True)
class ColumnInfo:
    ordinal: int
    name: str
    dtype: T.DataType
    kind: str      # numeric | string | boolean | temporal | nested | other
    label: str     # dtype label; strings get theirs from a parse rate later

    @property
    def ref(self) -> str:
        """The column's name in ``by_position``."""
        return f"c{self.ordinal}"

    @property
    def is_float(self) -> bool:
        return isinstance(self.dtype, (T.FloatType, T.DoubleType))

    @property
    def is_integer(self) -> bool:
        return isinstance(self.dtype, T.IntegralType)


def kind_of(dt: T.DataType) -> tuple[str, str]:
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "temporal", "datetime"
    if isinstance(dt, T.BooleanType):
        return "boolean", "boolean"
    if isinstance(dt, T.IntegralType):
        return "numeric", "integer"
    if isinstance(dt, (T.FractionalType,)):
        return "numeric", "float"
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return "string", "object"
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return "nested", "nested"
    return "other", "object"


def columns_of(df: DataFrame) -> list[ColumnInfo]:
    out = []
    for i, f in enumerate(df.schema.fields):
        kind, label = kind_of(f.dataType)
        out.append(ColumnInfo(i, f.name, f.dataType, kind, label))
    return out


def by_position(df: DataFrame) -> DataFrame:
    """The same columns named by place (``c0``, ``c1``, ...), so that any names,
    with back-quotes or equal but for case, can be worked on."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def schema_frame(spark: SparkSession, df: DataFrame, dataset: str) -> DataFrame:
    """One row per column with name facts only (a local relation, no scan)."""
    rows = [(dataset, c.ordinal, c.name, c.dtype.simpleString(), c.kind, c.label)
            for c in columns_of(df)]
    sf = spark.createDataFrame(
        rows, "dataset string, ordinal int, column string, spark_type string, kind string, type_label string")
    from pyspark.sql import functions as F
    return sf.withColumn("category", category_expr(F.col("column")))


def categories_of(spark: SparkSession, df: DataFrame) -> dict[str, str]:
    """Category per column name, evaluated by the same Spark rule on a local
    relation of names (schema-sized, used to plan which columns to scan)."""
    return {r["column"]: r["category"]
            for r in schema_frame(spark, df, "_").select("column", "category").collect()}
