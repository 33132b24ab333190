"""Readers (S1-S4): Parquet and CSV into a DataFrame, nothing else changed."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parse import parse_number

# Text read as missing in CSV input (besides the empty cell).
NULL_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

FORMATS = {".parquet": "parquet", ".csv": "csv"}


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files a scan reads, from the listing of their folders: one
    call per folder, none per file."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    wanted, total = {p.toString() for p in paths}, 0
    for folder in {p.getParent().toString() for p in paths}:
        place = jvm.org.apache.hadoop.fs.Path(folder)
        for st in place.getFileSystem(conf).listStatus(place):
            if st.getPath().toString() in wanted:
                total += st.getLen()
    return total


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S3."""
    return spark.read.parquet(path)


CORRUPT = "_corrupt_record"


def _csv_text(spark: SparkSession, path: str, encoding: str, multi_line: bool) -> DataFrame:
    """All cells as text. A row with more fields than the header raises when it is
    met."""
    read = (spark.read.option("header", True).option("encoding", encoding).option("inferSchema", False)
            .option("escape", '"').option("multiLine", multi_line))
    names = read.csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    raw = (read.option("mode", "PERMISSIVE").option("enforceSchema", True).option("columnNameOfCorruptRecord", CORRUPT)
           .schema(schema).csv(path))
    line = F.col(CORRUPT)
    # a missing field at the end is a null, as in other readers
    fields = F.size(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*+"|[^,]*+)'), F.lit(0)))
    bad = line.isNotNull() & (fields > len(names))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("a CSV row does not fit the header: "), F.substring(line, 1, 200)))
                     .cast("string")).otherwise(F.col(f"`{names[0]}`")) if names else None
    return raw.select(*[(checked if i == 0 else F.col(f"`{c}`")).alias(c) for i, c in enumerate(names)]) if names else raw


def look_at_lines(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Whether some line, the header included, has bytes that are no UTF-8, and
    whether some line leaves a quote open. One aggregate."""
    line = F.col("value")
    quotes = F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))
    r = spark.read.text(path).agg(F.count_if(~F.expr("is_valid_utf8(value)")), F.count_if(quotes % 2 == 1)).first()
    return r[0] > 0, r[1] > 0


def read_csv(spark: SparkSession, path: str, infer: bool = True, encoding: str | None = None,
             multi_line: bool = False) -> DataFrame:
    """S1 + S2: CSV with a header; UTF-8, or Latin-1 when the bytes are no UTF-8
    (``encoding`` names one instead).

    Doubled quotes stand for a quote. ``multi_line`` reads line breaks inside
    quotes; such files cannot be split, so each is read by one task. Without it
    such a row raises. A row with more fields than the header raises.

    All cells are read as text; null tokens become NULL by projection; then
    each column takes the narrowest of boolean / long / double that every
    non-null value casts to (one aggregate), else stays text, dates included.
    """
    latin, open_quote = look_at_lines(spark, path)
    if open_quote and not multi_line:
        raise ValueError("a quoted value goes on over a line break: read with multi_line=True")
    raw = _csv_text(spark, path, encoding or ("ISO-8859-1" if latin else "UTF-8"), multi_line)
    nulls = F.array(*[F.lit(t) for t in NULL_TOKENS])
    text = raw.select([
        F.when(F.array_contains(nulls, F.col(f"`{c}`")) | (F.col(f"`{c}`") == ""), None)
        .otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if not infer or not text.columns:
        return text
    return infer_types(text)


# The words of a boolean column.
TRUE_WORDS, FALSE_WORDS = ("True", "TRUE", "true"), ("False", "FALSE", "false")


def infer_types(text: DataFrame, batch: int = 200) -> DataFrame:
    """Pick a type per text column from counts of cast successes, ``batch`` columns in
    one aggregate, so that generated code stays small however wide the table is."""
    found: dict[str, int] = {}
    for start in range(0, len(text.columns), batch):
        checks = []
        for i, c in enumerate(text.columns[start:start + batch], start):
            col = F.col(f"`{c}`")
            checks += [
                F.count(col).alias(f"n|{i}"),
                F.count_if(col.isin(*TRUE_WORDS, *FALSE_WORDS)).alias(f"b|{i}"),
                F.count_if(col.try_cast("long").isNotNull()).alias(f"l|{i}"),
                F.count_if(parse_number(col).isNotNull()).alias(f"d|{i}"),
            ]
        found |= text.agg(*checks).first().asDict()
    out = []
    for i, c in enumerate(text.columns):
        n, col = found[f"n|{i}"], F.col(f"`{c}`")
        if n and found[f"b|{i}"] == n:
            out.append(F.when(col.isNotNull(), col.isin(*TRUE_WORDS)).alias(c))
        elif n and found[f"l|{i}"] == n:
            out.append(col.cast("long").alias(c))
        elif n and found[f"d|{i}"] == n:
            out.append(col.try_cast("double").alias(c))
        else:
            out.append(col.alias(c))
    return text.select(out)


def load(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Reader by suffix (or ``fmt``); unknown suffixes are refused."""
    if fmt is None:
        ext = os.path.splitext(path.rstrip("/"))[1].lower()
        fmt = FORMATS.get(ext)
        if fmt is None:
            raise ValueError(f"Unsupported file extension: {ext or '(none)'}")
    if fmt == "parquet":
        return read_parquet(spark, path)
    if fmt == "csv":
        return read_csv(spark, path)
    raise ValueError(f"Unsupported format: {fmt}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables under ``sf_dir``."""
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")
