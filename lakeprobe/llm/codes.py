"""Operator 13, vector codes from per-dimension value dictionaries.

Components become integers, a vector is cut into equal consecutive parts, and each
part is replaced by the index of its nearest codebook entry. Distances are never
computed vector by vector: of each dimension, the distinct integers of a batch form
a dictionary, the squared differences of every distinct integer to all entries form
a table, and a part's distances are gathers from these tables by dictionary code,
added over the part's dimensions. All of it is whole-number arithmetic, so results do
not depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 62          # integers beyond are set to it, so that differences fit
LONG_MAX = (1 << 63) - 1


def integers(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """The batch's vectors as integers ``floor(SCALE * x)``, one row each."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(vectors), dim)
    return np.clip(np.floor(np.clip(x, -1e300, 1e300) * SCALE), -float(LIMIT), float(LIMIT)).astype("i8")


def part_bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    """Where parts begin and end: equal ones, or at most one apart where ``parts``
    does not divide ``dim``."""
    return [(i * dim // parts, (i + 1) * dim // parts) for i in range(parts)]


def dictionary(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct integers, ascending, and each row's place among them."""
    low, high = int(column.min()), int(column.max())
    if high - low > 4 * len(column) + 1024:
        return np.unique(column, return_inverse=True)
    there = np.zeros(high - low + 1, bool)
    there[column - low] = True
    return np.flatnonzero(there) + low, (np.cumsum(there) - 1)[column - low]


def nearest(x: np.ndarray, books: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row and part: the nearest entry (ties to the lower index) and its
    squared distance. Whole numbers of any size: those too large for 64 bits are
    Python's own."""
    n, dim = x.shape
    wide = max([abs(int(f(a))) for a in (x, books) if a.size for f in (np.min, np.max)], default=0)
    largest = (2 * wide) ** 2 * max(dim, 1)
    kind = "i4" if largest < 1 << 31 else "i8" if largest < 1 << 63 else object
    codes = np.zeros((n, parts), "i8")
    errors = np.zeros((n, parts), "i8" if kind != object else object)
    for p, (lo, hi) in enumerate(part_bounds(dim, parts)):
        total = np.zeros((n, len(books)), kind)
        for d in range(lo, hi):
            values, place = dictionary(x[:, d])
            table = (values.astype(kind)[:, None] - books[:, d].astype(kind)[None, :]) ** 2
            total += table[place]
        codes[:, p] = total.argmin(axis=1)
        errors[:, p] = total[np.arange(n), codes[:, p]]
    return codes, errors


def _sums(books: np.ndarray, parts: int):
    """Per task: of each dimension and entry, the rows assigned and their sum."""
    dim = books.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((dim, len(books)), "i8")
        total = np.zeros((dim, len(books)), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(batch.column(0), dim)
            codes, _ = nearest(x, books, parts)
            fits = not x.size or int(np.abs(x).max()) * len(x) < 1 << 62
            for p, (lo, hi) in enumerate(part_bounds(dim, parts)):
                order = np.argsort(codes[:, p], kind="stable")
                entry, start, rows = np.unique(codes[order, p], return_index=True, return_counts=True)
                count[lo:hi, entry] += rows
                part = x[order, lo:hi] if fits else x[order, lo:hi].astype(object)
                if hi > lo:
                    total[lo:hi, entry] += np.add.reduceat(part, start, axis=0).T.astype(object)
        d, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(d, pa.int32()), pa.array(e, pa.int32()), pa.array(count[d, e]),
             pa.array([str(s) for s in total[d, e]], pa.string())], ["dim", "entry", "rows", "total"])
    return run


def _codes(books: np.ndarray, parts: int):
    dim = books.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, errors = nearest(integers(batch.column(0), dim), books, parts)
                code = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
                error = [min(int(e), LONG_MAX) for e in errors.sum(axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), batch.column(2), pa.array(code, pa.string()), pa.array(error, pa.int64())],
                    ["id", "label", "code", "error"])
    return run


def train(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks as one array (entry, dimension) from ``rows`` of ``(vec, id)``. A
    round is one pass over all rows; what comes back is a count and a sum for each
    entry and dimension, so its size follows from the parameters alone."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").toArrow()
    books = integers(first.column("vec").combine_chunks(), dim)
    for _ in range(rounds):
        sums = rows.select("vec").mapInArrow(_sums(books, parts), "dim int, entry int, rows long, total string")
        books = books.copy()
        for r in sums.groupBy("dim", "entry").agg(
                F.sum("rows").alias("rows"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).toLocalIterator():
            books[r["entry"], r["dim"]] = int(r["total"]) // r["rows"]
    return books


def books_digest(books: np.ndarray, parts: int = PARTS) -> str:
    """SHA-256 of all components by part, entry and place within the part."""
    numbers = [str(v) for lo, hi in part_bounds(books.shape[1], parts) for entry in books[:, lo:hi].tolist() for v in entry]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def vector_codes(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row ``(vec_id, code, error, label_error, codebooks_sha256)`` per kept row.

    Dropped are rows whose vector is null or holds a null or non-finite component.
    The codebooks start as the parts of the ``entries`` smallest ids (null ids last;
    rows of one id by their vectors), and there are fewer entries if there are fewer
    rows. Vectors of another length have codebooks of their own. Where ``parts`` does not divide
    the length, parts differ by one dimension and empty ones have code 00 and no error. Integers
    stop at 2^62 either way, errors at the largest long. Null labels are one label.
    Repeated rows and ids are rows of their own; other columns are not read. An empty
    table gives an empty result. ``entries`` is at most 256, for two hex digits.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    spark, fields = df.sparkSession, {f.name: f.dataType for f in df.schema.fields}
    v = F.col(f"`{vector}`")
    if fields[vector].elementType not in (T.FloatType(), T.DoubleType()):
        v = v.cast("array<double>")
    ok = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(v.alias("vec"), F.col(f"`{vec_id}`").alias("id"), F.col(f"`{label}`").alias("label")).filter(ok)
    out_schema = T.StructType([T.StructField("id", fields[vec_id]), T.StructField("label", fields[label]),
                               T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    sizes = [r[0] for r in rows.select(F.size("vec")).distinct().collect()]  # a row per length of vectors
    coded = spark.createDataFrame([], out_schema).withColumn("sha", F.lit(""))
    for dim in sorted(sizes):
        part = rows.filter(F.size("vec") == dim)
        books = train(part, dim, parts, entries, rounds)
        got = part.mapInArrow(_codes(books, parts), out_schema)
        coded = coded.union(got.withColumn("sha", F.lit(books_digest(books, parts))))
    coded = stored(coded)
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX)).cast("long").alias("label_error"))
    sums = small(stored(sums.withColumnRenamed("label", "label_")))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("label_")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.col("sha").alias("codebooks_sha256"))


def op13_codes(embeddings: DataFrame) -> DataFrame:
    """The result of the query over ``embeddings``."""
    return vector_codes(embeddings)
