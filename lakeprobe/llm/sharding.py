"""Operator 7, sharding by histogram sort.

Rows are ordered by an integer key and cut into shards of near equal bytes. The
cuts are found before anything is moved: each round counts the exact rows and
bytes in the cells of a grid over the keys, and only cells that hold a cut (or
too many rows for one task) are probed again on a finer grid, until every cut
meets the tolerance. Then the rows are exchanged once, by final cell, and
numbered inside their cells; the counts give each cell its first slot.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, small, stored

STEP_BITS = 10
TOLERANCE = 0.01       # of a shard's bytes, at each cut
CELL_ROWS = 100_000    # rows that one task may number


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def copy_key(text: Column, *ties: Column) -> Column:
    """A 63-bit key under which equal texts are neighbours: 31 bits of the text's
    hash, then 32 bits of a hash of what tells copies apart."""
    high = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 33)
    return F.shiftleft(high, 32).bitwiseOR(F.xxhash64(*ties).bitwiseAND(F.lit(0xFFFFFFFF)))


def probe(keyed: DataFrame, key: str, size: str, n_shards: int, tolerance: float,
          cell_rows: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, list[int]]]]:
    """Final cells ``(low, rows, bytes)`` in key order, and the rounds: each a
    shift with the cells ``key >> shift`` that were refined after it (none after
    the last).

    A cell is refined while it holds a cut and more than ``tolerance`` of a
    shard's bytes, or more than ``cell_rows`` rows. The driver gets one row per
    cell: up to 1,024 (more when rows / cell_rows asks for it) in the first
    round and 1,024 per refined cell later; never a document.
    """
    got = keyed.agg(F.max(key), F.count(F.lit(1))).first()
    if not got[1]:
        return [], [(0, [])]
    shift = max(0, got[0].bit_length() - max(STEP_BITS, (4 * got[1] // cell_rows).bit_length()))
    done: list[tuple[int, int, int]] = []
    rounds: list[tuple[int, list[int]]] = []
    parents, total, cuts = None, 0, []
    while True:
        cur = keyed.select(key, size)
        if parents is not None:
            cur = cur.filter(F.shiftright(key, rounds[-1][0]).isin(parents))
        found = sorted((r["cell"] << shift, r["n"], r["b"]) for r in cur.groupBy(
            F.shiftright(key, shift).alias("cell")).agg(
                F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).collect())
        if parents is None:
            total = sum(b for _, _, b in found)
            cuts = [total * i // n_shards for i in range(1, n_shards)]
        cells = sorted(done + found)
        ends = dict(zip((c[0] for c in cells), accumulate(c[2] for c in cells), strict=True))
        new = {c[0] for c in found}
        parents = [low >> shift for low, n, b in cells if low in new and shift and n > 1 and (
            n > cell_rows or b > tolerance * total / n_shards
            and bisect_right(cuts, ends[low] - b) != bisect_right(cuts, ends[low] - 1))]
        if not parents:
            return cells, [*rounds, (shift, [])]
        again = set(parents)
        done = [c for c in cells if not (c[0] in new and c[0] >> shift in again)]
        rounds.append((shift, parents))
        shift = max(0, shift - STEP_BITS)


def shard(df: DataFrame, key: Column, size: Column, n_shards: int = 8,
          tolerance: float = TOLERANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Add ``shard`` (0 to ``n_shards`` - 1, contiguous ranges of ``key``) and
    ``slot`` (place in the shard in key order, without gaps from 0).

    ``key`` is an integer of at least 0; rows of one key are ordered as it
    happens, but each gets its own slot, and a key that holds more rows than a
    task or a shard should is not cut: give a key that tells copies apart. The
    shards' bytes differ by at most ``tolerance`` of a shard at each cut, or by
    the rows of one key. An empty table stays empty; null keys count as 0. Raises
    ``ValueError`` if ``df`` has columns ``shard`` or ``slot``.
    """
    if clash := {c.lower() for c in df.columns} & {"shard", "slot"}:
        raise ValueError(f"columns {sorted(clash)} exist")
    k, b, cell, low, first = fresh(df, "key_", "size_", "cell_", "low_", "first_")
    keyed = stored(df.withColumns({k: F.coalesce(key.cast("long"), F.lit(0).cast("long")), b: size}))
    cells, rounds = probe(keyed, k, b, n_shards, tolerance, cell_rows)
    total = sum(c[2] for c in cells)
    rows, begin, taken = [], 0, [0] * n_shards
    for lo, n, bytes_ in cells:
        s = min(n_shards - 1, (2 * begin + bytes_) * n_shards // (2 * total))
        rows.append((lo, s, taken[s]))
        taken[s] += n
        begin += bytes_
    spark = df.sparkSession
    cell_of = F.lit(None)
    for s, refined in reversed(rounds):
        here = F.shiftleft(F.shiftright(k, s), s)
        cell_of = F.when(F.shiftright(k, s).isin(refined), cell_of).otherwise(here) if refined else here
    table = small(spark.createDataFrame(rows, f"{low} long, shard int, {first} long"), 500_000)
    placed = keyed.withColumn(cell, cell_of).join(table, F.col(cell) == F.col(low))
    by = W.partitionBy(cell).orderBy(k)
    return placed.withColumn("slot", F.col(first) + F.row_number().over(by) - 1).select(
        *[f"`{c}`" for c in df.columns], "shard", "slot")


def op7_sharding(docs: DataFrame) -> DataFrame:
    """The result of the query over ``documents``: 8 shards of near equal bytes,
    equal texts next to each other."""
    t = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text_size(F.col("text")).alias("size"), F.crc32(t).alias("text_crc32"),
                    copy_key(F.col("text"), F.col("doc_id"), F.monotonically_increasing_id()).alias("key"))
    out = shard(d, F.col("key"), F.col("size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
