"""Operator 10, mixing sources to target weights by Pfair scheduling.

Each source's bytes are cut into blocks in a shuffled order. With a weight of
n / Q, block j of a source (from 0) may start at slot floor(j Q / n) and must be
done by slot ceil((j + 1) Q / n); one block runs per slot and the earliest
deadline goes first. At any slot every source is then less than one block away
from its share. n and Q are the target weights as whole numbers, without rounding.

The driver makes the schedule of all blocks from the byte counts of the sources: one
step a block, and blocks are so large that there are at most ``MAX_BLOCKS`` of them and
one more a source, whatever the bytes. Every row finds its slot by a join on its block.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, scratch, small, stored
from .sharding import text_size

BLOCK_BYTES = 1 << 16    # bytes of a block, doubled until there are few enough blocks
MAX_BLOCKS = 2_000_000   # of all sources together, but for one more each
ALPHA = 0.7              # default target: bytes of the source to this power
MAX_SOURCES = 1_000_000  # more raise an error
BUCKET_ROWS = 2_000      # rows of a source that one task orders
PIECE = 500_000          # blocks of the schedule that the driver holds at once
BROADCAST = 2_000_000    # blocks that are joined by broadcast (16 bytes each)


def block_size(total: int, least: int = BLOCK_BYTES, most: int = MAX_BLOCKS) -> int:
    """``least``, doubled until ``total`` bytes are at most ``most`` blocks."""
    while total > most * least:
        least *= 2
    return least


def exact_units(weights: Mapping) -> dict:
    """The positive weights as whole numbers in the same proportions."""
    pos = {s: Fraction(w) for s, w in weights.items() if w > 0}
    common = math.lcm(*(w.denominator for w in pos.values()))
    return {s: int(w * common) for s, w in pos.items()}


def pfair(units: Mapping, blocks: Mapping) -> Iterator[tuple]:
    """``(slot, source, block)`` by earliest deadline first, in the order of slots.
    The first slot whose source has no block left comes with the block number
    ``blocks[source]``; from there on the sources that have run out are left out
    and the blocks of the others stay inside their windows."""
    names = sorted(units, key=str)
    q, n, last = sum(units.values()), [units[s] for s in names], [blocks[s] for s in names]
    waiting, ready = [(0, i, 0) for i in range(len(names))], []
    t, short = 0, False
    while waiting or ready:
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * q // n[i]), i, j))
        if not ready:
            t = waiting[0][0]
            continue
        deadline, i, j = heapq.heappop(ready)
        if j == last[i]:
            if short:
                continue
            short = True
        if deadline <= t:
            raise AssertionError("a deadline is missed")
        yield t, names[i], j
        if j < last[i]:
            heapq.heappush(waiting, ((j + 1) * q // n[i], i, j + 1))
        t += 1


def _schedule(spark, units: Mapping, blocks: Mapping, place: Mapping) -> tuple[DataFrame, int, int]:
    """The stored schedule ``(block_key, slot)``, its number of rows, and the first
    slot that a source cannot fill. The key is ``place`` of the source * 2^40 + block."""
    path, rows, horizon = scratch(spark), 0, None
    keys, slots = [], []

    def write():
        table = pa.table({"block_key": pa.array(keys, pa.int64()), "slot": pa.array(slots, pa.int64())})
        spark.createDataFrame(table).write.mode("append").option("compression", "zstd").parquet(path)
        keys.clear()
        slots.clear()

    for t, s, j in pfair(units, {s: max(1, n) for s, n in blocks.items()}):
        if horizon is None and j == blocks[s]:
            horizon = t
        if j < max(1, blocks[s]):
            keys.append((place[s] << 40) + j)
            slots.append(t)
            rows += 1
        if len(keys) == PIECE:
            write()
    if keys or not rows:
        write()
    return spark.read.schema("block_key long, slot long").parquet(path), rows, horizon or 0


def mix(df: DataFrame, source: str = "source", size: Column | None = None,
        weights: Mapping | None = None, block_bytes: int | None = None, seed: int = 0) -> DataFrame:
    """Add ``mix_slot`` (the slot of the row's block), ``mix_offset`` (first byte
    of the row in its source) and ``in_mix``; reading rows by the first two is the mix.

    ``weights`` maps sources to target weights, by default the bytes of each
    source to the power 0.7. ``block_bytes`` is by default ``block_size`` of all bytes:
    64 KB up to 131 GB, then larger, 64 MB at 100 TB. All rows stay. ``in_mix`` is true up to the slot that
    some source can no longer fill; before it, each source is less than one block
    away from its exact weight at every slot, however long the mix. Later blocks
    keep to the windows of their weights, and the slots of sources that have run
    out are left empty or go to blocks that may start. Rows of sources without a
    positive weight have a null slot and are not in the mix.

    The order within a source is a hash of the row's columns and ``seed``, so it does
    not depend on files or partitions; only rows that are equal in all columns (maps
    aside) may change places, and rows whose hash falls beside some thousands of such
    ones. A null source is a source of its own; repeated rows are rows of their own; a
    row over many blocks takes the slot of its first byte and the next row starts after
    it. An empty table stays empty. Raises ``ValueError`` for clashing column names or
    more than ``MAX_SOURCES`` sources.
    """
    new = ("mix_slot", "mix_offset", "in_mix")
    if clash := {c.lower() for c in df.columns} & set(new):
        raise ValueError(f"columns {sorted(clash)} exist")
    b, k, no, bucket, before, src, base, slot_key, n, sub, parts = fresh(
        df, "size_", "key_", "no_", "bucket_", "before_", "src_", "base_", "slot_key_", "n_", "sub_", "parts_")
    size = text_size(F.col("text")) if size is None else size
    named = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("n"))
    cur = df.withColumns({b: size.cast("long"), src: named, no: F.monotonically_increasing_id()})
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    cur = stored(cur.withColumn(k, F.shiftrightunsigned(F.xxhash64(F.lit(seed), *plain), 1)))
    totals = cur.groupBy(src).agg(F.sum(b).alias("bytes"), F.count(F.lit(1)).alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    bytes_of = {r[src]: r["bytes"] for r in totals}
    if weights is None:
        target = {s: v ** ALPHA for s, v in bytes_of.items()}
    else:
        named_w = {"n" if s is None else f"s{s}": w for s, w in weights.items()}
        target = {s: named_w.get(s, 0) for s in bytes_of}
    units = exact_units(target)
    block_bytes = block_size(sum(bytes_of[s] for s in units)) if block_bytes is None else block_bytes
    blocks = {s: (bytes_of[s] - 1) // block_bytes + 1 for s in units}
    place = {s: i for i, s in enumerate(sorted(units))}
    spark = df.sparkSession
    table, n_blocks, horizon = _schedule(spark, units, blocks, place)
    bits = max(0, (max((r["rows"] for r in totals), default=0) // BUCKET_ROWS).bit_length())
    cur = cur.withColumn(bucket, F.shiftright(k, 63 - bits).cast("int"))
    sums = stored(cur.groupBy(src, bucket).agg(F.sum(b).alias(before), F.count(F.lit(1)).alias(parts)))
    # a bucket is only so full when rows are equal: it is dealt over parts
    full = sums.filter(F.col(parts) > 4 * BUCKET_ROWS).select(src, bucket, F.ceil(F.col(parts) / BUCKET_ROWS).cast("int").alias(parts))
    if full.isEmpty():
        cur, sums = cur.withColumn(sub, F.lit(0)), sums.drop(parts).withColumn(sub, F.lit(0))
    else:
        part = F.when(F.col(parts).isNotNull(), F.pmod(F.xxhash64(k, no), F.col(parts))).otherwise(0)
        cur = cur.join(small(full, 100_000), [src, bucket], "left").withColumn(sub, part.cast("int")).drop(parts)
        sums = stored(cur.groupBy(src, bucket, sub).agg(F.sum(b).alias(before)))
    run = W.partitionBy(src).orderBy(bucket, sub).rowsBetween(W.unboundedPreceding, -1)
    sums = stored(sums.withColumn(before, F.coalesce(F.sum(before).over(run), F.lit(0))))
    plan = spark.createDataFrame([(s, place[s] << 40, max(0, blocks[s] - 1)) for s in units], f"{src} string, {base} long, {n} long")
    starts = small(sums.join(F.broadcast(plan), src, "left"), 100_000)  # a row for each source, at most MAX_SOURCES
    cur = cur.join(starts, [src, bucket, sub])
    inside = W.partitionBy(src, bucket, sub).orderBy(k, no).rowsBetween(W.unboundedPreceding, -1)
    cur = cur.withColumn("mix_offset", F.col(before) + F.coalesce(F.sum(b).over(inside), F.lit(0)))
    block = F.least(F.floor(F.col("mix_offset") / block_bytes), F.col(n))  # rows without bytes may stand at the very end
    table = table.select(F.col("block_key").alias(slot_key), F.col("slot").alias("mix_slot"))
    table = F.broadcast(table) if n_blocks <= BROADCAST else table
    cur = cur.withColumn(slot_key, F.when(F.col(n).isNotNull(), F.col(base) + block)).join(table, slot_key, "left")
    cur = cur.withColumn("in_mix", F.coalesce(F.col("mix_slot") < horizon, F.lit(False)))
    return cur.select(*[f"`{c}`" for c in df.columns], *new)


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows in the order of the mix across partitions; unmixed ones at the end."""
    last = F.coalesce("mix_slot", F.lit((1 << 63) - 1))
    return mixed.repartitionByRange(last, F.col("mix_offset")).sortWithinPartitions(last, F.col("mix_offset"))


def op10_mixing(docs: DataFrame) -> DataFrame:
    """Place of every row of ``documents`` in the mix of its sources."""
    d = docs.select("doc_id", "source", text_size(F.col("text")).alias("size"))
    return mix(d, size=F.col("size"))
