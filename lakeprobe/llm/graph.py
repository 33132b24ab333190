"""Groups of candidates in tiles, and connected components.

A bucket of candidates may hold a third of all rows. It is never put into one
task and its pairs are never emitted: rows are salted into tiles of bounded
size, each pair of tiles is a task's work of its own, and a task returns counts
per row and a spanning forest of the links it found, at most one edge per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored


def in_tiles(members: DataFrame, tile: int) -> DataFrame:
    """``members`` is ``(bucket, node)`` with distinct rows. Returns ``(bucket, node,
    side, ta, tb)`` for buckets of two nodes or more: one row for each tile pair
    that the node takes part in. Over ``tile`` nodes are split by a hash of the
    node into sides of about that many; nodes meet in the tile pair of their sides.
    """
    counts = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    m = members.join(counts, "bucket")
    sides = F.ceil(F.col("n") / tile).cast("int")
    m = m.withColumn("side", F.pmod(F.xxhash64("node", F.lit(5)), sides).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), sides - 1)))
    return m.select("bucket", "node", "side", F.least("side", "other").alias("ta"), F.greatest("side", "other").alias("tb"))


def dealt(tiles: DataFrame) -> DataFrame:
    """One tile pair's rows together and in a row."""
    return tiles.repartition("bucket", "ta", "tb").sortWithinPartitions("bucket", "ta", "tb", "node")


def whole_runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches cut so that no tile pair is split, with the run number of each row."""
    keys, rest = ["bucket", "ta", "tb"], None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        k = [pdf[c].to_numpy() for c in keys]
        new = np.ones(len(pdf), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in k])
        cut = int(np.flatnonzero(new)[-1]) if len(pdf) else 0
        rest = pdf.iloc[cut:]
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True), np.cumsum(new[:cut])
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True), np.ones(len(rest), np.int64)


def pairs(run: np.ndarray, side: np.ndarray, diagonal: np.ndarray, most: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one run, some ``most`` at a time: all where the tile pair
    is a tile with itself (``diagonal``), else those of different sides."""
    n = len(run)
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if n else np.zeros(0, int)
    start = np.repeat(starts, np.diff(np.r_[starts, n]))
    before = np.arange(n) - start
    ends = np.cumsum(before)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        rows = np.arange(a, b)
        i = np.repeat(rows, before[a:b])
        j = start[i] + np.arange(len(i)) - np.repeat(np.cumsum(before[a:b]) - before[a:b], before[a:b])
        use = diagonal[i] | (side[i] != side[j])
        if use.any():
            yield i[use], j[use]
        a = b


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Label of each of n rows: the first row it is linked with by the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


class Forest:
    """A spanning forest grown from batches of pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        rows = np.arange(len(self.label))
        self.label = forest(np.concatenate([i, rows]), np.concatenate([j, self.label]), len(rows))

    def edges(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.label != np.arange(len(self.label))
        return node[own], node[self.label[own]]


def components(edges: DataFrame, most_rounds: int = 60, broadcast_rows: int = 200_000) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``; the root is the
    smallest node of the component. Alternates large-star and small-star steps
    until nothing changes; each step is a grouped minimum and a join, so a hub
    is summed before it is shuffled, and each round is written down. The minima
    are broadcast while there are at most ``broadcast_rows`` edges, as counted."""
    cur = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    sign = state(cur)
    for _ in range(most_rounds):
        hint = F.broadcast if sign[0] <= broadcast_rows else (lambda d: d)
        # large star: of each node, the larger neighbours go to its least neighbour
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(hint(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a <> b").distinct())
        # small star: the node and its smaller neighbours go to the least of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(hint(least), "a")
        cur = stored(star.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            star.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        now = state(cur)
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def joined_by_size(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a stored table of id-sized rows, by broadcast if it is small."""
    return left.join(small(right), on, how)
