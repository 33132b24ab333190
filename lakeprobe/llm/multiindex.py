"""Operator 12, nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised apart, each by its own centroids; a pair of
centroids is a cell, and every row lies in one. A query walks the pairs by summed
nearness of the halves (inner products add up over halves) with a heap, until the
cells it has met hold enough rows, and reranks the rows of these cells by the exact
measure.

How many rows are enough is measured, not guessed: for a bounded sample of queries the
true neighbours among all rows are found by brute force, and the effort is what finds
the wanted share of them. Cells are packed into blocks of bounded size; a cell of more
rows is dealt over several blocks, all of which its queries visit, so no bin has a cap.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_rows, small, stored

TOP, EVERY = 20, 20
RECALL = 0.95            # share of true neighbours that the measured effort finds
SAMPLE = 16_384          # rows that the centroids are fitted on, at most
QUERIES = 256            # queries whose true neighbours are found by brute force, at most
CELL_ROWS = 32           # rows a cell, about, which sets the number of centroids
MAX_CENTROIDS = 512      # of a half: bounds what is sent to tasks to this many squared
BLOCK = 4096             # rows, and queries, of one group of the rerank


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Centroids of the rows: at most ``k``, fewer if there are fewer rows."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = closest(x, centre)
        rows = np.bincount(own, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        centre = np.where(rows[:, None] > 0, total / np.maximum(rows, 1)[:, None], centre)
    return centre


def closest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre ** 2).sum(axis=1) - 2 * x @ centre.T).argmin(axis=1)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype("f8")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component on, so that equal
    vectors have equal products to the last bit."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


@dataclass(frozen=True)
class Index:
    first: np.ndarray        # centroids of the first half
    second: np.ndarray
    block: np.ndarray        # of each cell, its first block
    blocks: np.ndarray       # and how many it is dealt over
    rows: np.ndarray         # rows of each cell

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return closest(x[:, :self.half], self.first) * len(self.second) + closest(x[:, self.half:], self.second)

    def walk(self, q: np.ndarray, effort: int) -> list[int]:
        """Cells that hold rows, by summed nearness of their two centroids, until
        they hold ``effort`` rows. Each pair of ranks enters the heap once: by the
        pair before it in its row, or the pair above if it is first in its row."""
        a, b = self.first @ q[:self.half], self.second @ q[self.half:]
        by_a, by_b = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b, by_a, by_b = (-a[by_a]).tolist(), (-b[by_b]).tolist(), by_a.tolist(), by_b.tolist()
        heap, met, found, rows, wide = [(a[0] + b[0], 0, 0)], 0, [], self.rows, len(b)
        while heap and met < effort:
            _, i, j = heapq.heappop(heap)
            cell = by_a[i] * wide + by_b[j]
            if rows[cell]:
                found.append(cell)
                met += int(rows[cell])
            if j + 1 < wide:
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        return found


def pack(rows: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring cells share a block of at most ``size`` rows; a larger cell has
    blocks of its own."""
    first, many = np.zeros(len(rows), "i8"), np.ones(len(rows), "i8")
    at, fill = 0, 0
    for c, n in enumerate(rows.tolist()):
        if fill and fill + n > size:
            at, fill = at + 1, 0
        first[c], many[c] = at, max(1, -(-n // size))
        fill += n
        if many[c] > 1:
            at, fill = at + int(many[c]), 0
    return first, many


def _assign(first: np.ndarray, second: np.ndarray):
    index = Index(first, second, *[np.zeros(0, "i8")] * 3)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=index.cells(_matrix(pdf["vec"])).astype("i4"))
    return run


def _true_cells(queries: np.ndarray, own: np.ndarray, top: int):
    """Per task: the best rows of each sampled query, by brute force, with their cells."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in batches:
            if not len(pdf):
                continue
            s = queries @ _matrix(pdf["vec"]).T
            s[own[:, None] == pdf["rid"].to_numpy()[None, :]] = -np.inf
            at = np.argpartition(-s, min(top, s.shape[1]) - 1, axis=1)[:, :top]
            here = np.take_along_axis(s, at, axis=1), pdf["cell"].to_numpy()[at], pdf["rid"].to_numpy()[at]
            if best is not None:
                here = tuple(np.concatenate([u, w], axis=1) for u, w in zip(best, here))
                at = np.argsort(-here[0], axis=1, kind="stable")[:, :top]
                here = tuple(np.take_along_axis(u, at, axis=1) for u in here)
            best = here
        if best is not None:
            out = pd.DataFrame({"q": np.repeat(np.arange(len(queries)), best[0].shape[1]), "score": best[0].ravel(),
                                "cell": best[1].ravel(), "rid": best[2].ravel()})
            yield out[np.isfinite(out["score"])]
    return run


def effort_for(rows: DataFrame, index: Index, sample: pd.DataFrame, top: int, recall: float) -> int:
    """Rows to walk over so that ``recall`` of the true neighbours of the sampled
    queries lie in the cells walked."""
    if not len(sample):
        return 0
    q = _matrix(sample["vec"])
    each = rows.select("rid", "cell", "vec").mapInPandas(_true_cells(q, sample["rid"].to_numpy(), top), "q int, score double, cell int, rid long")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "rid")
    true = each.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).select("q", "cell").toPandas()
    if not len(true):
        return 0
    need = []
    for i, cells in true.groupby("q")["cell"]:
        a, b = index.first @ q[i, :index.half], index.second @ q[i, index.half:]
        order = np.argsort(-(a[:, None] + b[None, :]).ravel(), kind="stable")
        before = np.empty(len(order), "i8")
        before[order] = np.cumsum(index.rows[order]) - index.rows[order]
        need.append(before[cells.to_numpy()] + 1)
    need = np.sort(np.concatenate(need))
    return int(need[min(len(need) - 1, math.ceil(recall * len(need)) - 1)])


def _probe(index: Index, effort: int):
    """Of each query, one row per block that it visits, with the cells it walked."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 256):
                part = pdf.iloc[start:start + 256]
                out = []
                for rid, key, vec, x in zip(part["rid"], part["key"], part["vec"], _matrix(part["vec"])):
                    cells = np.array(index.walk(x, effort), "i8")
                    many = index.blocks[cells]
                    block = np.repeat(index.block[cells], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    cells = np.repeat(cells, many)
                    order = np.argsort(block, kind="stable")
                    block, cells = block[order], cells[order]
                    cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
                    out += [(rid, key, int(block[s]), c.astype("i4"), vec) for s, c in zip(cut, np.split(cells, cut[1:]))]
                yield pd.DataFrame(out, columns=["rid", "key", "block", "cells", "vec"])
    return run


def _rerank(top: int):
    """Of each query of a group, its best rows among the group's in cells it walked."""
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            x, rid, key, known = _matrix(rows["vec"]), *[rows[c].to_numpy() for c in ("rid", "key", "known")]
            cells, place = np.unique(rows["cell"].to_numpy(), return_inverse=True)
            near = 1e-9 * np.abs(x).max()
            for start in range(0, len(queries), 256):
                part = queries.iloc[start:start + 256]
                q = _matrix(part["vec"])
                walked = np.zeros((len(part), len(cells)), bool)
                for i, c in enumerate(part["cells"]):
                    walked[i, np.isin(cells, c)] = True
                s = q @ x.T
                s[~walked[:, place] | (part["rid"].to_numpy()[:, None] == rid[None, :])] = -np.inf
                least = np.partition(s, -top, axis=1)[:, -top] if s.shape[1] > top else np.full(len(part), -np.inf)
                # rows that rounding may have put on the wrong side stay until the exact score
                i, j = np.nonzero((s >= (least - near * np.abs(q).sum(axis=1))[:, None]) & (s > -np.inf))
                score = np.concatenate([products(q[i[a:a + 65536]], x[j[a:a + 65536]]) for a in range(0, len(i), 65536)] or [np.zeros(0)])
                order = np.lexsort((rid[j], key[j], ~known[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < top
                i, j = i[best], j[best]
                out.append(pd.DataFrame({"query": part["rid"].to_numpy()[i], "query_id": part["key"].to_numpy()[i], "rid": rid[j],
                                         "key": key[j], "known": known[j], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["query", "query_id", "rid", "key", "known", "score"])
    return run


def _search(rows: DataFrame, dim: int, top: int, every: int, recall: float, effort: int | None) -> DataFrame:
    """``(query, query_id, rid, key, known, score)`` of vectors of one length: the best
    of each block that a query visits."""
    half, vec = max(1, dim // 2), rows.schema["vec"].dataType.simpleString()
    sample = _matrix(bounded_rows(rows.select("vec"), SAMPLE)["vec"])
    k = 1 << max(0, round(math.log2(max(1.0, rows.count() / CELL_ROWS)) / 2))
    k = min(k, MAX_CENTROIDS)
    first, second = kmeans(sample[:, :half], k), kmeans(sample[:, half:], k)
    rows = stored(rows.mapInPandas(_assign(first, second), f"key long, known boolean, vec {vec}, rid long, cell int"))
    per_cell = np.zeros(len(first) * len(second), "i8")
    for r in rows.groupBy("cell").count().toLocalIterator():
        per_cell[r["cell"]] = r["count"]
    index = Index(first, second, *pack(per_cell), per_cell)
    queries = rows.filter(F.col("known") & (F.pmod("key", F.lit(every)) == 0))
    if effort is None:
        effort = effort_for(rows, index, bounded_rows(queries.select("rid", "vec"), QUERIES), top, recall)
    probes = stored(queries.select("rid", "key", "vec").mapInPandas(
        _probe(index, effort), f"rid long, key long, block long, cells array<int>, vec {vec}"))
    # a block with many queries is a group for each so many of them
    tiles = small(stored(probes.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("tiles"))))
    probes = probes.join(tiles, "block").withColumn("tile", F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int")).drop("tiles")
    block = index.block, index.blocks

    @F.pandas_udf("long")
    def block_of(cell: pd.Series, rid: pd.Series) -> pd.Series:
        c = cell.to_numpy()
        return pd.Series(block[0][c] + rid.to_numpy() % block[1][c])

    data = rows.withColumn("block", block_of("cell", "rid")).join(tiles, "block")
    data = data.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    found = probes.groupBy("block", "tile").cogroup(data.groupBy("block", "tile")).applyInPandas(
        _rerank(top), "query long, query_id long, rid long, key long, known boolean, score double")
    return stored(found)


def nearest_rows(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP, every: int = EVERY,
                 recall: float = RECALL, effort: int | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of each row whose id is divisible by
    ``every``, the ``top`` rows of largest inner product among the rows of its cells.

    All rows are indexed and all are candidates but the query's own row. Ranks begin
    at 1; equal scores go by id, null ids last. ``effort`` is the number of rows that
    the cells walked must hold; by default it is measured for ``recall``. A query whose
    cells hold fewer than ``top`` other rows returns those. Vectors that are null, empty,
    zero or hold null or non-finite components take no part, vectors of other lengths are
    no candidates of each other. Repeated ids are rows of their own, each a query
    of its own if divisible. Other columns are not read. An empty table gives an
    empty result.
    """
    spark = df.sparkSession
    v = F.col(f"`{vector}`")
    if df.schema[vector].dataType.simpleString() not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    c = F.col("vec")
    ok = c.isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(c, lambda x: x != 0)
    key = F.col(f"`{vec_id}`").cast("long")
    rows = stored(df.select(F.coalesce(key, F.lit(0)).alias("key"), key.isNotNull().alias("known"), v.alias("vec")).filter(ok)
                  .withColumn("rid", F.monotonically_increasing_id()))
    found = None
    for (dim,) in sorted(rows.select(F.size("vec")).distinct().collect()):  # a row per length of vectors
        got = _search(rows.filter(F.size("vec") == dim), dim, top, every, recall, effort)
        found = got if found is None else found.union(got)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("known"), "key", "rid")
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("known"), F.col("key")).alias("vec_id"), "score")


def op12_neighbours(embeddings: DataFrame) -> DataFrame:
    """The result of the query over ``embeddings``."""
    return nearest_rows(embeddings)
