"""Operator 6, near duplicates of embeddings by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard
transform; its hash is the axis (and sign) it then lies closest to. A bucket joins
``k`` hashes of one table; besides its own bucket a vector goes to those where the
nearest or second axis changes at least loss (multiprobe). Vectors that share a
bucket and a label are compared by cosine in double precision.

How many tables reach the wanted recall is measured once, on synthetic pairs at
exactly the threshold; closer pairs are found more surely.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import Forest, components, dealt, in_tiles, joined_by_size, pairs, whole_runs

COSINE = 0.93
RECALL = 0.995
PROBES = 4
MAX_TABLES = 256       # more are not tried; fewer hashes a table are
MAX_HASHES = 6         # of a table; probes are chosen among all 2 ** that
CROWD = 0.1            # unrelated vectors of one label that share a bucket, about;
WIDE = 32              # from so many dimensions on: narrower ones have too few axes
TILE = 1024
ROWS = 1024            # vectors rotated at once, so that they stay in the processor's cache


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised fast Walsh-Hadamard transform of the columns (height a power of 2).
    With a vector a column, each sum runs over whole rows of memory."""
    d, n = x.shape
    x, other = x.copy(), np.empty_like(x)
    h = 1
    while h < d:
        a, b = x.reshape(d // (2 * h), 2, h, n), other.reshape(d // (2 * h), 2, h, n)
        np.add(a[:, 0], a[:, 1], out=b[:, 0])
        np.subtract(a[:, 0], a[:, 1], out=b[:, 1])
        x, other = other, x
        h *= 2
    return x / np.float32(math.sqrt(d))


@dataclass(frozen=True)
class Hashing:
    dim: int
    k: int
    tables: int
    probes: int = PROBES
    seed: int = 11

    def buckets(self, x: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Bucket ids (n, tables, probes) of unit vectors; ``salt`` keeps labels apart."""
        width = 1 << max(1, (self.dim - 1).bit_length())
        rng = np.random.default_rng(self.seed)
        signs = [[[rng.choice(np.array([-1, 1], "f4"), (width, 1)) for _ in range(3)] for _ in range(self.k)] for _ in range(self.tables)]
        out = np.empty((len(x), self.tables, self.probes), np.int64)
        for a in range(0, len(x), ROWS):
            padded = np.zeros((width, len(x[a:a + ROWS])), "f4")
            padded[:self.dim] = x[a:a + ROWS].T
            out[a:a + ROWS] = self._buckets(padded, salt[a:a + ROWS], signs)
        return out

    def _buckets(self, padded: np.ndarray, salt: np.ndarray, signs: list) -> np.ndarray:
        width, n = padded.shape
        rows = np.arange(n)
        # the cheapest choices of first (0) or second (1) axis in each of the k hashes
        choices = [tuple(int(b) for b in f"{c:0{self.k}b}") for c in range(1 << self.k)]
        out = np.empty((n, self.tables, self.probes), np.int64)
        with np.errstate(over="ignore"):
            for t in range(self.tables):
                axis, loss = [], []
                for rounds in signs[t]:
                    y = padded
                    for sign in rounds:
                        y = hadamard(y * sign)
                    y = np.ascontiguousarray(y.T)
                    size = np.abs(y)
                    first = size.argmax(axis=1)
                    top = size[rows, first]
                    size[rows, first] = -1
                    second = size.argmax(axis=1)
                    axis.append([2 * a + (y[rows, a] > 0) for a in (first, second)])
                    loss.append((top - size[rows, second]) ** 2)
                cost = np.stack([sum((loss[i] for i in range(self.k) if c[i]), np.zeros(n)) for c in choices])
                order = np.argsort(cost, axis=0, kind="stable")[: self.probes]
                codes = np.zeros((len(choices), n), np.uint64)
                for c, choice in enumerate(choices):
                    for i in range(self.k):
                        codes[c] = codes[c] * np.uint64(2 * width + 1) + axis[i][choice[i]].astype(np.uint64)
                    z = codes[c] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t + 1) * np.uint64(0xBF58476D1CE4E5B9)
                    z ^= salt.astype(np.int64).view(np.uint64)
                    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    codes[c] = z ^ (z >> np.uint64(31))
                for p in range(self.probes):
                    out[:, t, p] = codes[order[p], rows].view(np.int64)
        return out


def hashing_for(dim: int, vectors: int, cosine: float = COSINE, recall: float = RECALL, crowd: float = 100) -> Hashing:
    """``k``, at least 2, is such that about ``crowd`` unrelated vectors of one label
    share a bucket; ``tables`` is measured on 3,000 pairs. Where
    ``MAX_TABLES`` miss the recall, ``k`` is lowered, which makes buckets larger;
    raises ``ValueError`` when they miss it with 2 hashes as well."""
    k = min(MAX_HASHES, max(2, math.ceil(math.log(max(vectors, 2) / crowd) / math.log(2 * max(dim, 2)))))
    rng = np.random.default_rng(5)
    a = rng.normal(size=(3000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    if dim == 1:
        return Hashing(dim, k, 1)
    b = rng.normal(size=(3000, dim))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = cosine * a + math.sqrt(1 - cosine ** 2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    tables = 4
    while True:
        h = Hashing(dim, k, tables)
        zero = np.zeros(3000, np.int64)
        p, q = h.buckets(a, zero), h.buckets(b, zero)
        met = (p[:, :, :, None] == q[:, :, None, :]).any(axis=(1, 2, 3)).mean()
        if met >= recall:
            return h
        tables += 2 if tables < 16 else 4
        if tables > MAX_TABLES:
            if k == 2:
                raise ValueError(f"recall {met:.4f} instead of {recall} with {MAX_TABLES} tables")
            k, tables = k - 1, 4


def _unit(col: pd.Series) -> np.ndarray:
    x = np.stack(col.to_numpy()).astype("f8")
    return x / np.abs(x).max(axis=1, keepdims=True)  # lengths neither overflow nor vanish


def digests(buckets: np.ndarray) -> np.ndarray:
    """The first 32 bits of bucket ids: by them a pair is told its first shared bucket."""
    return (buckets.view(np.uint64) >> np.uint64(32)).astype(np.uint32)


def _assign(h: Hashing):
    """Per node its buckets, worked out once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _unit(pdf["vec"])
                b = h.buckets(x / np.linalg.norm(x, axis=1, keepdims=True), pdf["salt"].to_numpy())
                yield pdf.drop(columns="salt").assign(
                    buckets=[np.unique(r) for r in b.reshape(len(pdf), -1)], own=[d.tobytes() for d in digests(b)])
    return run


def _link(h: Hashing, cosine: float):
    """Links of the tile pairs: per node the copies linked, and forest edges."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, runs in whole_runs(batches):
            x = _unit(pdf["vec"])
            norm = np.linalg.norm(x, axis=1)
            node, copies = pdf["node"].to_numpy(), pdf["copies"].to_numpy()
            here = digests(pdf["bucket"].to_numpy())
            own = np.frombuffer(b"".join(pdf["own"]), np.uint32).reshape(len(pdf), h.tables, h.probes)
            links, trees = np.zeros(len(pdf)), Forest(len(pdf))
            for i, j in pairs(runs, pdf["side"].to_numpy(), (pdf["ta"] == pdf["tb"]).to_numpy()):
                near = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= cosine
                i, j = i[near], j[near]
                if not len(i):
                    continue
                # a pair counts in the first table they share, there in the least bucket
                met = (own[i][:, :, :, None] == own[j][:, :, None, :]).any(axis=3)
                table = met.any(axis=2).argmax(axis=1)
                rows = np.arange(len(i))
                least = np.where(met[rows, table], own[i][rows, table], np.iinfo(np.uint32).max).min(axis=1)
                first = least == here[i]
                i, j = i[first], j[first]
                links += np.bincount(i, copies[j], len(pdf)) + np.bincount(j, copies[i], len(pdf))
                trees.add(i, j)
            a, b = trees.edges(node)
            keep = links > 0
            yield pd.DataFrame({"a": np.concatenate([node[keep], a]), "b": np.concatenate([node[keep], b]),
                                "links": np.concatenate([links[keep], np.zeros(len(a))]).astype("int64")})
    return run


def near_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                 cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """One row ``(vec_id, n_links, component_id, kept)`` per row of ``df``.

    Rows of equal labels link when their cosine is at least ``cosine``. A null
    label, and a vector that is null, empty, zero or holds a null or non-finite
    component, links with nothing; so do vectors of different length. Equal
    vectors are one node and count as links of each other; rows with the same id
    are rows of their own. ``component_id`` is the least id of the component,
    ``kept`` whether it is the row's own; a null id is never least unless alone
    with nulls, and then kept. Each link counts once, whatever buckets share it.
    Only nodes travel, never pairs. An empty table gives an empty result.
    """
    v = F.col(f"`{vector}`")
    if df.schema[vector].dataType.simpleString() not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    ok = F.col(f"`{label}`").isNotNull() & (F.size(v) > 0) & ~F.exists(
        v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{vec_id}`").alias("id"),
                     F.when(ok, F.xxhash64(F.lit(3), F.col(f"`{label}`"), F.size(v))).alias("salt"),
                     F.when(ok, v).alias("vec"))
    # copies share both hashes
    rows = stored(rows.withColumns({"c1": F.when(F.col("salt").isNotNull(), F.xxhash64("salt", "vec")),
                                    "c2": F.when(F.col("salt").isNotNull(), F.xxhash64(F.lit(9), "vec", "salt"))}))
    nodes = stored(rows.filter("c1 IS NOT NULL").groupBy("c1", "c2").agg(
        F.min("rid").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"),
        F.first("salt").alias("salt"), F.first("vec").alias("vec")))
    shapes = nodes.groupBy("salt", F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(
        F.max("n").alias("n")).collect()  # a row per length of vectors
    found = None
    for s in shapes:
        h = hashing_for(s["dim"], s["n"], cosine, recall, *([CROWD] if s["dim"] >= WIDE else []))
        part = nodes.filter(F.size("vec") == s["dim"]).select("node", "salt", "vec", "copies")
        vec = part.schema["vec"].dataType.simpleString()
        part = stored(part.mapInPandas(_assign(h), f"node long, vec {vec}, copies long, buckets array<long>, own binary"))
        member = part.select("node", F.explode("buckets").alias("bucket"))
        tiles = dealt(in_tiles(member, TILE).join(part.drop("buckets"), "node"))
        got = tiles.mapInPandas(_link(h, cosine), "a long, b long, links long")
        found = got if found is None else found.union(got)
    spark = df.sparkSession
    found = stored(found) if found is not None else spark.createDataFrame([], "a long, b long, links long")
    links = found.filter("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(found.select("a", "b"))
    n = nodes.select("c1", "c2", "node", "copies", "least").join(links.withColumnRenamed("a", "node"), "node", "left")
    n = n.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    n = stored(n)
    least = n.groupBy("root").agg(F.min("least").alias("component"))
    n = stored(n.join(least, "root").select("c1", "c2", "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    out = joined_by_size(rows.select("id", "c1", "c2"), n, ["c1", "c2"], "left")
    comp = F.when(F.col("c1").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))


def op6_vectors(embeddings: DataFrame) -> DataFrame:
    """The result of the query over ``embeddings``."""
    return near_vectors(embeddings)
