"""Operator 3, n-gram Jaccard join by a MinHash LSH forest.

A document is its set of five-word shingles (lower case, split at white space).
Documents with the same set are one node. A node's signature is a path of ``DEPTH``
minima in each of ``TREES`` prefix tries. In a trie, sorted by path, neighbours share
the longest prefixes: nodes meet first where their whole paths agree, then, as the
matched prefix is shortened level by level, where less of them does. How short it must
become is measured (``shortest_prefix``): until pairs at just the threshold meet with
the target recall. A pair belongs to the trie in which its common prefix is longest.

Pairs that meet are judged by their whole signatures first, well below the threshold.
Only nodes of pairs that pass come back, to the tiles in which they met, with their exact
shingle sets, and only these pairs are verified. Both steps run in tiles of bounded size
(``graph.py``): per document counts and forest edges come out, never the pairs, and
components are made of verified links alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored
from .graph import Forest, components, in_tiles, joined_by_size, pairs, whole_runs

SIMILARITY = 0.8
WORDS = 5
TREES, DEPTH = 20, 8
RECALL = 0.999         # of pairs at just the threshold, as measured
SAMPLE = 10_000        # pairs it is measured on
SLACK = 0.15           # signatures may show this much less than the threshold
TILE = 512
TREE_BITS = 6          # of a bucket's number, for its trie: at most 64 of them
CACHE = 500_000        # word hashes, emptied when full
_MIX = np.array([3, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class Shingles:
    """Hashed shingle sets of texts."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        """Sorted 64-bit hashes; a text of fewer than five words is one shingle,
        a text without words has none."""
        w = (text or "").lower().split()
        if not w:
            return np.zeros(0, np.uint64)
        if len(self.known) >= CACHE:
            self.known.clear()
        for x in set(w).difference(self.known):
            self.known[x] = xxhash.xxh64_intdigest(x)
        h = np.array([self.known[x] for x in w], np.uint64)
        n = min(WORDS, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                out = (out ^ h[i:i + len(out)]) * _MIX[i]
                out ^= out >> np.uint64(29)
        return np.unique(out)


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(23)
    return (rng.integers(0, 1 << 32, count, np.uint32),
            rng.integers(0, 1 << 32, count, np.uint32) | np.uint32(1))


def minima(s: np.ndarray, c: np.ndarray, a: np.ndarray) -> np.ndarray:
    """MinHash signature of a set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 1024):
            np.minimum(best, ((x[i:i + 1024, None] ^ c) * a).min(axis=0), out=best)
    return best


def paths(m: np.ndarray) -> np.ndarray:
    """A path digit of each minimum: eight mixed bits, so that a path is its bytes."""
    with np.errstate(over="ignore"):
        return ((m ^ (m >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)


def _common_prefix(same: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix in each trie, from the agreement of all digits."""
    return np.cumprod(same.reshape(len(same), -1, depth), axis=2, dtype=np.uint8).sum(axis=2)


@functools.cache
def shortest_prefix(similarity: float, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """How far matched prefixes must be shortened: from whole paths down until the
    wanted share of ``SAMPLE`` pairs of sets, at just the similarity, meets in some
    trie. One digit if nothing reaches it."""
    rng = np.random.default_rng(41)
    shared = 90
    apart = max(0, round(shared * (1 - similarity) / similarity / 2))
    c, a = _functions(trees * depth)
    found = np.zeros(SAMPLE, int)
    for i in range(SAMPLE):
        x = rng.integers(0, 1 << 63, shared + 2 * apart, np.uint64) << np.uint64(1)
        p, q = (paths(minima(s, c, a)) for s in (x[:shared + apart], np.r_[x[:shared], x[shared + apart:]]))
        found[i] = _common_prefix((p == q)[None, :], depth).max()
    for level in range(depth, 0, -1):
        if (found >= level).mean() >= recall:
            return level
    return 1


def _sketch(prefix: int, trees: int, depth: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, (c, a) = Shingles(), _functions(depth * trees)
        for pdf in batches:
            out = {k: [] for k in ("c1", "c2", "size", "path", "buckets")}
            for t in pdf["text"]:
                s = sets.of(t)
                key = np.frombuffer(xxhash.xxh128_digest(s.tobytes()), np.int64)
                path = paths(minima(s, c, a)).reshape(trees, depth)
                out["c1"].append(int(key[0]))
                out["c2"].append(int(key[1]))
                out["size"].append(len(s))
                out["path"].append(path.tobytes())
                # a bucket is the part of a trie below a shortest prefix
                out["buckets"].append([((xxhash.xxh64_intdigest(path[i, :prefix].tobytes(), i) >> (TREE_BITS + 1)) << TREE_BITS) + i
                                       for i in range(trees)])
            yield pd.DataFrame({"rid": pdf["rid"], "id": pdf["id"], **out})
    return run


def met(path: np.ndarray, tree: np.ndarray, run: np.ndarray, side: np.ndarray, diagonal: np.ndarray,
        prefix: int, depth: int, most: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one run, level by level: those whose whole paths in the run's
    trie agree, then, with each shortening, those that meet there. Rows are sorted by
    (run, path in the trie)."""
    n = len(run)
    own = path.reshape(n, -1, depth)[np.arange(n), tree]
    common = np.zeros(n, int)        # with the row before
    common[1:] = np.where(run[1:] == run[:-1], np.cumprod(own[1:] == own[:-1], axis=1).sum(axis=1), -1)
    deeper = np.arange(n)
    for level in range(depth, prefix - 1, -1):
        node = np.cumsum(np.r_[True, common[1:] < level]) if n else deeper
        for i, j in pairs(node, side, diagonal, most):
            new = deeper[i] != deeper[j]
            if new.any():
                yield i[new], j[new]
        deeper = node


def owned(pdf: pd.DataFrame, runs: np.ndarray, prefix: int, depth: int, least: float, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that meet in these tiles and belong there: their sizes allow the ratio,
    their signatures agree in ``least`` of all digits, and no trie has a longer common
    prefix of theirs, nor an earlier one as long."""
    path = np.frombuffer(b"".join(pdf["path"]), np.uint8).reshape(len(pdf), -1)
    tree, size = (pdf["bucket"].to_numpy() & ((1 << TREE_BITS) - 1)).astype(int), pdf["size"].to_numpy()
    for i, j in met(path, tree, runs, pdf["side"].to_numpy(), (pdf["ta"] == pdf["tb"]).to_numpy(), prefix, depth):
        fit = np.minimum(size[i], size[j]) >= ratio * np.maximum(size[i], size[j])
        i, j = i[fit], j[fit]
        same = path[i] == path[j]
        near = same.mean(axis=1) >= least
        i, j = i[near], j[near]
        if len(i):
            here = _common_prefix(same[near], depth).argmax(axis=1) == tree[i]
            yield i[here], j[here]


def _meet(prefix: int, depth: int, least: float, ratio: float):
    """The rows of each tile that are in a pair that belongs there."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, runs in whole_runs(batches):
            use = np.zeros(len(pdf), bool)
            for i, j in owned(pdf, runs, prefix, depth, least, ratio):
                use[i] = use[j] = True
            yield pdf.loc[use, ["bucket", "node", "side", "ta", "tb"]]
    return run


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sets = Shingles()
    for pdf in batches:
        yield pd.DataFrame({"node": pdf["node"], "shingles": [sets.of(t).tobytes() for t in pdf["text"]]})


def common_sizes(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], float)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = times > 1
    place = np.cumsum(shared) - 1
    use = shared[column]
    row, column = row[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n))
    for a in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        x = np.zeros((n, 4096), "f4")
        x[row[lo:hi], column[lo:hi] - a] = 1
        out += x @ x.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _verify(prefix: int, depth: int, least: float, similarity: float):
    """Links of the tiles by exact sets: per node the copies linked, and forest edges."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, runs in whole_runs(batches):
            node, copies, size = (pdf[c].to_numpy() for c in ("node", "copies", "size"))
            sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
            links, trees = np.zeros(len(pdf)), Forest(len(pdf))
            starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
            ends = np.r_[starts[1:], len(runs)]
            tables: dict[int, np.ndarray] = {}
            for i, j in owned(pdf, runs, prefix, depth, least, similarity):
                at = np.searchsorted(starts, i, "right") - 1
                both = np.empty(len(i))
                for k in np.unique(at):
                    use = at == k
                    lo, hi = int(starts[k]), int(ends[k])
                    if k not in tables and use.sum() > 4 * (hi - lo):   # many pairs: all at once
                        tables.clear()
                        tables[k] = common_sizes(sets[lo:hi])
                    if k in tables:
                        both[use] = tables[k][i[use] - lo, j[use] - lo]
                    else:
                        both[use] = [len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i[use], j[use])]
                near = both >= similarity * (size[i] + size[j] - both) - 1e-9
                i, j = i[near], j[near]
                if len(i):
                    links += np.bincount(i, copies[j], len(pdf)) + np.bincount(j, copies[i], len(pdf))
                    trees.add(i, j)
            a, b = trees.edges(node)
            keep = links > 0
            yield pd.DataFrame({"a": np.concatenate([node[keep], a]), "b": np.concatenate([node[keep], b]),
                                "links": np.concatenate([links[keep], np.zeros(len(a))]).astype("int64")})
    return run


def _tries(tiles: DataFrame, depth: int) -> DataFrame:
    """One tile's rows together, in the order of their paths in the bucket's trie."""
    at = (F.col("bucket").bitwiseAND((1 << TREE_BITS) - 1) * depth + 1).cast("int")
    return tiles.repartition("bucket", "ta", "tb").sortWithinPartitions("bucket", "ta", "tb", F.substring("path", at, F.lit(depth)), "node")


def signatures(rows: DataFrame, prefix: int, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """Stored, a row per text: the 128-bit hash and size of its set, its paths, and the
    buckets of its shortest prefixes."""
    return stored(rows.select("rid", "id", "text").mapInPandas(
        _sketch(prefix, trees, depth), f"rid long, id {rows.schema['id'].dataType.simpleString()}, c1 long, c2 long, "
        "size int, path binary, buckets array<long>"))


def meetings(nodes: DataFrame, prefix: int, similarity: float, depth: int = DEPTH) -> DataFrame:
    """Stored ``(bucket, node, side, ta, tb)``: the nodes (``node, size, path, buckets``)
    in the tiles that have a pair of theirs to verify."""
    tiles = in_tiles(nodes.select("node", F.explode("buckets").alias("bucket")), TILE)
    tiles = _tries(tiles.join(nodes.select("node", "size", "path"), "node"), depth)
    return stored(tiles.mapInPandas(_meet(prefix, depth, similarity - SLACK, similarity), "bucket long, node long, side int, ta int, tb int"))


def link_rows(rows: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL,
              trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """``rows`` is a stored table ``(rid, id, text)`` with distinct ``rid``. Returns
    a stored ``(rid, id, class_id, n_links, component_id, leader)``; ``leader`` is
    the ``rid`` that stands for the component: of its rows with the least id, the
    first. See ``jaccard_join`` for the meaning of the rest."""
    prefix, least = shortest_prefix(similarity, recall, trees, depth), similarity - SLACK
    sketch = signatures(rows, prefix, trees, depth)
    classes = stored(sketch.filter("size > 0").groupBy("c1", "c2").agg(
        F.min("rid").alias("node"), F.count(F.lit(1)).alias("copies"),
        F.min(F.struct(F.col("id").isNull(), "id", "rid")).alias("first")))
    nodes = stored(sketch.drop("id").join(classes.select("node", "copies"), F.col("rid") == F.col("node")).select(
        "node", "copies", "size", "path", "buckets"))
    tiles = meetings(nodes, prefix, similarity, depth)
    texts = rows.select(F.col("rid").alias("node"), "text").join(small(stored(tiles.select("node").distinct()), 300_000), "node")
    sets = stored(texts.mapInPandas(_sets, "node long, shingles binary"))
    tiles = tiles.join(nodes.select("node", "size", "path", "copies"), "node").join(sets, "node")
    found = stored(_tries(tiles, depth).mapInPandas(_verify(prefix, depth, least, similarity), "a long, b long, links long"))
    links = found.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = stored(components(found.select("a", "b")))
    n = classes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    n = stored(n)
    least_id = n.groupBy("root").agg(F.min("first").alias("lead"))
    n = stored(n.join(least_id, "root").select(
        "c1", "c2", F.col("first.id").alias("class_id"), F.col("lead.id").alias("component_id"),
        F.col("lead.rid").alias("leader"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    out = joined_by_size(sketch.select("rid", "id", "c1", "c2", "size"), n, ["c1", "c2"], "left")
    alone = F.col("size") == 0
    return stored(out.select(
        "rid", "id", F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("rid")).otherwise(F.col("leader")).alias("leader")))


def with_row_ids(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A stored ``(rid, id, text, rest)``; ``rest`` is a struct of all columns but
    the text, so no name can clash."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != text]
    return stored(df.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{doc_id}`").alias("id"),
                            F.col(f"`{text}`").alias("text"), F.struct(*rest).alias("rest")))


def jaccard_join(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row ``(doc_id, class_id, n_links, component_id, kept)`` per row.

    Two rows link when the Jaccard similarity of their five-word shingle sets is
    at least ``similarity``; a text of fewer words is one shingle, a text without
    words (null, empty) links with nothing. ``class_id`` is the least id among the
    rows with the same set, ``n_links`` the other rows linked directly (copies
    too), ``component_id`` the least id reachable by links. ``kept`` marks one row
    of each component. Null ids come after all others; rows with the same id are
    rows of their own. An empty table gives an empty result.
    """
    r = link_rows(with_row_ids(df.select(f"`{doc_id}`", f"`{text}`"), doc_id, text), similarity, recall)
    return r.select(F.col("id").alias("doc_id"), "class_id", "n_links", "component_id",
                    (F.col("rid") == F.col("leader")).alias("kept"))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each component of near duplicates, all columns."""
    rows = with_row_ids(df, doc_id, text)
    gone = link_rows(rows.select("rid", "id", "text")).filter("rid <> leader").select("rid")
    left = rows.join(small(gone, 500_000), "rid", "left_anti")
    return left.select(*[F.col("text").alias(c) if c == text else F.col("rest").getField(c).alias(c) for c in df.columns])


def op3_jaccard(docs: DataFrame) -> DataFrame:
    """The result of the query over ``documents``."""
    return jaccard_join(docs)
