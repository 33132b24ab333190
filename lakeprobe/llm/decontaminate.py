"""Operator 8, benchmark decontamination by SimHash windows.

Every window of a document gets a 64-bit SimHash of its words (a running sum per
bit, so a window costs the same whatever its length), for some window lengths in
classes a third apart: those of the items and of their parts. An item is looked up by
its first and last words of its class, by three windows of about 0.8 of it, and, from 45
words on, by windows of about a third of it, side by side (``prints_of``): an edit
that leaves four fifths of its shingles leaves one of these nearly as it was. The
fingerprints are indexed
in four blocks of 16 bits: two that differ in at most 7 bits agree in some block
up to one bit, so looking up every block with its one-bit neighbours finds all
fingerprints within that radius.

Besides, each item has anchors: its rarest shingles, more than a fifth of
them. A window that reaches 0.8 lacks at most a fifth of the item, by number or by
weight, so it holds an anchor, whatever the lengths. They find what rounding of a
fingerprint loses. Where either is met, all windows of the item's length around it are
measured: Jaccard
similarity of five-word shingles between the item and a window of its length,
plain or weighted, whichever is higher. With weights, a shingle that k different
item texts of the whole benchmark share weighs 1/k, and a shingle that only the
window holds weighs as much as the item's own do on average.

The benchmark is the fixed side: it is read in blocks of bounded size, each of which is
broadcast. One block is searched where the documents lie, in one projection; of more
blocks each has a pass of its own, and only what it finds is written and joined.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from itertools import chain, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small, stored

SIMILARITY = 0.8
SHINGLE = 5
RADIUS = 7             # bits, of 64
ITEMS = 20_000         # items per pass over the documents, at most,
ITEM_CHARS = 16 << 20  # and letters of their texts, unless one item alone has more
FOUND = 200_000        # items found that are joined by broadcast; more by a shuffle
SALTS = 16
SLICE = 8_192          # words whose windows are hashed at once
CACHE = 500_000        # words; the cache is emptied when it is full
PART = 1 << 18         # words whose shingles are looked up at once
_WORD = re.compile(r"\w+")
RESULT = "array<struct<item:int,start:int,similarity:double>>"


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(w: list[str]) -> set[tuple[str, ...]]:
    return {tuple(w[i:i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """64-bit hashes of the shingles of words with hashes ``h``, in order."""
    n = max(1, len(h) - SHINGLE + 1) if len(h) else 0
    out = np.full(n, min(len(h), SHINGLE), np.uint64)
    for i in range(min(len(h), SHINGLE)):
        out = (out ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class WordHashes:
    """64-bit hashes of words, kept up to a bound."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, w: list[str]) -> np.ndarray:
        try:
            return np.array([self.known[x] for x in w], np.uint64)
        except KeyError:
            if len(self.known) >= CACHE:
                self.known.clear()
            for x in set(w).difference(self.known):
                self.known[x] = xxhash.xxh64_intdigest(x)
            return np.array([self.known[x] for x in w], np.uint64)


def simhashes(h: np.ndarray, size: int, sums: np.ndarray | None = None) -> np.ndarray:
    """SimHash (n, 4) of 16-bit blocks, of every window of ``size`` words."""
    sums = running(h, size) if sums is None else sums
    bits = np.subtract(sums[size:], sums[:-size]) > size // 2
    return np.packbits(bits, axis=1).view(np.uint16)


def running(h: np.ndarray, size: int) -> np.ndarray:
    """Sums of each bit over the first i words, for i from 0. They wrap round, which
    leaves the differences over ``size`` words right."""
    kind = _kind(size)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(h) + 1, 64), kind)
    np.cumsum(bits, axis=0, dtype=kind, out=out[1:])
    return out


def _kind(size: int) -> type:
    """The smallest numbers that hold a sum over ``size`` words."""
    return np.uint8 if size < 1 << 8 else np.uint16 if size < 1 << 16 else np.uint32


def classes(lengths: set[int]) -> list[int]:
    """Window lengths: from the smallest on, each a third above the last or more."""
    out: list[int] = []
    for n in sorted(lengths):
        if not out or n >= out[-1] * 4 / 3:
            out.append(n)
    return out


WHOLE, PARTED = 8, 45    # words from which an item is looked up by less than all, by thirds


def window_lengths(lengths: set[int]) -> list[int]:
    """Classes of the lengths of items, of four fifths and of thirds of them."""
    parts = {math.ceil(0.7 * n) for n in lengths if n >= WHOLE} | {n // 3 for n in lengths if n >= PARTED}
    return classes(lengths | parts)


def prints_of(n: int, sizes: list[int]) -> set[tuple[int, int]]:
    """The windows ``(size, first word)`` by which an item of ``n`` words is looked up."""
    below = lambda most: max((s for s in sizes if s <= most), default=None)
    own = below(n)
    out = {(own, 0), (own, n - own)}
    if n >= WHOLE and (s := below(0.8 * n)):
        out |= {(s, 0), (s, (n - s) // 2), (s, n - s)}
    if n >= PARTED and (s := below(n // 3)):
        out |= {(s, min(a, n - s)) for a in range(0, n, s)}
    return out


class Index:
    """Fingerprints of the items of a block, by window length. ``shared`` tells, by
    the hash of a shingle, how many different texts of the whole benchmark hold it
    (where more than one does); by default the items are the whole benchmark."""

    def __init__(self, items: list[list[str]], shared: Mapping[int, int] | None = None):
        self.items = items
        self.hashes = WordHashes()
        self.shingles = [shingles(w) for w in items]
        self.held: dict[tuple[str, ...], int] = {}
        if shared is None:
            texts = {tuple(w): s for w, s in zip(items, self.shingles, strict=True)}
            self.held = {x: k for x, k in Counter(x for s in texts.values() for x in s).items() if k > 1}
        elif shared:
            for w in items:
                for i, x in enumerate(shingle_hashes(self.hashes.of(w)).tolist()):
                    if x in shared:
                        self.held[tuple(w[i:i + SHINGLE])] = shared[x]
        self.own = [math.fsum(1 / self.held.get(x, 1) for x in s) for s in self.shingles]
        self._set_anchors()
        sizes = window_lengths({len(w) for w in items if w})
        found: dict[int, list] = {size: [] for size in sizes}
        for i, w in enumerate(items):
            if w:
                h = self.hashes.of(w)
                for size, a in sorted(prints_of(len(w), sizes)):
                    found[size].append((i, a, simhashes(h[a:a + size], size)[0]))
        self.by_size: dict[int, tuple] = {
            size: (*map(np.array, list(zip(*rows))[:2]), *self._tables(np.array([r[2] for r in rows])))
            for size, rows in found.items() if rows}

    def _set_anchors(self):
        self.parts, keys, of = [], [np.zeros(0, np.uint64)], [np.zeros(0, int)]
        for i, w in enumerate(self.items):
            own, first = np.unique(shingle_hashes(self.hashes.of(w)), return_index=True)
            weight = np.array([1 / self.held.get(tuple(w[a:a + SHINGLE]), 1) for a in first.tolist()])
            self.parts.append((own, weight))
            if len(w) >= SHINGLE:  # shorter ones are found as they are or not at all
                rare = np.argsort(-weight, kind="stable")[:len(own) - math.ceil(SIMILARITY * len(own) - 1e-9) + 1]
                keys.append(own[rare])
                of.append(np.full(len(rare), i))
        keys, of = np.concatenate(keys), np.concatenate(of)
        order = np.argsort(keys, kind="stable")
        self.anchors, self.anchor_of = keys[order], of[order]
        self.maybe = np.zeros(1 << 22, bool)  # by the first bits of an anchor
        self.maybe[keys >> np.uint64(42)] = True

    def anchored(self, h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """``(document, item, first word, last word)`` of the anchors met, over the
        words of many documents laid end to end; a pair may come twice."""
        for a in range(0, len(h) - SHINGLE + 1, PART):
            s = shingle_hashes(h[a:a + PART + SHINGLE - 1])
            at = np.flatnonzero(self.maybe[s >> np.uint64(42)])
            at = at[doc[a + at] == doc[a + at + SHINGLE - 1]]
            low, high = (np.searchsorted(self.anchors, s[at], side) for side in ("left", "right"))
            count = high - low
            row = np.repeat(at, count)
            which = np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(row))
            pair = doc[a + row] * len(self.items) + self.anchor_of[which]
            both, first = np.unique(pair, return_index=True)
            last = len(pair) - 1 - np.unique(pair[::-1], return_index=True)[1]
            for p, f, g in zip(both.tolist(), row[first].tolist(), row[last].tolist(), strict=True):
                yield *divmod(p, len(self.items)), a + f, a + g

    def best_start(self, item: int, s: np.ndarray, first: int, last: int) -> int | None:
        """The start of the nearest of the windows that hold a shingle from ``first``
        to ``last``, where one can be similar enough; ``s`` are the shingles of the text."""
        own, weight = self.parts[item]
        m, all_, width = len(own), self.own[item], len(self.items[item]) - SHINGLE + 1
        least, heavy = SIMILARITY * m - 1e-9, SIMILARITY * all_ - 1e-9
        low = max(0, first - width + 1)
        region = s[low:last + width]
        place = np.minimum(np.searchsorted(own, region), m - 1)
        hit = own[place] == region
        held = np.unique(place[hit])
        if len(held) < least and weight[held].sum() < heavy:
            return None
        worth = np.where(hit, weight[place], 0.0)
        begin = np.arange(last - low + 1)
        end = np.minimum(begin + width, len(region))
        count, load = np.r_[0, np.cumsum(hit)], np.r_[0.0, np.cumsum(worth)]
        can = (count[end] - count[begin] >= least) | (load[end] - load[begin] >= heavy - 1e-9)
        code = np.unique(region, return_inverse=True)[1].tolist()
        hit, worth = hit.tolist(), worth.tolist()
        times, i, j, both, total, got = [0] * len(code), 0, 0, 0, 0, 0.0
        top, start = 0.0, None
        for b, e in zip(begin[can].tolist(), end[can].tolist(), strict=True):
            for x in range(i, min(b, j)):
                times[code[x]] -= 1
                if not times[code[x]]:
                    total -= 1
                    both -= hit[x]
                    got -= worth[x]
            i, j = b, max(b, j)
            for x in range(j, e):
                if not times[code[x]]:
                    total += 1
                    both += hit[x]
                    got += worth[x]
                times[code[x]] += 1
            j = e
            value = max(both / (m + total - both), got / (all_ * (1 + (total - both) / m)))
            if value > top + 1e-9:
                top, start = value, low + b
        return start

    @staticmethod
    def _tables(prints: np.ndarray):
        """Per block: for each of its 65,536 values, the fingerprints that hold it
        up to one bit, as offsets into a list, and whether there are any."""
        near = np.concatenate([[0], 1 << np.arange(16)]).astype(np.uint16)
        some, starts, lists = [], [], []
        for b in range(4):
            value = (prints[:, b, None] ^ near[None, :]).ravel()
            order = np.argsort(value, kind="stable")
            starts.append(np.searchsorted(value[order], np.arange(65_537)))
            some.append(np.diff(starts[-1]) > 0)
            lists.append((order // len(near)).astype(np.int32))
        return prints.view(np.uint64), some, starts, lists

    def places(self, h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """``(word, item, offset in the item, size)`` of the windows within the radius,
        over the words of many documents laid end to end."""
        most = max(self.by_size, default=0)
        for a in range(0, len(h), SLICE):
            part = h[a:a + SLICE + most - 1]
            sums: dict[type, np.ndarray] = {}
            for size, (of, at, prints, some, starts, lists) in self.by_size.items():
                n = min(SLICE, len(part) - size + 1)
                if n <= 0:
                    continue
                kind = _kind(size)
                if kind not in sums:
                    sums[kind] = running(part, size)
                p = simhashes(part, size, sums[kind][:n + size])
                for b in range(4):
                    value = np.ascontiguousarray(p[:, b])
                    hit = np.flatnonzero(some[b][value])
                    if not len(hit):
                        continue
                    value = value[hit]
                    first = starts[b][value]
                    count = starts[b][1:][value] - first
                    row = np.repeat(hit, count)
                    which = lists[b][np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(row))]
                    far = np.bitwise_count(p.view(np.uint64)[row, 0] ^ prints[which, 0])
                    good = far <= RADIUS
                    row, which = row[good], which[good]
                    same = doc[a + row] == doc[a + row + size - 1]
                    for r, w in zip(row[same].tolist(), which[same].tolist(), strict=True):
                        yield a + r, int(of[w]), int(at[w]), size

    def similarity(self, item: int, window: list[str]) -> float:
        """Jaccard, plain or weighted, whichever is higher. A shingle of k different
        texts weighs 1/k; one that only the window holds, the mean of the item's."""
        mine, other = self.shingles[item], shingles(window)
        both = mine & other
        more = len(other) - len(both)
        plain = len(both) / (len(mine) + more)
        weight = math.fsum(1 / self.held.get(x, 1) for x in both)
        return max(plain, weight / (self.own[item] * (1 + more / len(mine))))

    def search(self, texts: list[str | None], anchors: bool = True) -> list[list[dict]]:
        """Per text the items it holds: best place (in words) and similarity. Without
        ``anchors`` by fingerprints alone."""
        lengths, parts = [], []
        for t in texts:
            w = words(t)
            lengths.append(len(w))
            parts.append(self.hashes.of(w))
        out: list[list[dict]] = [[] for _ in texts]
        h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(texts)), lengths)
        begin = np.concatenate([[0], np.cumsum(lengths)]).astype(int)
        wanted: dict[tuple[int, int], set[int]] = {}
        spans: dict[tuple[int, int], tuple[int, int]] = {}   # first and last shingle met
        for at, item, offset, size in self.places(h, doc):
            d = int(doc[at])
            if len(self.items[item]) < SHINGLE:
                wanted.setdefault((d, item), set()).add(max(0, at - int(begin[d]) - offset))
            else:
                first, end = spans.get((d, item), (at, at))
                spans[d, item] = min(first, at), max(end, at + max(0, size - SHINGLE))
        for d, item, a, b in self.anchored(h, doc) if anchors else ():
            first, end = spans.get((d, item), (a, b))
            spans[d, item] = min(first, a), max(end, b)
        last, s = -1, h
        for (d, item), (a, b) in sorted(spans.items()):
            if d != last:
                last, s = d, shingle_hashes(h[begin[d]:begin[d + 1]])
            start = self.best_start(item, s, a - int(begin[d]), min(b - int(begin[d]), len(s) - 1))
            if start is not None:
                wanted.setdefault((d, item), set()).add(start)
        last, w = -1, []
        for d, item in sorted(wanted):
            if d != last:
                last, w = d, words(texts[d])
            n = len(self.items[item])
            best = max((self.similarity(item, w[s:s + n]), -s) for s in wanted[d, item])
            if best[0] >= SIMILARITY:
                out[d].append({"item": item, "start": -best[1], "similarity": best[0]})
        return out


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = WordHashes()
    for pdf in batches:
        w = [words(t) for t in pdf["text"]]
        yield pd.DataFrame({"uid": pdf["uid"], "text_key": [xxhash.xxh128_digest(" ".join(x)) for x in w],
                            "hashes": [np.unique(shingle_hashes(known.of(x)).view(np.int64)) for x in w]})


def with_shared(items: DataFrame) -> DataFrame:
    """``items`` is a stored table ``(uid, id, text)`` with distinct ``uid``. Adds
    ``shared``: the hashes of the item's shingles that several different texts of
    the table hold, with the number of these texts."""
    hashed = stored(items.select("uid", "text").mapInPandas(_hashed, "uid long, text_key binary, hashes array<long>"))
    firsts = hashed.groupBy("text_key").agg(F.min("uid").alias("uid")).select("uid")
    several = stored(hashed.join(firsts, "uid").select(F.explode("hashes").alias("hash")).groupBy("hash").agg(
        F.count(F.lit(1)).alias("texts")).filter("texts > 1"))
    found = hashed.select("uid", F.explode("hashes").alias("hash")).join(small(several), "hash")
    return items.join(found.groupBy("uid").agg(F.collect_list(F.struct("hash", "texts")).alias("shared")), "uid", "left")


def _found(block: Broadcast, text: Column) -> Column:
    """The items of ``block`` that ``text`` holds, by their place in the block."""
    @F.pandas_udf(RESULT)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(block.value["words"], block.value["shared"])
        for s in batches:
            out: list = []
            for a in range(0, len(s), 500):
                out += index.search(list(s.iloc[a:a + 500]))
            yield pd.Series(out)
    return found(text)


def _blocks(items: DataFrame) -> Iterator[tuple[Broadcast, list]]:
    """The stored ``(uid, id, text, shared)`` in blocks of bounded size: their words, sent
    to the executors once, and ``(uid, id)`` of each item. The driver holds one at a time."""
    sc = items.sparkSession.sparkContext
    block, size, shared = [], 0, {}

    def sent():
        return sc.broadcast({"words": [words(t) for _, _, t in block], "shared": shared}), [(u, i) for u, i, _ in block]

    for r in items.toLocalIterator():
        more = len(r["text"] or "")
        if block and (len(block) == ITEMS or size + more > ITEM_CHARS):
            yield sent()
            block, size, shared = [], 0, {}
        block.append((r["uid"], r["id"], r["text"]))
        size += more
        shared |= {x["hash"] % (1 << 64): x["texts"] for x in r["shared"] or ()}
    if block:
        yield sent()


def _by_text(df: DataFrame, text: str, items: DataFrame, blocks: Iterator[tuple[Broadcast, list]], kind: str, out: str) -> DataFrame:
    """``df`` with ``out`` for a benchmark of many blocks: one pass over the texts for each,
    of which only what is found is written, by two 64-bit hashes of the text; the
    rows then look their text up. A task holds one block, however many there are."""
    c1, c2, salt = fresh(df.withColumn(out, F.lit(0)), "c1_", "c2_", "salt_")
    held, t = None, F.col(f"`{text}`")
    keyed = df.withColumns({c1: F.xxhash64(t), c2: F.xxhash64(F.lit(9), t)})
    for block, names in blocks:
        uids = df.sparkSession.sparkContext.broadcast([u for u, _ in names])
        got = keyed.filter(t.isNotNull()).select(c1, c2, F.explode(_found(block, t)).alias("x"))
        got = stored(got.select(c1, c2, _uid(uids, F.col("x.item")).alias("uid"), "x.start", "x.similarity").distinct())
        held = got if held is None else held.union(got)
        for b in (block, uids):
            b.destroy()  # what it found is written
    named = held.join(small(items.select("uid", "id")), "uid")
    per_text = stored(named.groupBy(c1, c2).agg(F.collect_list(F.struct(
        F.col("id").cast(kind).alias("item_id"), "start", "similarity")).alias(out)))
    if held.count() <= FOUND:
        found = keyed.join(F.broadcast(per_text), [c1, c2], "left")
    else:  # a text may be that of many rows: they are dealt over copies of what it holds
        dealt = per_text.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = keyed.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(dealt, [c1, c2, salt], "left")
    return found.select(*[f"`{c}`" for c in df.columns], F.coalesce(F.col(out), F.array().cast(f"array<struct<item_id:{kind},start:int,similarity:double>>")).alias(out))


def _uid(uids: Broadcast, item: Column) -> Column:
    @F.pandas_udf("long")
    def uid(at: pd.Series) -> pd.Series:
        return pd.Series(np.array(uids.value, "i8")[at.to_numpy()])
    return uid(item)


def find_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
               item_text: str = "text", out: str = "leaks") -> DataFrame:
    """Add ``out``: the benchmark items each text holds, an array of ``(item_id,
    start, similarity)`` with the word the best window starts at, ordered by id.

    Null and empty texts hold nothing and items without words are found nowhere;
    items with the same id or text are all reported; an item with a null id is
    reported with a null. Rows and other columns stay. Texts are read whole. A benchmark
    of one block (``ITEMS`` and ``ITEM_CHARS``) is searched in one projection; a larger one
    in a pass over ``df`` for each block, at once, so store an expensive ``df`` before.
    """
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {out} exists")
    kind = benchmark.schema[item_id].dataType.simpleString()
    none = F.array().cast(f"array<struct<item_id:{kind},start:int,similarity:double>>")
    items = stored(benchmark.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{item_id}`").alias("id"),
                                    F.col(f"`{item_text}`").alias("text")))
    items = stored(with_shared(items))
    blocks = _blocks(items)
    head = list(islice(blocks, 2))
    if not head:
        return df.withColumn(out, none)
    if len(head) > 1:
        return _by_text(df, text, items, chain(head, blocks), kind, out).withColumn(out, F.array_sort(out))
    (block, names), = head
    ids = [i for _, i in names]
    ids = F.lit(ids) if all(i is not None for i in ids) else F.array(*[F.lit(i) for i in ids])
    found = F.transform(_found(block, F.col(f"`{text}`")), lambda x: F.struct(
        F.get(ids, x["item"]).cast(kind).alias("item_id"), x["start"].alias("start"), x["similarity"].alias("similarity")))
    return df.withColumn(out, F.array_sort(found))


def op8_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The items held by every row of ``documents``."""
    d = find_leaks(docs.select("doc_id", "text"), benchmark)
    return d.select("doc_id", F.size("leaks").cast("long").alias("n_leaks"),
                    F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"),
                    F.transform("leaks", lambda x: x["start"]).alias("starts"),
                    F.array_max(F.transform("leaks", lambda x: x["similarity"])).alias("similarity"))
