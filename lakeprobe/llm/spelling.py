"""Operator 11, spelling variants by blocked Gram matrices.

A word is the vector of its letter counts. Two words one edit apart have squared
distance 1 (a letter more) or 2 (a letter replaced), and lengths at most one apart.
So words go into length blocks, and a block and the next are compared by one NumPy
product of their count matrices, which gives all squared distances at once; pairs of at
most two are verified letter by letter.

Length blocks are cut further without loss: one edit leaves the first or the last half
of the shorter word as it is. Words meet in a block for each half, and a pair with both
halves in common counts in the first. What blocks still hold many words are worked off
in salted tiles (``graph.py``); tasks return a count and the best form per word, never
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored
from .graph import dealt, in_tiles, whole_runs

# The letters of a word, and the rule that plants variants.
RUN = "[A-Za-zÀ-ÿ]+"
DELETE_EVERY = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
TILE = 1024
BLOCK = 256              # rows of neighbouring small blocks that share one product
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def as_read(run: Column, doc_id: Column) -> Column:
    """A run lower-cased in A-Z, with the one letter deleted that the rule picks."""
    word = F.translate(run, _UPPER, _UPPER.lower())
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = F.pmod(h, F.length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % DELETE_EVERY == 0, cut).otherwise(word)


def word_counts(df: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of all whole texts: counted where they lie, then summed."""
    runs = df.select(F.col(f"`{doc_id}`").alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select(as_read(F.col("run"), F.col("id")).alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def letter_counts(words: list[str]) -> np.ndarray:
    """One row of letter counts per word, over the letters that occur."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    letters, place = np.unique(codes, return_inverse=True)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * len(letters) + place, minlength=len(words) * len(letters)).reshape(len(words), len(letters))


def one_edit(short: list[str], long: list[str]) -> np.ndarray:
    """Whether each pair differs by exactly one replaced code point, or by one that
    the second has more. Lengths are equal, or the second is one longer."""
    out = np.zeros(len(short), bool)
    sizes = np.array([len(w) for w in short])
    more = np.array([len(w) for w in long]) - sizes
    for size, extra in {(int(s), int(m)) for s, m in zip(sizes, more)}:
        rows = np.flatnonzero((sizes == size) & (more == extra))
        step = max(1, 4_000_000 // (size + 1))
        for start in range(0, len(rows), step):
            r = rows[start:start + step]
            a = np.frombuffer("".join(short[i] for i in r).encode("utf-32-le"), "<u4").reshape(len(r), size)
            b = np.frombuffer("".join(long[i] for i in r).encode("utf-32-le"), "<u4").reshape(len(r), size + extra)
            if extra == 0:
                out[r] = (a != b).sum(axis=1) == 1
            else:  # a common beginning and a common end that together are all of the shorter
                begin = np.cumprod(a == b[:, :size], axis=1).sum(axis=1)
                end = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
                out[r] = begin + end >= size
    return out


def halves(size: int) -> tuple[int, int]:
    """Letters of the first and the last half of a word of ``size``."""
    return size // 2, size - size // 2


def gram_pairs(words: list[str], run: np.ndarray, low: np.ndarray, last: np.ndarray,
               meet: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of near words of the same run, the shorter one first. A run's words have
    the lengths ``low`` and ``low + 1`` and share the first half of ``low`` letters, or
    the last one (``last``); a pair that shares both counts as sharing the first."""
    counts = letter_counts(words)
    size = counts.sum(axis=1)
    # products of whole numbers stay exact
    x = counts.astype("f4" if int(size.max()) < 2048 else "f8")
    square, one = (x ** 2).sum(axis=1, keepdims=True), np.ones((len(x), 1), x.dtype)
    minus = np.hstack([2 * x, -square, -one]) @ np.hstack([x, one, square]).T   # squared distances, negative
    i, j = np.nonzero(np.triu(minus >= -2, 1))
    ok = (run[i] == run[j]) & (low[i] == low[j]) & (last[i] == last[j]) & (np.minimum(size[i], size[j]) == low[i])
    ok &= meet[i] | (side[i] != side[j])
    i, j = i[ok], j[ok]
    first = [halves(int(n))[0] for n in low[i]]
    ok = np.array([(words[a][:n] != words[b][:n]) == bool(z) for a, b, n, z in zip(i, j, first, last[i])], bool)
    i, j = i[ok], j[ok]
    swap = size[i] > size[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    near = one_edit([words[k] for k in i], [words[k] for k in j])
    return i[near], j[near]


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per word: near words found here, and the best of them. Neighbouring small
    blocks share a product of about ``BLOCK`` rows."""
    for pdf, runs in whole_runs(batches):
        starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
        ends = np.r_[starts[1:], len(runs)]
        at = 0
        while at < len(starts):
            last = max(at, int(np.searchsorted(ends, starts[at] + BLOCK, "right")) - 1)
            rows = slice(int(starts[at]), int(ends[last]))
            at = last + 1
            part = pdf.iloc[rows]
            words, n = part["word"].tolist(), part["n"].to_numpy()
            i, j = gram_pairs(words, runs[rows], part["low"].to_numpy(), part["last"].to_numpy(),
                              (part["ta"] == part["tb"]).to_numpy(), part["side"].to_numpy())
            if not len(i):
                continue
            a, b = np.concatenate([i, j]), np.concatenate([j, i])
            rank = np.empty(len(words), "i8")   # code points order words as Python does
            rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
            order = np.lexsort((rank[b], -n[b], a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            yield pd.DataFrame({"word": [words[k] for k in a[first]], "near": np.diff(np.r_[first, len(a)]),
                                "best_n": n[b[first]], "best": [words[k] for k in b[first]]})


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, best_n, best)`` of a stored table of distinct ``(word, n)``:
    how many others are one edit away, and the most frequent of them (ties: the
    first in code-point order). Words without any have no row."""
    size, text = F.length("word"), F.col("word")
    member = words.select("word", "n", F.explode(F.array(size - 1, size)).alias("low"))
    first, rest = (F.col("low") / 2).cast("int"), F.col("low") - (F.col("low") / 2).cast("int")
    half = F.array(F.substring(text, F.lit(1), first), F.substring(text, size - rest + 1, rest))
    member = member.select("word", "n", "low", F.posexplode(half).alias("last", "half"))
    member = member.select(F.xxhash64("last", "low", "half").alias("bucket"), F.struct("word", "n", "last", "low").alias("node"))
    tiles = dealt(in_tiles(member, TILE)).select("bucket", "ta", "tb", "side", "node.word", "node.n", "node.last", "node.low")
    found = tiles.mapInPandas(_near, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def spelling_variants(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row ``(word, form, root, n, n_near, form_n)`` per word of all texts.

    Words are distinct runs of letters of at least five code points that stand at
    least three times (``n``), as read by ``as_read``. ``form`` is the most frequent
    word one edit away (ties: the first in code-point order) if it is at least twice
    as frequent; ``root`` follows forms to the last. A null or empty text has no words,
    a null id reads as an empty one; a repeated row counts again; runs of any
    length are words; an empty table gives an empty result. Other columns are not read.
    """
    words = stored(word_counts(df, text, doc_id))
    near = stored(near_words(words))
    linked = stored(words.join(near, "word").select(
        "word", "n", "n_near", F.when(F.col("best_n") >= 2 * F.col("n"), F.col("best")).alias("form"),
        F.when(F.col("best_n") >= 2 * F.col("n"), F.col("best_n")).alias("form_n")))
    # each step at least doubles n, so doubling the steps ends after a few rounds
    steps = stored(linked.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = small(steps.select(F.col("word").alias("root"), F.col("root").alias("next")))
        longer = stored(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            break
    linked = linked.join(small(steps), "word", "left").select("word", "form", F.col("root").alias("last"), "n_near", "form_n")
    out = words.join(small(stored(linked)), "word", "left")
    return out.select("word", "form", F.coalesce("last", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling(documents: DataFrame) -> DataFrame:
    """The result of the query over ``documents``."""
    return spelling_variants(documents)
