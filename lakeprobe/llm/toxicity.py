"""Operator 5, toxicity by multiple-instance learning.

A document is a bag of sentences and only the document is labelled. Each cue (a
word, or a beginning of words such as ``abcde*``) has a rate of at least 0; a sentence with rates r is offending with probability
``1 - exp(-sum r)``, and sentences combine by noisy-or with one small leak:
``P(document) = 1 - (1 - leak) * prod(1 - p(sentence))``. The rates are fitted
to the document labels by multiplicative updates, which never raise the loss and
drive the rates of harmless cues to zero. The sentence probabilities then say
which sentences offend.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows

TRAIN_ROWS = 5_000     # labelled rows that the driver fits on, at most
MIN_DOCS = 8           # texts that must hold a word before it gets a rate
PENALTY = (3.0, 0.7)   # weights of the penalty on a rate: of words, of beginnings
KEEP_RATE = 0.1        # smaller rates are dropped
STEPS = 80
BEGINNINGS = (5, 6, 7)  # characters
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")
RESULT = "score double, offending array<struct<start:int,end:int,score:double>>"


@dataclass
class ToxicityModel:
    rates: dict[str, float]
    leak: float
    stems: list[str] = field(init=False)  # a text with a cue holds one of these

    def __post_init__(self):
        self.stems = sorted({c.rstrip("*") for c in self.rates})


def _cues(sentence: str) -> set[str]:
    """Words and beginnings of words of a sentence in lower case."""
    words = set(_WORD.findall(sentence))
    return words.union(f"{w[:k]}*" for k in BEGINNINGS for w in words if len(w) > k)


def _family(text: str) -> int:
    """A min-hash of five-word shingles: near copies mostly share it."""
    w = text.split()
    return min((zlib.crc32(" ".join(w[i:i + 5]).encode()) for i in range(max(1, len(w) - 4))), default=0)


def _families(texts: list[str | None], toxic: list[int]) -> list[tuple[str, int]]:
    """One text of each family of near copies and label."""
    seen: set[tuple[int, int]] = set()
    out = []
    for t, label in zip(texts, toxic, strict=True):
        t = (t or "").lower()
        if (f := (_family(t), int(label))) not in seen:
            seen.add(f)
            out.append((t, int(label)))
    return out


def fit(texts: list[str | None], toxic: list[int]) -> ToxicityModel:
    """Fit the rates. One text of each family of near copies is used, so that a
    copied text does not pass for evidence. Without rows the model scores 0.

    Rare cues, nearly all of them, are put aside by a table of hashed counts before
    any is remembered, so memory follows the cues that many texts share."""
    rows = _families(texts, toxic)
    if not rows:
        return ToxicityModel({}, 0.0)
    seen = np.zeros(1 << 20, np.int32)
    for t, _ in rows:
        places = {hash(c) & 0xFFFFF for c in _cues(t)}
        seen[np.fromiter(places, np.int64, len(places))] += 1
    often = seen >= MIN_DOCS
    ids: dict[str, int] = {}
    cue, doc, times = array("i"), array("i"), array("i")
    for d, (t, _) in enumerate(rows):
        own = Counter(c for s in _SENTENCE.findall(t) for c in _cues(s) if often[hash(c) & 0xFFFFF])
        cue.extend(ids.setdefault(c, len(ids)) for c in sorted(own))
        doc.extend([d] * len(own))
        times.extend(own[c] for c in sorted(own))
    cue, doc, times = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (cue, doc, times))
    use = (np.bincount(cue, minlength=len(ids)) >= MIN_DOCS)[cue] if len(cue) else np.zeros(0, bool)
    cue, doc, times = cue[use], doc[use], times[use].astype("f4")
    n, labels = len(rows), np.array([y for _, y in rows], bool)
    per_cue = np.bincount(cue, times, minlength=len(ids))
    penalty = np.array([PENALTY[w.endswith("*")] for w in ids])
    rate, leak = np.full(len(ids), 0.01), 0.01
    for _ in range(STEPS):
        total = np.bincount(doc, rate[cue] * times, minlength=n) + leak
        pull = np.zeros(n)
        pull[labels] = 1 / -np.expm1(-total[labels])
        rate *= np.bincount(cue, pull[doc] * times, minlength=len(ids)) / (per_cue + penalty)
        leak *= pull.sum() / n
    kept = {w: float(rate[i]) for w, i in ids.items() if per_cue[i] and rate[i] >= KEEP_RATE}
    return ToxicityModel(kept, float(-np.expm1(-leak)))


def score_text(text: str | None, model: ToxicityModel) -> tuple[float, list[tuple[int, int, float]]]:
    """Score of a text, and its offending sentences as ``(start, end, p)`` in
    code points. A null or empty text has the leak alone."""
    low = (text or "").lower()
    if not any(c in low for c in model.stems):
        return model.leak, []
    rest, found = 1 - model.leak, []
    for m in _SENTENCE.finditer(text):
        r = sum(model.rates.get(w, 0.0) for w in _cues(m.group().lower()))
        if r:
            p = float(-np.expm1(-r))
            rest *= 1 - p
            if p >= 0.5:
                found.append((m.start(), m.end(), p))
    return min(1.0, max(0.0, 1 - rest)), found


def toxicity(text: Column, model: ToxicityModel) -> Column:
    """Struct ``(score, offending)`` of a text column, in Arrow batches."""
    @F.pandas_udf(RESULT)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [score_text(t, model) for t in s]
            yield pd.DataFrame({"score": [r[0] for r in rows], "offending": [
                [{"start": a, "end": b, "score": p} for a, b, p in r[1]] for r in rows]})
    return scored(text)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on labelled rows that are not held out, on an even sample of ``rows`` if
    there are more. A document labelled twice is toxic if one label says so."""
    y = labels.select("doc_id", "toxic").filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
    y = y.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.sparkSession.createDataFrame(bounded_rows(y, rows), y.schema)  # at most ``rows``
    got = bounded_rows(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic"), rows)
    return fit(list(got["text"]), list(got["toxic"]))


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add ``out``, a struct of ``score`` (0 to 1) and ``offending`` sentences.

    Texts are scored whole, each row by itself, without a shuffle; null and empty
    texts get the model's leak; all other columns stay as they are.
    """
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {out} exists")
    return df.withColumn(out, toxicity(F.col(f"`{text}`"), model))


def op5_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The result of the query over ``documents`` and ``labels``."""
    s = score_toxicity(docs.select("doc_id", "text"), train(docs, labels))
    score = F.col("toxicity.score")
    return s.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
        F.size("toxicity.offending").alias("n_offending"))
