"""Operator 9, language identification by a bidirectional GRU over bytes.

The text's bytes are read in windows. A gated recurrent network runs over each
window in both directions and a softmax labels every byte; the probabilities of a
document are the mean over all its bytes. Training is backpropagation through
time in numpy, on windows of a bounded sample of labelled texts.

All arrays hold the batch along the last axis, so that numpy's inner loops are
long. The cell (reset gate after the product): ``z, r = sigmoid(W x + U h)``,
``n = tanh(Wn x + r * (Un h))``, ``h' = h + z (n - h)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows

HIDDEN = 8
WINDOW = 128           # bytes; longer texts are several windows
TRAIN_WINDOW = 48
TRAIN_ROWS = 4_000     # labelled rows that the driver fits on, at most
TRAIN_WINDOWS = 8      # windows of a text that it fits on, at most, drawn at random
STEPS, BATCH, RATE = 220, 384, 0.02
PAD = 256              # input that leaves the state as it is
CHUNK = 2048           # windows run at once
UNKNOWN = "und"
RESULT = "lang string, score double, shares map<string,double>"


@dataclass
class LanguageModel:
    langs: list[str]
    params: dict[str, np.ndarray]


def has_letter(text: str) -> bool:
    """Whether a letter is among the characters; figures such as ² or ① are none."""
    return any(c.isalpha() for c in text)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _start(n_langs: int, rng) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p[f"W{d}"] = rng.normal(0, 0.3, (3 * HIDDEN, PAD + 1)).astype("f4")
        p[f"U{d}"] = rng.normal(0, HIDDEN ** -0.5, (3 * HIDDEN, HIDDEN)).astype("f4")
    p["V"] = rng.normal(0, 0.1, (n_langs, 2 * HIDDEN)).astype("f4")
    p["c"] = np.zeros((n_langs, 1), "f4")
    return p


def _run(x: np.ndarray, w: np.ndarray, u: np.ndarray, order, keep: bool):
    """States (T, H, B) of one direction over bytes (T, B); what the gradient
    needs besides, when ``keep``."""
    k = HIDDEN
    h = np.zeros((k, x.shape[1]), "f4")
    out = np.empty((len(x), *h.shape), "f4")
    saved = {}
    w = w.copy()
    w[:k, PAD] = -40  # z = 0
    for t in order:
        a = np.take(w, x[t], axis=1)
        g = u @ h
        a[:2 * k] += g[:2 * k]
        a[:2 * k] *= 0.5
        np.tanh(a[:2 * k], out=a[:2 * k])
        a[:2 * k] += 1
        a[:2 * k] *= 0.5
        a[2 * k:] += a[k:2 * k] * g[2 * k:]
        np.tanh(a[2 * k:], out=a[2 * k:])
        if keep:
            saved[t] = (a, g[2 * k:], h)
        out[t] = h + a[:k] * (a[2 * k:] - h)
        h = out[t]
    return out, saved


def _back(x, u, order, saved, d_out):
    """Gradients of one direction: of W and of U."""
    k = HIDDEN
    dw = np.zeros((3 * k, PAD + 1))
    du = np.zeros_like(u)
    dh = np.zeros(d_out.shape[1:], "f4")
    da_all = np.empty((len(x), 3 * k, x.shape[1]), "f4")
    for t in reversed(order):
        a, gn, h = saved[t]
        z, r, n = a[:k], a[k:2 * k], a[2 * k:]
        dh = dh + d_out[t]
        dn = dh * z * (1 - n * n)
        da = da_all[t]
        da[:k] = dh * (n - h) * z * (1 - z)
        da[k:2 * k] = dn * gn * r * (1 - r)
        da[2 * k:] = dn
        inner = da.copy()
        inner[2 * k:] *= r
        du += inner @ h.T
        dh = dh * (1 - z) + u.T @ inner
    flat = x.ravel()
    for i in range(3 * k):
        dw[i] = np.bincount(flat, da_all[:, i].ravel(), minlength=PAD + 1)
    return dw, du


def forward(x: np.ndarray, p: dict, keep: bool = False):
    """Label probabilities (L, T, B) of every byte of windows (T, B)."""
    ahead, behind = range(len(x)), range(len(x) - 1, -1, -1)
    hf, sf = _run(x, p["Wf"], p["Uf"], ahead, keep)
    hb, sb = _run(x, p["Wb"], p["Ub"], behind, keep)
    k = HIDDEN
    logits = np.einsum("lh,thb->ltb", p["V"][:, :k], hf, optimize=True)
    logits += np.einsum("lh,thb->ltb", p["V"][:, k:], hb, optimize=True)
    logits += p["c"][:, :, None]
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits, (hf, hb, sf, sb)


def gradients(x: np.ndarray, y: np.ndarray, weight: np.ndarray, p: dict):
    """Loss and gradients of windows (T, B) with labels y (B): cross entropy of
    every byte that is no padding, weighted by window."""
    prob, (hf, hb, sf, sb) = forward(x, p, keep=True)
    m = (x != PAD) * weight
    m = (m / m.sum()).astype("f4")
    b = np.arange(x.shape[1])
    loss = -(np.log(prob[y, :, b].T + 1e-9) * m).sum()
    d = prob
    d[y, :, b] -= 1
    d *= m
    k = HIDDEN
    g = {"V": np.concatenate([np.einsum("ltb,thb->lh", d, hf, optimize=True),
                              np.einsum("ltb,thb->lh", d, hb, optimize=True)], axis=1),
         "c": d.sum(axis=(1, 2))[:, None]}
    g["Wf"], g["Uf"] = _back(x, p["Uf"], list(range(len(x))), sf, np.einsum("lh,ltb->thb", p["V"][:, :k], d, optimize=True))
    g["Wb"], g["Ub"] = _back(x, p["Ub"], list(range(len(x) - 1, -1, -1)), sb, np.einsum("lh,ltb->thb", p["V"][:, k:], d, optimize=True))
    return loss, g


def _windows(data: bytes, size: int) -> np.ndarray:
    """(n, size) windows of a text's bytes, the last one padded."""
    n = -(-len(data) // size)
    out = np.full(n * size, PAD, np.int16)
    out[:len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, size)


def fit(texts: list[str], langs: list[str], seed: int = 7, windows: int = TRAIN_WINDOWS) -> LanguageModel:
    """Train on at most ``windows`` windows of ``TRAIN_WINDOW`` bytes of each text, drawn
    from all over it, the languages weighted alike."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for t, lang in zip(texts, langs, strict=True):
        if t and has_letter(t):
            w = _windows(t.encode("utf-8", "replace"), TRAIN_WINDOW)
            w = w[rng.permutation(len(w))[:windows]]
            xs.append(w)
            ys += [names.index(lang)] * len(w)
    if not xs:
        return LanguageModel([], {})
    x, y = np.concatenate(xs), np.array(ys)
    weight = (1 / np.bincount(y, minlength=len(names)).clip(1))[y]
    p = _start(len(names), rng)
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, STEPS + 1):
        pick = rng.integers(0, len(x), BATCH)
        _, g = gradients(np.ascontiguousarray(x[pick].T), y[pick], weight[pick], p)
        norm = max(1.0, np.sqrt(sum(float((v * v).sum()) for v in g.values())))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, v in g.items():
            v = (v / norm).astype("f4")
            m1[k] += 0.1 * (v - m1[k])
            m2[k] += 0.01 * (v * v - m2[k])
            p[k] -= rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-7)
    return LanguageModel(names, p)


def label_positions(text: str, model: LanguageModel) -> list[str]:
    """The label of every byte of one text."""
    w = _windows(text.encode("utf-8", "replace"), WINDOW)
    prob, _ = forward(np.ascontiguousarray(w.T), model.params)
    best = prob.argmax(axis=0).T.ravel()[: len(text.encode("utf-8", "replace"))]
    return [model.langs[i] for i in best]


def predict(texts: list[str | None], model: LanguageModel) -> list[tuple[str, float, dict[str, float]]]:
    """Per text the language, its pooled probability and the share of bytes
    labelled with each language. Texts that are null or have no letter are ``und``
    with score 0."""
    ok = [bool(model.langs and t and has_letter(t)) for t in texts]
    parts, of = [], []
    sums = np.zeros((len(texts), len(model.langs)))
    votes, lengths = np.zeros_like(sums), np.ones(len(texts))

    def flush():
        if not parts:
            return
        x, own = np.concatenate(parts), np.concatenate(of)
        for i in range(0, len(x), CHUNK):
            cut = np.ascontiguousarray(x[i:i + CHUNK].T)
            prob, _ = forward(cut, model.params)
            real = cut != PAD
            best = prob.max(axis=0)
            prob *= real
            for j in range(len(model.langs)):
                np.add.at(sums[:, j], own[i:i + CHUNK], prob[j].sum(axis=0, dtype="f8"))
                np.add.at(votes[:, j], own[i:i + CHUNK], ((prob[j] == best) & real).sum(axis=0))
        parts.clear()
        of.clear()

    waiting = 0
    for i, t in enumerate(texts):
        if ok[i]:
            data = t.encode("utf-8", "replace")
            lengths[i] = len(data)
            w = _windows(data, WINDOW)
            for a in range(0, len(w), 8 * CHUNK):  # very long texts in pieces
                parts.append(w[a:a + 8 * CHUNK])
                of.append(np.full(len(parts[-1]), i))
                waiting += len(parts[-1])
                if waiting >= 8 * CHUNK:
                    flush()
                    waiting = 0
    flush()
    out = []
    for i, good in enumerate(ok):
        if not good:
            out.append((UNKNOWN, 0.0, {}))
            continue
        mean = sums[i] / lengths[i]
        j = int(mean.argmax())
        out.append((model.langs[j], float(min(1.0, mean[j])),
                    {s: float(v / lengths[i]) for s, v in zip(model.langs, votes[i], strict=True) if v}))
    return out


def language(text: Column, model: LanguageModel) -> Column:
    """Struct ``(lang, score, shares)`` of a text column, in Arrow batches."""
    @F.pandas_udf(RESULT)
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = predict(list(s), model)
            yield pd.DataFrame({"lang": [r[0] for r in rows], "score": [r[1] for r in rows], "shares": [r[2] for r in rows]})
    return labelled(text)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, rows: int = TRAIN_ROWS, windows: int = TRAIN_WINDOWS) -> LanguageModel:
    """Fit on rows with a language that are not held out, on an even sample of
    ``rows`` if there are more."""
    own = docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    got = bounded_rows(own.filter(~held_out(F.col("doc_id"))).select("text", "lang"), rows)
    return fit(list(got["text"]), list(got["lang"]), windows=windows)


def identify(df: DataFrame, model: LanguageModel, text: str = "text", out: str = "language") -> DataFrame:
    """Add ``out``, a struct of ``lang`` (a learned language, or ``und`` where the
    text is null, empty or without a letter, or nothing was learned), ``score``
    (pooled probability, 0 for ``und``) and ``shares`` of the bytes by label.

    Texts are read whole, each row by itself, without a shuffle; ties go to the
    first language by name; other columns stay as they are.
    """
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {out} exists")
    return df.withColumn(out, language(F.col(f"`{text}`"), model))


def op9_langid(docs: DataFrame) -> DataFrame:
    """The result of the query over ``documents``."""
    d = identify(docs.select("doc_id", "text"), train(docs))
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                    F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
