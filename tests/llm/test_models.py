"""Operators 2, 5 and 9: exact token counts and held-out accuracy."""

import struct
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lakeprobe.llm import langid as G
from lakeprobe.llm import tokens as K
from lakeprobe.llm import toxicity as X
from tests.conftest import SF

ODD = ["", " ", "  a", "a  b ", "日本語 text", "\n\n a", "😀😀x", "a\tb", "▁x", "\n", "é" * 300, "ab" * 3000, "the " * 2000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def _texts(docs, n=150):
    return [r.text or "" for r in docs.orderBy("doc_id").limit(n).collect()]


@pytest.mark.parametrize("kind", ["zipf", "file"])
def test_token_counts_equal_a_unigram_tokenizer(docs, kind):
    from tokenizers import Tokenizer, models, normalizers
    v = K.load_vocabulary(scores=kind)
    sp = sentencepiece.SentencePieceProcessor(model_file=K.VOCABULARY)
    scores = dict(v.pieces)
    t = Tokenizer(models.Unigram([(sp.id_to_piece(i), scores.get(sp.id_to_piece(i), 0) / K.UNIT)
                                  for i in range(sp.get_piece_size())], 0, True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    count = K.Counting(v)
    for text in _texts(docs) + ODD:
        assert count(text) == len(t.encode(text, add_special_tokens=False).ids), text[:80]


def _as_unigram(path, scores):
    """The model file as a unigram model with other scores: a walk over its fields."""
    data, out, i = open(path, "rb").read(), b"", 0

    def number(buf, i):
        n = shift = 0
        while True:
            n |= (buf[i] & 127) << shift
            shift += 7
            i += 1
            if buf[i - 1] < 128:
                return n, i

    def wire(n):
        b = b""
        while n > 127:
            b += bytes([n & 127 | 128])
            n >>= 7
        return b + bytes([n])

    while i < len(data):
        tag, j = number(data, i)
        n, j = number(data, j)
        body = data[j:j + n]
        if tag >> 3 == 1:  # a piece; field 2 is its score
            length, k = number(body, 1)
            if (piece := body[k:k + length].decode()) in scores:
                body += bytes([2 << 3 | 5]) + struct.pack("<f", scores[piece] / K.UNIT)
        if tag >> 3 == 2:  # the trainer's settings; field 3 is the type, 1 is unigram
            body += wire(3 << 3) + wire(1)
        out += wire(tag) + wire(len(body)) + body
        i = j + n
    return out


def test_ties_follow_sentencepiece(docs):
    v = K.load_vocabulary()
    sp = sentencepiece.SentencePieceProcessor(model_proto=_as_unigram(K.VOCABULARY, dict(v.pieces)))
    count = K.Counting(v)
    for text in [w for t in _texts(docs, 40) for w in t.split()[:40]] + ["aaaa", "the of", "ôn ôn"]:
        assert count(text) == len(sp.encode(text)), text


def test_tokens_query_and_edges(spark, docs):
    df = spark.createDataFrame([(1, None), (1, ""), (None, "a b"), (2, "x" * 200_000)], "doc_id long, text string")
    got = [(r.doc_id, r.n_tokens) for r in K.op2_tokens(df).collect()]
    count = K.Counting(K.load_vocabulary())
    assert got == [(1, 0), (1, 0), (None, count("a b")), (2, count("x" * 200_000))]
    assert K.op2_tokens(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        K.count_tokens(df.withColumn("n_tokens", F.lit(1)), K.load_vocabulary())


def test_a_full_cache_changes_nothing(monkeypatch, docs):
    texts = _texts(docs, 20)
    want = [K.Counting(K.load_vocabulary())(t) for t in texts]
    monkeypatch.setattr(K, "CACHE", 10)
    assert [K.Counting(K.load_vocabulary())(t) for t in texts] == want


def test_toxicity_finds_the_sentence():
    good = [f"A calm line number {i}. Another fine line." for i in range(60)]
    bad = [f"A calm line number {i}. You are a zorgblat fool. Another fine line." for i in range(60, 90)]
    m = X.fit(good + bad, [0] * 60 + [1] * 30)
    score, found = X.score_text("All is well. What a zorgblat day! Bye.", m)
    assert score >= 0.5 and [("All is well. What a zorgblat day! Bye."[a:b]).strip() for a, b, _ in found] == ["What a zorgblat day"]
    assert X.score_text("A calm line. Another.", m)[0] < 0.1


def _plain_noisy_or(text, model):
    """The score from the definition: sentences as runs of the pattern, the sum of the
    rates of their cues, and one minus the product of what is left."""
    left = 1 - model.leak
    for m in X._SENTENCE.finditer(text or ""):
        rate = sum(model.rates.get(c, 0.0) for c in X._cues(m.group().lower()))
        left *= np.exp(-rate)
    return 1 - left


def test_toxicity_held_out(spark, docs):
    """Rows that training never saw: found and false alarms, and scores as defined."""
    labels = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/labels.parquet")
    many = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/documents.parquet")
    r = X.op5_toxicity(many, labels).join(labels, "doc_id").collect()
    for x in r[:50]:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
    unseen = [(x.toxic, x.predicted) for x in r if x.held_out]
    assert len(unseen) > 500
    toxic = sum(a for a, _ in unseen)
    assert sum(a and b for a, b in unseen) >= 0.8 * toxic and sum(b and not a for a, b in unseen) <= 0.01 * len(unseen)
    model = X.train(docs, labels)
    for t in _texts(docs, 200) + [None, ""]:
        assert X.score_text(t, model)[0] == pytest.approx(_plain_noisy_or(t, model), abs=1e-9)


def test_toxicity_updates_raise_the_likelihood():
    """Each step of training is worth at least as much as the one before, penalty included."""
    rng = np.random.default_rng(4)
    good = [f"calm {w} line here. fine {v} text." for w, v in rng.integers(0, 40, (120, 2))]
    bad = [f"calm {w} line. vile {v} word here." for w, v in rng.integers(0, 40, (40, 2))]
    values = []
    for steps in (1, 2, 5, 20, 60):
        old, X.STEPS = X.STEPS, steps
        try:
            m = X.fit(good + bad, [0] * 120 + [1] * 40)
        finally:
            X.STEPS = old
        p = np.clip([_plain_noisy_or(t, m) for t in good + bad], 1e-12, 1 - 1e-12)
        values.append(np.log(1 - p[:120]).sum() + np.log(p[120:]).sum())
    assert values[-1] > values[0] and all(b > a - 2 for a, b in zip(values, values[1:]))


def test_toxicity_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "x", "c")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = X.op5_toxicity(df, none).collect()
    assert [(r.held_out, r.score, r.predicted) for r in rows] == [(zlib.crc32(b"1") % 5 == 0, 0.0, 0)] * 2 + [(False, 0.0, 0)]
    odd = spark.createDataFrame([(1, None), (None, 1), (7, 1), (7, 0)], "doc_id long, toxic int")
    assert X.op5_toxicity(df.limit(0), odd).count() == 0
    assert X.score_toxicity(df, X.train(df, odd)).columns == ["doc_id", "text", "score", "toxicity"]


def test_gru_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype("f8") for k, v in G._start(3, rng).items()}
    x, y, w = rng.integers(0, 256, (9, 5)), rng.integers(0, 3, 5), np.ones(5)
    x[6:, 2] = G.PAD
    _, g = G.gradients(x, y, w, p)
    for name in ("Uf", "Ub", "V", "Wf", "Wb"):
        at = (1, int(x[2, 0])) if name[0] == "W" else (1, 2)
        loss = []
        for e in (1e-2, -1e-2):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += e
            loss.append(G.gradients(x, y, w, q)[0])
        assert abs((loss[0] - loss[1]) / 2e-2 - g[name][at]) < 1e-5, name


def _plain_forward(x, p):
    """The cell from its definition, one number at a time, over one text's bytes."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    k, sides = G.HIDDEN, []
    for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        h, states = np.zeros(k), [None] * len(x)
        for t in order:
            if x[t] != G.PAD:
                a, g = p[f"W{d}"][:, x[t]], p[f"U{d}"] @ h
                z, r = sig(a[:k] + g[:k]), sig(a[k:2 * k] + g[k:2 * k])
                h = h + z * (np.tanh(a[2 * k:] + r * g[2 * k:]) - h)
            states[t] = h
        sides.append(states)
    logits = np.array([p["V"] @ np.concatenate([f, b]) + p["c"][:, 0] for f, b in zip(*sides)])
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_forward_equals_the_plain_cell():
    rng = np.random.default_rng(2)
    p = G._start(4, rng)
    x = rng.integers(0, 256, (23, 3))
    x[17:, 1] = G.PAD
    got, _ = G.forward(x, p)
    for i in range(3):
        real = x[:, i] != G.PAD
        assert np.allclose(got[:, real, i].T, _plain_forward(x[:, i], p)[real], atol=1e-5)


def test_figures_are_no_letters(docs):
    model = G.train(docs.limit(300))
    texts = ["5²", "½ 10", "①②", "٣٤", "_", "😀", "a²", "é", "日"]
    assert [r[0] == "und" for r in G.predict(texts, model)] == [True] * 6 + [False] * 3


def test_clashing_names_raise(spark, docs):
    df = spark.createDataFrame([(1, "a", "x")], "doc_id long, text string, Language string")
    model = G.train(docs.limit(100))
    with pytest.raises(ValueError, match="language"):
        G.identify(df, model)
    assert G.identify(df, model, out="found").columns == [*df.columns, "found"]
    tox = X.fit(["a"], [0])
    with pytest.raises(ValueError, match="toxicity"):
        X.score_toxicity(df.withColumn("Toxicity", F.lit(1)), tox)


def test_language_held_out(docs):
    r = G.op9_langid(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(r) == docs.count()
    out = [x for x in r if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in r)
    assert np.mean([x.lang_pred == x.lang for x in out]) > 0.97


def test_language_edges(spark, docs):
    model = G.train(docs.limit(300))
    df = spark.createDataFrame([(1, None), (1, ""), (2, "12 !?"), (None, "the of and with " * 5000), (3, "x\x00y")], "doc_id long, text string")
    got = [(r.language.lang, r.language.score) for r in G.identify(df, model).collect()]
    assert got[:3] == [("und", 0.0)] * 3 and got[3][0] == "en" and 0 <= got[4][1] <= 1
    assert G.op9_langid(df.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und' OR score > 0").count() == 0
    assert G.op9_langid(docs.limit(0)).count() == 0
    assert len(G.label_positions("the of é", model)) == 9


def test_language_pools_all_windows(docs):
    model = G.train(docs.limit(300))
    texts = _texts(docs, 30)
    alone = [G.predict([t], model)[0] for t in texts]
    together = G.predict(texts, model)
    assert [a[0] for a in alone] == [b[0] for b in together]
    assert np.allclose([a[1] for a in alone], [b[1] for b in together], atol=1e-4)


def test_windows_of_a_text_are_a_parameter(monkeypatch):
    monkeypatch.setattr(G, "STEPS", 1)
    cut, sizes = G._windows, []
    monkeypatch.setattr(G, "gradients", lambda x, y, weight, p: sizes.append(weight.max()) or (0.0, {k: np.zeros_like(v) for k, v in p.items()}))
    text = "some words of a long text " * 200
    for n in (G.TRAIN_WINDOWS, 20, 10 ** 6):
        G.fit([text], ["en"], windows=n)
    assert [round(1 / w) for w in sizes] == [8, 20, len(cut(text.encode(), G.TRAIN_WINDOW))]
