"""Operators 3, 6 and 8 against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeprobe.llm import decontaminate as D
from lakeprobe.llm import graph as R
from lakeprobe.llm import jaccard as J
from lakeprobe.llm import vectors as V
from tests.conftest import SF

VOCAB = [f"w{i}" for i in range(400)]


def _set(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def _groups(n, linked):
    par = list(range(n))

    def find(a):
        while par[a] != a:
            par[a] = par[par[a]]
            a = par[a]
        return a
    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        par[b] = a
    return [find(i) for i in range(n)]


def _jaccard(texts):
    sets = [_set(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a)
             if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    deg = [0] * len(texts)
    for a, b in links:
        deg[a] += 1
        deg[b] += 1
    return deg, _groups(len(texts), links)


def _corpus():
    rng = random.Random(4)
    texts = [None, "", " \n", "one two", "One  Two", "x " * 30_000]
    for _ in range(25):
        base = [rng.choice(VOCAB) for _ in range(rng.randint(3, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("tile", [512, 3])
def test_jaccard_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(J, "TILE", tile)
    texts = _corpus()
    rows = J.op3_jaccard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    deg, root = _jaccard(texts)
    sets = [_set(t) for t in texts]
    assert len(rows) == len(texts)
    for r in rows:
        i = r.doc_id
        assert (r.n_links, r.component_id, r.kept) == (deg[i], root[i], root[i] == i), texts[i]
        assert r.class_id == (sets.index(sets[i]) if sets[i] else i)


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(5, "a b c d e f", 1), (5, "a b c d e f", 2), (None, "A b c d e f", 3), (None, None, 4)],
                               "doc_id long, text string, rid int")
    rows = J.op3_jaccard(df).collect()
    assert sorted((r.n_links, r.component_id or -1) for r in rows) == [(0, -1), (2, 5), (2, 5), (2, 5)]
    assert sum(r.kept for r in rows) == 2
    left = J.one_of_each(df)
    assert left.columns == df.columns and left.count() == 2
    assert J.op3_jaccard(df.limit(0)).count() == 0 and J.one_of_each(df.limit(0)).count() == 0


def test_prefixes_are_shortened_until_the_recall_holds():
    rate = lambda s, level: 1 - (1 - s ** level) ** J.TREES
    for similarity, recall in ((0.8, J.RECALL), (0.8, 0.95), (0.6, 0.9), (0.9, J.RECALL)):
        level = J.shortest_prefix(similarity, recall)
        assert rate(similarity, level) >= recall - 0.002 and (level == J.DEPTH or rate(similarity, level + 1) < recall + 0.01)
    assert J.shortest_prefix(0.2, 0.9999) == 1


def test_pairs_meet_at_their_longest_prefix():
    """Level by level every pair of a run comes once, the longest prefixes first, and of
    all tries a pair belongs to exactly one."""
    rng = np.random.default_rng(3)
    trees, depth, n = 6, 4, 60
    path = rng.integers(0, 2, (n, trees, depth)).astype(np.uint8)
    for level in (1, 2, 3):
        owners = {}
        for t in range(trees):
            keys = [bytes(p[t]) for p in path]
            order = sorted(range(n), key=lambda i: keys[i])
            run = np.cumsum([k == 0 or keys[order[k]][:level] != keys[order[k - 1]][:level] for k in range(n)])
            zero, yes = np.zeros(n, int), np.ones(n, bool)
            got, lengths = [], []
            for i, j in J.met(path[order].reshape(n, -1), np.full(n, t), run, zero, yes, level, depth, most=37):
                for a, b in zip(i, j):
                    a, b = order[a], order[b]
                    got.append((min(a, b), max(a, b)))
                    lengths.append(int(np.cumprod(path[a, t] == path[b, t]).sum()))
            want = {(a, b) for a in range(n) for b in range(a + 1, n) if keys[a][:level] == keys[b][:level]}
            assert set(got) == want and len(got) == len(want) and lengths == sorted(lengths, reverse=True)
            same = {p: (path[p[0]] == path[p[1]]).reshape(1, -1) for p in want}
            for p, s in same.items():
                if J._common_prefix(s, depth).argmax() == t:
                    assert p not in owners
                    owners[p] = t
        assert set(owners) == {(a, b) for a in range(n) for b in range(a + 1, n) if any(
            (path[a, t, :level] == path[b, t, :level]).all() for t in range(trees))}


def test_a_chain_of_loosely_similar_texts_stays_in_proportion(spark):
    """5,000 texts, each 0.65 similar to the next: they meet, but a text comes back for
    its own neighbours only, not for all of the chain."""
    n, step, size = 5000, 21, 104
    stream = [f"w{i}" for i in range(n * step + size)]
    texts = [" ".join(stream[i * step:i * step + size]) for i in range(n)]
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").withColumn("id", F.col("rid")).repartition(8, "rid")
    prefix = J.shortest_prefix(J.SIMILARITY)
    nodes = J.signatures(df, prefix).withColumnRenamed("rid", "node")
    back = J.meetings(nodes, prefix, J.SIMILARITY)
    assert n / 10 < back.count() <= 6 * n
    assert max(r["count"] for r in back.groupBy("bucket", "ta", "tb").count().collect()) < 50
    out = J.jaccard_join(df.select(F.col("id").alias("doc_id"), "text"))
    assert out.filter("n_links > 0 OR NOT kept").count() == 0 and out.count() == n


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 450), (7, 7)]
    got = dict(tuple(r) for r in R.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {i: 0 for i in range(201)} | {400: 400, 450: 400, 500: 400}


def test_forest_and_pairs():
    run = np.array([1, 1, 1, 2, 3, 3])
    side = np.array([0, 0, 1, 0, 0, 1])
    diagonal = np.array([True] * 3 + [False] * 3)
    for most in (1, 2, 100):
        got = {(int(a), int(b)) for i, j in R.pairs(run, side, diagonal, most) for a, b in zip(i, j, strict=True)}
        assert got == {(1, 0), (2, 0), (2, 1), (5, 4)}
    f = R.Forest(6)
    f.add(np.array([0, 3]), np.array([2, 4]))
    f.add(np.array([4]), np.array([2]))
    assert f.label.tolist() == [0, 1, 0, 0, 0, 5]


def _vector_truth(rows):
    ok = []
    for _, v, label in rows:
        good = label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)
        ok.append(np.array(v, "f4").astype("f8") if good else None)
    links = []
    for a in range(len(rows)):
        for b in range(a):
            x, y = ok[a], ok[b]
            if x is not None and y is not None and rows[a][2] == rows[b][2] and len(x) == len(y):
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= V.COSINE:
                    links.append((a, b))
    return links, _groups(len(rows), links)


@pytest.mark.parametrize("tile", [1024, 7])
def test_vectors_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(V, "TILE", tile)
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(12):
        base = rng.normal(size=32)
        for _ in range(rng.integers(1, 25)):
            v = base + rng.normal(size=32) * rng.choice([0, 0.15, 0.3, 0.6])
            rows.append([float(np.float32(c)) for c in v])
    rows = [(i, v, int(i % 17 == 0)) for i, v in enumerate(rows)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 32, 1), (n + 2, [float("nan")] + [1.0] * 31, 1), (n + 3, [None] + [1.0] * 31, 1),
             (n + 4, rows[0][1], None), (n + 5, [1.0, 2.0], 1), (n + 6, [2.0, 4.0], 1), (n + 7, [], 1), (n + 8, [float("inf")] * 32, 1)]
    # helper columns clash with no name of the table
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, label int, node string, bucket int, vec int, own int")
    got = {r.vec_id: r for r in V.op6_vectors(df).collect()}
    links, root = _vector_truth(rows)
    deg = np.bincount(np.array(links).ravel(), minlength=len(rows))
    assert len(got) == len(rows)
    assert all(got[i].n_links <= deg[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.99 * deg.sum()
    if sum(r.n_links for r in got.values()) == deg.sum():
        assert all(got[i].component_id == root[i] and got[i].kept == (root[i] == i) for i in got)


def test_vector_recall_at_the_threshold():
    h = V.hashing_for(64, 5000)
    rng = np.random.default_rng(77)
    a, b = rng.normal(size=(2, 4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = V.COSINE * a + np.sqrt(1 - V.COSINE ** 2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    zero = np.zeros(4000, np.int64)
    p, q = h.buckets(a, zero), h.buckets(b, zero)
    assert (p[:, :, :, None] == q[:, :, None, :]).any(axis=(1, 2, 3)).mean() >= 0.98


def test_tables_reach_the_recall_or_raise(monkeypatch):
    few = V.hashing_for(16, 1000)
    many = V.hashing_for(16, 10 ** 9)
    assert many.k > few.k == 2 and many.tables > few.tables
    monkeypatch.setattr(V, "MAX_TABLES", few.tables)  # too few for so many hashes
    less = V.hashing_for(16, 10 ** 9)
    assert less.k < many.k and less.tables <= few.tables
    with pytest.raises(ValueError):
        V.hashing_for(16, 1000, recall=1.01)


def test_vector_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (None, None, None)],
                               "vec_id long, embedding array<float>, label int")
    got = sorted((r.n_links, r.component_id or -1, r.kept) for r in V.op6_vectors(df).collect())
    assert got == [(0, -1, True), (2, 1, False), (2, 1, True), (2, 1, True)]
    assert V.op6_vectors(df.limit(0)).count() == 0


def _leaks(text, index):
    w, found = D.words(text), set()
    for k, item in enumerate(index.items):
        for s in range(len(w) if item else 0):
            if index.similarity(k, w[s:s + len(item)]) >= D.SIMILARITY:
                found.add(k)
                break
    return found


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    items = [" ".join(rng.choice(VOCAB) for _ in range(rng.randint(12, 60))) for _ in range(25)] + ["", None, "solo", "two words"]
    docs = [None, "", "clean text only", "Solo", "two Words!"]
    for k, t in enumerate(items[:25]):
        pad = [rng.choice(VOCAB) for _ in range(rng.randint(0, 300))]
        cut = rng.randint(0, len(pad))
        w = t.split()
        if k % 3 == 1:
            w[-1] = "changed"
        if k % 3 == 2 and len(w) > 55:
            w[len(w) // 2] = "changed"
        docs.append(" ".join(pad[:cut] + w + pad[cut:]).replace(" w1 ", " W1, "))
    index = D.Index([D.words(t) for t in items])
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: set(r.item_ids) for r in D.op8_decontamination(df, bench).collect()}
    want = {i: _leaks(t, index) for i, t in enumerate(docs)}
    assert got == want and sum(map(len, want.values())) >= 20


def test_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(3)
    items = [[f"w{i}" for i in rng.integers(0, 60, 20)] for _ in range(40)]
    index = D.Index(items)
    h = index.hashes.of([f"w{i}" for i in rng.integers(0, 60, 3000)] + [w for t in items for w in t])
    got = set(index.places(h, np.zeros(len(h), int)))
    want = set()
    assert list(index.by_size) == [14, 20]
    for size in index.by_size:
        p = D.simhashes(h, size).view(np.uint64)
        prints = [(k, a) for k in range(40) for s, a in D.prints_of(20, [14, 20]) if s == size]
        own = np.concatenate([D.simhashes(index.hashes.of(items[k][a:a + size]), size) for k, a in prints]).view(np.uint64)
        near = np.argwhere(np.bitwise_count(p ^ own.T) <= D.RADIUS)
        want |= {(int(at), *prints[k], size) for at, k in near}
    assert got == want


def test_windows_of_an_item():
    assert D.prints_of(3, [3]) == {(3, 0)} and D.window_lengths({3}) == [3]
    sizes = D.window_lengths(set(range(15, 60)))
    assert sizes == [11, 15, 20, 27, 36, 48]
    assert D.prints_of(15, sizes) == {(15, 0), (11, 0), (11, 2), (11, 4)}
    assert D.prints_of(59, sizes) == {(48, 0), (48, 11), (36, 0), (36, 11), (36, 23), (15, 0), (15, 15), (15, 30), (15, 44)}
    for n in range(45, 400):   # thirds leave no word out
        sizes = D.window_lengths({n})
        third = [(s, a) for s, a in D.prints_of(n, sizes) if s <= n // 3]
        assert set().union(*(range(a, a + s) for s, a in third)) == set(range(n))


def test_sums_of_long_windows_do_not_overflow():
    rng = np.random.default_rng(8)
    h = rng.integers(0, 1 << 63, 70_000, np.uint64)
    h[:] |= np.uint64(1)
    for size in (200, 300, 40_000, 69_990):
        got = np.unpackbits(D.simhashes(h, size).view(np.uint8), axis=1)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        for at in (0, len(got) - 1):
            assert (got[at] == (bits[at:at + size].sum(axis=0, dtype=np.int64) > size // 2)).all()


@pytest.mark.parametrize("length", [15, 30, 60, 100, 200, 400])
def test_fingerprints_alone_find_nine_in_ten(length):
    """Items with the largest edit that still reaches 0.8, without the anchors."""
    rng = random.Random(length)
    words = [f"v{i}" for i in range(20_000)]
    items = [[rng.choice(words) for _ in range(length)] for _ in range(max(10, 1200 // length))]
    index = D.Index(items)
    for kind in ("replaced", "inserted", "removed", "scattered", "cut"):
        texts, of = [], []
        for k, w in enumerate(items):
            pad = [rng.choice(words) for _ in range(30)]
            for size in range(length // (5 if kind == "cut" else 8), 0, -1):
                body = (w[:-size] if k % 2 else w[size:]) if kind == "cut" else _edited(rng, w, kind, size)
                text = pad[:15] + body + pad[15:]
                if max(index.similarity(k, text[s:s + length]) for s in range(10, 20)) >= D.SIMILARITY:
                    texts.append(" ".join(text))
                    of.append(k)
                    break
        found = sum(k in {x["item"] for x in got} for k, got in zip(of, index.search(texts, anchors=False)))
        assert found >= 0.9 * len(of)


def test_leaks_in_blocks_and_edges(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEMS", 3)
    items = [(i, " ".join(VOCAB[12 * i:12 * i + 12])) for i in range(8)] + [(None, " ".join(VOCAB[200:215]))]
    df = spark.createDataFrame([(1, " ".join(VOCAB[:96]), "x"), (2, " ".join(VOCAB[200:215]), "y")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in D.find_leaks(df, bench).collect()}
    assert got == {1: list(range(8)), 2: [None]}
    assert D.find_leaks(df.limit(0), bench).count() == 0
    assert D.find_leaks(df, bench.limit(0)).filter(F.size("leaks") > 0).count() == 0
    with pytest.raises(ValueError):
        D.find_leaks(df, bench, out="ITEM_ID")


def test_leaks_of_many_blocks_equal_those_of_one(spark, monkeypatch):
    """Repeated and null texts, clashing columns, blocks by items and by letters, both joins."""
    items = [(i % 7, " ".join(VOCAB[12 * i:12 * i + 12])) for i in range(9)] + [(None, "")]
    texts = [" ".join(VOCAB[:60])] * 40 + [None, "", " ".join(VOCAB[30:108]), "clean"]
    df = spark.createDataFrame([(i, t, -i) for i, t in enumerate(texts)], "doc_id long, text string, c1_ long").repartition(3)
    bench = spark.createDataFrame(items, "item_id int, text string")

    def leaks():
        got = D.find_leaks(df, bench)
        assert got.columns == [*df.columns, "leaks"] and got.schema["leaks"].dataType.simpleString() == "array<struct<item_id:int,start:int,similarity:double>>"
        rows = got.collect()
        assert all(r.c1_ == -r.doc_id and r.text == texts[r.doc_id] for r in rows)
        return sorted((r.doc_id, [tuple(x) for x in r.leaks]) for r in rows)

    one = leaks()
    assert len(one) == 44 and [len(x) for _, x in one[:40]] == [5] * 40 and [len(x) for _, x in one[40:]] == [0, 0, 6, 0]
    monkeypatch.setattr(D, "ITEM_CHARS", 200)
    assert leaks() == one
    monkeypatch.setattr(D, "ITEMS", 2)
    monkeypatch.setattr(D, "FOUND", 0)
    assert leaks() == one


def test_shared_shingles_lose_no_near_copy(spark, monkeypatch):
    rng = random.Random(4)
    some = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    changed = lambda w: w[:len(w) // 2] + ["changed"] + w[len(w) // 2 + 1:]
    twice, often, passage = some(59), some(100), some(70)
    asked = [passage + some(20) for _ in range(4)]
    items = [twice, asked[0], often, often, asked[1], often, twice, often, asked[2], often, asked[3]]
    docs = [changed(twice), some(50) + changed(often) + some(30), changed(asked[2]), some(400),
            passage[:20] + ["changed"] + passage[21:] + asked[1][70:]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").coalesce(1)
    index = D.Index(items)
    assert index.similarity(0, docs[0]) == pytest.approx(50 / 60) and index.own[2] == 96
    seen = []
    for block in (D.ITEMS, 3, 1):
        monkeypatch.setattr(D, "ITEMS", block)
        seen.append({r.doc_id: [(x.item_id, x.start, round(x.similarity, 9)) for x in r.leaks]
                     for r in D.find_leaks(df, bench).collect()})
    assert seen[0] == seen[1] == seen[2]  # the blocks change no score
    got = {k: {x[0] for x in v} for k, v in seen[0].items()}
    assert (got[0], got[1], got[3]) == ({0, 6}, {2, 3, 5, 7, 9}, set()) and 8 in got[2] and 4 in got[4]


def test_documents_shorter_than_an_item():
    rng = random.Random(6)
    items = [[rng.choice(VOCAB) for _ in range(n)] for n in (15, 27, 48, 57, 59, 5, 4)]
    index = D.Index(items)
    docs = [w[a:len(w) - b] for w in items for a in range(9) for b in range(9) if len(w) > a + b]
    found = [{x["item"] for x in got} for got in index.search([" ".join(w) for w in docs])]
    want = [_leaks(" ".join(w), index) for w in docs]
    assert found == want and sum(map(len, want)) > 100
    assert {x["item"] for x in index.search([" ".join(items[3][:47])])[0]} == {3}  # 0.81, and no window of 48


def _edited(rng, w, kind, size):
    """A copy of an item with ``size`` of its words edited."""
    a = (len(w) - size) // 2
    new = [f"new{rng.randint(0, 10 ** 6)}" for _ in range(size)]
    if kind == "replaced":
        return w[:a] + new + w[a + size:]
    if kind == "inserted":
        return w[:a] + new + w[a:]
    if kind == "removed":
        return w[:a] + w[a + size:]
    if kind == "moved":
        return w[size:] + w[:size]
    places = set(range(a % 7, len(w), max(1, len(w) // max(1, size // 5))))  # scattered
    return [new[0] if i in places else x for i, x in enumerate(w)]


@pytest.mark.parametrize("length", [60, 79, 100, 200, 400])
def test_edited_phrases_are_found_as_by_all_windows(length):
    rng = random.Random(length)
    items = [[rng.choice(VOCAB) for _ in range(length - k % 3)] for k in range(25)]
    index = D.Index(items)
    texts, want = [], []
    for k, w in enumerate(items):
        kind = ("replaced", "inserted", "removed", "moved", "scattered")[k % 5]
        pad = [rng.choice(VOCAB) for _ in range(rng.randint(0, 40))]
        for size in (length // 25, length // 17, length // 12, length // 8):
            text = pad + _edited(rng, w, kind, size) + pad[:7]
            near = [index.similarity(k, text[s:s + len(w)]) for s in range(len(text))]
            texts.append(" ".join(text))
            want.append([(k, near.index(max(near)), max(near))] if max(near) >= D.SIMILARITY else [])
    got = [[(x["item"], x["start"], x["similarity"]) for x in found] for found in index.search(texts)]
    assert got == want and sum(map(len, want)) >= 30


def test_no_leak_in_the_test_documents_is_missed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    norm = lambda t: " " + " ".join(D.words(t)) + " "
    items = {r.item_id: norm(r.text) for r in bench.collect()}
    got = {r.doc_id: set(r.item_ids) for r in D.op8_decontamination(docs, bench).collect()}
    for r in docs.collect():
        held = {k for k, t in items.items() if t in norm(r.text)}
        assert held <= got[r.doc_id]
