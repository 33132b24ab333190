"""Operators 11, 12 and 13 against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lakeprobe.llm import codes as C
from lakeprobe.llm import multiindex as M
from lakeprobe.llm import spelling as S
from tests.conftest import SF

# ---------------------------------------------------------------------------
# operator 11


def _words(rows):
    """The contract, word by word."""
    import re
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _variants(rows):
    words = _words(rows)
    form, out = {}, {}
    for w, n in words.items():
        near = sorted((-words[v], v) for v in words if _near(w, v))
        form[w] = near[0][1] if near and -near[0][0] >= 2 * n else None
        out[w] = [form[w], None, n, len(near), words[form[w]] if form[w] else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def _got(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def _spelled():
    rng = random.Random(2)
    letters = "abcdeéÿ×z"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(60)]
    rows = [(1, None), (2, ""), (None, "Straße Straße STRAßE " * 3), (3, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 5001 + " " + "x" * 5000),
            (4, "a1bcdef Abcdef-abcdef abcdeF"), (4, "a1bcdef Abcdef-abcdef abcdeF")]
    for d in range(5, 260):
        words = []
        for _ in range(40):
            w = list(rng.choice(base[:rng.randint(1, 60)]))
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w[at:at + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
            words.append("".join(w))
        rows.append((d, " ".join(words)))
    for i in range(40):  # a chain: plentirg, plenting, planting
        rows.append((300 + i, " ".join(["planting"] + ["plenting"] * (i < 15) + ["plentirg"] * (i < 5))))
    return rows


def test_spelling_brute_force(spark):
    rows = _spelled()
    df = spark.createDataFrame([(d, t, "k", 7) for d, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    want = _variants(rows)
    got = _got(S.spelling_variants(df))
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 50
    assert any(v[1] != v[0] and v[0] for v in want.values())  # chains of forms
    assert any(v[3] > 1 for v in want.values())


def test_spelling_tiles(spark, monkeypatch):
    """Blocks dealt over many tiles, and products of a few rows, give the same."""
    rows = _spelled()
    monkeypatch.setattr(S, "TILE", 4)
    monkeypatch.setattr(S, "BLOCK", 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(S.spelling_variants(df)) == _variants(rows)


def test_spelling_ties_and_empty(spark):
    # two near words of the same count: the first in code-point order is the form
    words = spark.createDataFrame([("house", 4), ("mouse", 4), ("zouse", 2), ("éouse", 4), ("ho", 9)], "word string, n long")
    near = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in S.near_words(words).collect()}
    assert near["zouse"] == (3, 4, "house") and near["house"] == (3, 4, "mouse") and "ho" not in near
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.spelling_variants(empty).collect() == []
    assert S.spelling_variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect() == []


def test_one_edit_and_gram():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(5, 7))) for _ in range(300)})
    short, long = zip(*[sorted((a, b), key=len) for a in words for b in words if a < b and abs(len(a) - len(b)) <= 1])
    assert S.one_edit(list(short), list(long)).tolist() == [_near(a, b) for a, b in zip(short, long)]


# ---------------------------------------------------------------------------
# operator 12

def _exact(rows, top=20, every=20):
    ok = [(i, np.array(v, "f8")) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for k, (i, v) in enumerate(ok):
        if i is not None and i % every == 0:
            s = [(-sum(float(x) * float(y) for x, y in zip(v, w)), j is None, j) for m, (j, w) in enumerate(ok) if m != k and len(w) == len(v)]
            out[i] = [(j, -a) for a, _, j in sorted(s, key=lambda t: (t[0], t[1], t[2] or 0))[:top]]
    return out


def _neighbours(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def _vectors(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(8, dim))
    x = (centre[rng.integers(0, 8, n)] + 0.5 * rng.normal(size=(n, dim))).astype("f4")
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


ODD = [(5000, None), (5020, []), (5040, [0.0] * 16), (5060, [float("nan")] + [1.0] * 15), (5080, [None] + [1.0] * 15),
       (5100, [float("inf")] * 16), (None, [2.0] * 16), (5120, [1.0]), (5121, [3.0]), (5140, [1.0, 2.0]), (5160, [0.5] * 16)]


def test_index_full_effort_is_brute_force(spark, monkeypatch):
    """With all cells walked the result is exact, whatever blocks, tiles and ties."""
    monkeypatch.setattr(M, "BLOCK", 64)
    hot = [(6000 + i, [0.25] * 16) for i in range(300)]    # equal vectors fill a cell of many blocks
    rows = _vectors(700, 16) + ODD + hot
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, rid string, cell int").repartition(4)
    got, want = _neighbours(M.nearest_rows(df, effort=10 ** 9)), _exact(rows)
    assert got.keys() == {q for q, hits in want.items() if hits} and 5140 not in got
    for q, hits in got.items():
        assert [h[0] for h in hits] == [h[0] for h in want[q]], q
        assert np.allclose([h[1] for h in hits], [h[1] for h in want[q]], rtol=1e-12)
    assert [h[0] for h in got[6000]][-1] == want[6000][-1][0]
    assert got[5120] == [(5121, 3.0)]


def test_index_recall_and_small_tables(spark):
    rows = _vectors(3000, 16, 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = _neighbours(M.nearest_rows(df)), _exact(rows)
    found = sum(len({h[0] for h in got[q]} & {h[0] for h in hits}) for q, hits in want.items())
    assert found >= 0.9 * sum(map(len, want.values()))
    assert M.nearest_rows(df.limit(0)).collect() == []
    assert M.nearest_rows(df.filter("vec_id = 20")).collect() == []
    few = _neighbours(M.nearest_rows(df.filter("vec_id IN (20, 21, 22)")))
    assert list(few) == [20] and len(few[20]) <= 2
    twice = df.filter("vec_id = 20").union(df.filter("vec_id = 20"))
    assert [r["vec_id"] for r in M.nearest_rows(twice).collect()] == [20, 20]


def test_index_recall_on_embeddings(spark):
    df = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/embeddings.parquet")
    got = _neighbours(M.op12_neighbours(df))
    want = _exact([(r["vec_id"], r["embedding"]) for r in df.collect()])
    found = sum(len({h[0] for h in got[q]} & {h[0] for h in hits}) for q, hits in want.items())
    assert found >= 0.9 * sum(map(len, want.values()))


def test_walk_goes_by_summed_nearness():
    rng = np.random.default_rng(3)
    index = M.Index(rng.normal(size=(7, 3)), rng.normal(size=(5, 4)), *[np.zeros(35, "i8")] * 2, rng.integers(0, 4, 35))
    q = rng.normal(size=7)
    score = (index.first @ q[:3])[:, None] + (index.second @ q[3:])[None, :]
    order = [c for c in np.argsort(-score.ravel()) if index.rows[c]]
    assert index.walk(q, 10 ** 9) == order
    part = index.walk(q, 20)
    assert part == order[:len(part)] and index.rows[part].sum() >= 20 > index.rows[part[:-1]].sum()


def test_pack_blocks():
    first, many = M.pack(np.array([3, 0, 4, 9, 25, 1, 10, 0]), 10)
    assert many.tolist() == [1, 1, 1, 1, 3, 1, 1, 1]
    assert first.tolist() == [0, 0, 0, 1, 2, 5, 6, 6]


# ---------------------------------------------------------------------------
# operator 13

def _plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, lab, [max(-C.LIMIT, min(C.LIMIT, math.floor(256 * x))) for x in v]) for i, lab, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, total = [], {}
    for dim in {len(v) for _, _, v in kept}:
        here = [r for r in kept if len(r[2]) == dim]
        cut = [(k * dim // parts, (k + 1) * dim // parts) for k in range(parts)]
        start = sorted(here, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
        books = [[r[2][a:b] for r in start] for a, b in cut]

        def best(v, k):
            a, b = cut[k]
            return min((sum((x - y) ** 2 for x, y in zip(v[a:b], e)), n) for n, e in enumerate(books[k]))
        for _ in range(rounds):
            chosen = [[best(r[2], k)[1] for k in range(parts)] for r in here]
            for k, (a, b) in enumerate(cut):
                for n in range(len(start)):
                    group = [r[2][a:b] for r, c in zip(here, chosen) if c[k] == n]
                    if group:
                        books[k][n] = [sum(x) // len(group) for x in zip(*group)]
        sha = hashlib.sha256(",".join(str(x) for k in books for e in k for x in e).encode()).hexdigest()
        for i, lab, v in here:
            found = [best(v, k) for k in range(parts)]
            error = sum(e for e, _ in found)
            total[lab] = total.get(lab, 0) + error
            out.append((i, "".join(f"{n:02x}" for _, n in found), error, lab, sha))
    return Counter((i, code, min(e, C.LONG_MAX), min(total[lab], C.LONG_MAX), sha) for i, code, e, lab, sha in out)


def _codes_of(df):
    return Counter(tuple(r) for r in C.vector_codes(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


CODE_SCHEMA = "vec_id long, label int, embedding array<double>, code string, error int"


def _check_codes(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CODE_SCHEMA).repartition(3)
    assert _codes_of(df) == _plain_codes(rows)


def test_codes_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1, 2]), [rng.choice([-1, 1]) * rng.random() for _ in range(32)]) for i in range(150)]
    rows += rows[:3] + [(None, 1, rows[0][2]), (900, 1, None), (901, 1, [float("nan")] * 32), (902, 2, [None] + [0.0] * 31),
                        (903, 2, [float("-inf")] + [0.0] * 31)]
    _check_codes(spark, rows)


@pytest.mark.parametrize("values", [
    [[0.0] * 32] * 80,                                              # all ties
    [[1e5 * ((i * 7 + d) % 11) for d in range(32)] for i in range(70)],   # 64-bit sums
    [[1e13 * ((i * 7 + d) % 11 - 5) for d in range(16)] for i in range(70)],  # beyond 64 bits
    [[1e300, -1e300] * 8] * 3 + [[0.0] * 16],                       # beyond the largest integer
    [[0.5, -0.25, 1.0]] * 2 + [[0.1] * 20, []],                      # lengths that 16 does not divide
])
def test_codes_edges(spark, values):
    _check_codes(spark, [(i, i % 2, v) for i, v in enumerate(values)])


def test_codes_empty(spark):
    df = spark.createDataFrame([], CODE_SCHEMA)
    out = C.vector_codes(df)
    assert out.collect() == [] and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        C.vector_codes(df, entries=257)


def test_dictionary():
    rng = np.random.default_rng(0)
    for column in (rng.integers(-9, 9, 500), rng.integers(-2 ** 50, 2 ** 50, 500), np.array([4])):
        values, place = C.dictionary(column)
        assert (values[place] == column).all() and (np.diff(values) > 0).all()
