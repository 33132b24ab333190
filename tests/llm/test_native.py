"""Operators 1 and 4 against plain Python, and their edge cases."""

import hashlib
import itertools
import re
import time

import pytest
from pyspark.sql import functions as F

from lakeprobe.llm import licenses as L
from lakeprobe.llm import pii as P

TEXTS = [
    None, "", "x", "mail a.b+c@ex-ample.co.uk, or x@y.z_q@r.st end", "a@b.c.d@e.f", "@@a@b@c.d..e@f.g",
    "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 and 0001.2.3.255 1.2.3", "4539 1488 0343 6467 and 4539148803436467 4539148803436468",
    "12 34 5 6 - 7", "call +1 (017) 555-7713 or +49(30)--12 34 5 67, +1 2", "+1+23456789012 é日本 +44 20 7946 0958😀",
    "😀 a@b.cd 😀 9.9.9.9", "a" * 100_000, "1" * 60_000, "1." * 30_000, "1 " * 30_000, "a@" + "b." * 20_000,
    "+1" + "(" * 50_000, "a." * 30_000 + "@", "pay GB82 WEST 1234 5698 7654 32 now; GB83WEST12345698765432",
    "ssn 123-45-6789; 123-45-6780", "K@K.K a@K.bc",
]


def _luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(P.BASE_PATTERNS.items()):
        if kind == "email":  # the plain pattern is quadratic on long runs
            pattern = r"(?<![A-Za-z0-9._%+-])" + pattern if len(text) > 5000 else pattern
        if kind in ("ip", "card") and len(text) > 5000:
            pattern = r"(?<![0-9])" + pattern
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                  "card": 12 <= len(d) <= 19 and _luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "9.9.9.9")], "doc_id long, text string")


def test_pii_equals_plain_search(docs):
    rows = P.op1_pii(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "9.9.9.9" if r.doc_id is None else TEXTS[r.doc_id] or ""
        want = brute_spans(text)
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (r, want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in want) for k in P.BASE]
        assert {x for x in joined.split(",") if x} <= set(r.spans.split(","))


def _seconds(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    P.op1_pii(df).collect()
    start = time.time()
    row = P.op1_pii(df).collect()[0]
    return time.time() - start, row


@pytest.mark.parametrize("piece,columns", [("a 12 ", ()), ("mail ab@cd.ef 12 ", ("n_email",)), ("ssn 123-45-6789 x@y.zz ", ("n_email",)),
                                           ("+1 (017) 555-7713, ", ("n_phone",))])
def test_pii_time_is_in_proportion_to_the_matches(spark, piece, columns):
    few, _ = _seconds(spark, piece * 5_000)
    many, row = _seconds(spark, piece * 50_000)
    assert many < 30 * few + 1 and many < 30
    for c in columns:
        assert row[c] == 50_000
    assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in brute_spans(piece * 50_000)).encode()).hexdigest()


def test_pii_a_million_bytes_of_numbers(spark):
    took, row = _seconds(spark, "a 12 " * 200_000)
    assert row.spans == "" and took < 10
    plan = P.op1_pii(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_pii_context_and_overlap(spark):
    """Context over many short pieces, and added spans against overlapping base ones."""
    texts = ["call 1 2 3 4 5 6 7 8 9 +49 30 1234567", "call" + " 1" * 25 + " +49 30 1234567", "card 4539 1488 0343 6467 4539 1488 0343 6467",
             "ssn 123-45-6789@x.yy ssn 123-45-6789", "iban GB82 WEST 1234 5698 7654 32 and 12.34.56.78", "ssn 123-45-6789 " * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in P.find_pii(df).collect():
        base = [x for x in r.pii if x.kind in P.BASE]
        for x in r.pii:
            before = r.text[max(0, x.start - 40):x.start].lower()
            assert r.text[x.start:x.end] == x.match
            assert x.score == pytest.approx(min(1.0, P._SCORE[x.kind] + (0.3 if re.search(P._CONTEXT[x.kind], before) else 0)))
            assert x.kind in P.BASE or not any(b.start < x.end and x.start < b.end for b in base)
    kinds = {r.doc_id: [x.kind for x in r.pii] for r in P.find_pii(df).collect()}
    assert kinds[3] == ["email", "ssn"] and kinds[5] == ["ssn"] * 3


def test_running_and_below(spark):
    rows = [([5, 1, 4, 1, 7],), ([],), ([3],), (list(range(100)),)]
    df = spark.createDataFrame(rows, "a array<int>")
    got = df.select(P.running(F.col("a"), lambda x, y: x + y), P.running(F.col("a"), F.greatest)).collect()
    for (a,), r in zip(rows, got):
        assert r[0] == list(itertools.accumulate(a)) and r[1] == list(itertools.accumulate(a, max))
    starts = spark.createDataFrame([([1, 1, 4, 9],), ([],)], "s array<int>")
    for v, want in ((0, 0), (1, 0), (2, 2), (5, 3), (99, 4)):
        assert [r[0] for r in starts.select(P.below(F.col("s"), F.lit(v))).collect()] == [want, 0]


def test_pii_confirms_and_scores(docs):
    got = {r.doc_id: r.pii for r in P.find_pii(docs).collect()}
    iban = [x for x in got[19] if x.kind == "iban"]
    assert [TEXTS[19][x.start:x.end] for x in iban] == ["GB82 WEST 1234 5698 7654 32"]
    assert [(x.kind, x.start) for x in got[20]] == [("ssn", 4), ("ssn", 17)]
    assert got[0] == [] and got[1] == []
    ip = next(x for x in got[6] if x.kind == "ip")
    assert ip.score > 0.6  # "ip" stands before it


def test_pii_keeps_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([("a@b.cd", 1, 2)], "text string, pii_text int, pii_email_g int")
    assert P.find_pii(df).columns == ["text", "pii_text", "pii_email_g", "pii"]
    assert P.find_pii(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.find_pii(df.withColumnRenamed("pii_text", "pii"))


LICENSED = [
    None, "", "mit", "Released under the MIT License.", "UNDER, the-mit  license under the MIT license", "cc by nc by nc",
    "Licensed under the Apache License, Version 2.0. CC BY-NC 4.0", "under the mİt license", "under the mit licenſe",
    "This work is licensed under the GNU General Public License, version 3.", "x " * 50_000 + "cc by nc " * 300, "Kcc by nc cc by nK",
    "this work is carefully licensed under the gnu general public license version 3",
]


def test_licenses_equal_plain_search(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LICENSED)] + [(3, LICENSED[3]), (None, "cc by nc")], "doc_id long, text string")
    rows = L.op4_licenses(df).collect()
    assert len(rows) == len(LICENSED) + 2
    for r in rows:
        t = "cc by nc" if r.doc_id is None else LICENSED[r.doc_id] or ""
        w = re.findall(L.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        places = sorted((i, k) for k, p in L.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
        assert r.n_words == len(w) and r.n_base == len(places), r
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({k for _, k in places}))
        assert 0 <= r.score <= 1
    got = {r.doc_id: r.labels for r in rows}
    assert got[9] == "gpl-3" and got[12] == "gpl-3" and got[3] == "mit" and got[6] == "apache-2,cc-by-nc"


def test_licenses_keep_columns(spark):
    df = spark.createDataFrame([("cc by nc", 1, "w")], "text string, row int, w string")
    r = L.scan_licenses(df).first()
    assert (r["row"], r["w"], r["places"][0]["start"]) == (1, "w", 0)
    assert L.scan_licenses(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        L.scan_licenses(df.withColumnRenamed("w", "spans"))
