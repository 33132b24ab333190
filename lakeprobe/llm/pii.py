"""Operator 1, personal data: patterns propose spans, checksums confirm them,
context words adjust the score. DataFrame functions only.

Positions come from one split and one extract of the same pattern: the k-th
match starts after the first k gaps and k-1 matches, all counted in code points.

Every pattern is written so that a search is linear in the text: runs are taken
possessively and a match may only start where its run starts (or where the
match before ended). This finds exactly the leftmost non-overlapping matches of
the plain patterns in ``BASE_PATTERNS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

# The plain patterns of the base kinds, in their order.
BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = tuple(BASE_PATTERNS)
# The same matches, found in linear time.
_SEARCH = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
KINDS = tuple(_SEARCH)
# A text without this cannot match the kind.
_NEEDS = {"email": "@", "phone": "+"}
# Score of a confirmed match without context, and the words that raise it.
_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
_CONTEXT = {
    "email": r"\b(e-?mail|contact|write to|mailto)\b",
    "ip": r"\b(ip|address|host|server|login)\b",
    "card": r"\b(card|visa|mastercard|amex|credit|payment)\b",
    "phone": r"\b(phone|tel|telephone|call|mobile|fax)\b",
    "iban": r"\b(iban|account|bank|transfer)\b",
    "ssn": r"\b(ssn|social security|tax id)\b",
}
CONTEXT_CHARS, CONTEXT_BONUS, MIN_SCORE = 40, 0.3, 0.5
_SPAN = "array<struct<kind:string,start:int,end:int,match:string,score:double>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(acc, i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN (blanks removed) passes the mod-97 check."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(acc, c):
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97
    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), add) == 1


def _confirmed(kind: str, m: Column) -> Column:
    """The checksum or range rule of a kind over one matched string."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(r"^(?:(?:^|\.)0*+(?:[1-9]?[0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?=\.|$)){4}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), luhn(digits))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        bare = F.replace(m, F.lit(" "), F.lit(""))
        return F.length(bare).between(15, 34) & mod97(bare)
    if kind == "ssn":
        return ~m.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often it is read."""
    return F.transform(F.array(value), body)[0]


_POWERS = tuple(1 << i for i in range(31))


def running(values: Column, combine) -> Column:
    """Running combination (sum, largest) of an array: each pass reaches twice as far
    back, so n values take n log n steps and no array is grown piece by piece."""
    return let(values, lambda all: F.aggregate(
        F.filter(F.array(*map(F.lit, _POWERS)), lambda s: s < F.size(all)), all,
        lambda acc, s: F.transform(acc, lambda x, i: F.when(i >= s, combine(F.get(acc, i - s), x)).otherwise(x))))


def below(starts: Column, value: Column) -> Column:
    """How many of the ascending ``starts`` are less than ``value``, by halving."""
    return F.aggregate(F.array(*map(F.lit, reversed(_POWERS))), F.lit(0), lambda at, s: F.when(
        (F.size(starts) - at >= s) & (F.get(starts, at + s - 1) < value), at + s).otherwise(at))


def _spans(kind: str, gaps: Column, found: Column) -> Column:
    """Confirmed and scored spans from the gaps and matches of one pattern."""
    ends = running(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m)), lambda a, b: a + b)
    numbered = F.zip_with(F.transform(found, lambda m, i: F.struct(m.alias("match"), i.alias("i"))), ends, lambda m, e: F.struct(
        m["match"].alias("match"), m["i"].alias("i"), (e - F.length(m["match"])).alias("start"), e.alias("end")))
    good = F.filter(numbered, lambda x: _confirmed(kind, x["match"]))
    # what stands before a match: the ends of the gaps and matches before it, of which
    # each match has a character at least
    tail = lambda c: F.right(c, F.lit(CONTEXT_CHARS))
    pieces = F.zip_with(gaps, found, lambda g, m: F.struct(tail(g).alias("gap"), F.concat(tail(g), tail(F.coalesce(m, F.lit("")))).alias("both")))

    def scored(x, all):
        back = F.least(x["i"], F.lit(CONTEXT_CHARS))
        before = F.concat(F.array_join(F.transform(F.slice(all, x["i"] - back + 1, back), lambda p: p["both"]), ""), F.get(all, x["i"])["gap"])
        score = _SCORE[kind] + F.when(F.lower(tail(before)).rlike(_CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                        x["match"].alias("match"), F.least(score, F.lit(1.0)).alias("score"))

    good = let(F.struct(good.alias("good"), pieces.alias("pieces")), lambda z: F.transform(
        z["good"], lambda x: scored(x, z["pieces"])))
    if kind not in BASE:
        good = F.filter(good, lambda x: x["score"] >= MIN_SCORE)
    return F.when(F.size(found) > 0, good).otherwise(F.array().cast(_SPAN))


def find_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add ``out``: the personal data of each text, as an array of
    ``(kind, start, end, match, score)`` ordered by start, then kind.

    Kinds ``email``, ``ip``, ``card`` and ``phone`` are the base kinds, found in
    every text by their patterns and kept whenever their check passes. ``iban``
    (mod-97) and ``ssn`` (needs a context word) are added; they are dropped where
    they overlap a base span.

    A null or empty text has an empty array. All rows and columns stay; repeated
    rows are handled one by one; helper columns never clash. Texts of any length
    are searched whole, in time linear in the text and n log n in its matches. No
    shuffle.
    """
    t, = fresh(df, "pii_text")
    names = fresh(df, *[f"pii_{k}{p}" for k in KINDS for p in ("_g", "_m", "")], out)
    if names.pop() != out:
        raise ValueError(f"column {out} exists")
    trio = {k: names[3 * i:3 * i + 3] for i, k in enumerate(KINDS)}
    cur = df.withColumn(t, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    has = {k: F.contains(F.col(t), F.lit(c)) for k, c in _NEEDS.items()}
    digit = F.col(t).rlike("[0-9]")
    none = F.array().cast("array<string>")
    pieces = {}
    for k in KINDS:
        g, m, _ = trio[k]
        can = has.get(k, digit)
        pieces[g] = F.when(can, F.split(F.col(t), _SEARCH[k], -1)).otherwise(none)
        pieces[m] = F.when(can, F.regexp_extract_all(F.col(t), F.lit(_SEARCH[k]), F.lit(0))).otherwise(none)
    cur = cur.withColumns(pieces)
    cur = cur.withColumns({trio[k][2]: _spans(k, F.col(trio[k][0]), F.col(trio[k][1])) for k in KINDS})
    base = F.concat(*[F.col(trio[k][2]) for k in BASE])
    # an added span overlaps if, of the base spans that start before its end, one ends after its start
    spans = F.array_sort(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))
    reach = let(spans, lambda b: F.struct(F.transform(b, lambda x: x["start"]).alias("starts"), running(
        F.transform(b, lambda x: x["end"]), F.greatest).alias("ends")))
    added = F.concat(*[F.col(trio[k][2]) for k in KINDS if k not in BASE])
    added = F.when(F.size(added) > 0, let(F.struct(added.alias("added"), reach.alias("reach")), lambda z: F.filter(
        z["added"], lambda x: ~F.coalesce(F.get(z["reach"]["ends"], below(z["reach"]["starts"], x["end"]) - 1) > x["start"], F.lit(False))))).otherwise(added)
    order = {k: i for i, k in enumerate(KINDS)}
    rank = lambda c: F.element_at(F.create_map(*[F.lit(v) for kv in order.items() for v in kv]), c)
    keyed = F.transform(F.concat(base, added), lambda x: F.struct(
        x["start"].alias("s"), rank(x["kind"]).alias("r"), x.alias("x")))
    cur = cur.withColumn(out, F.transform(F.array_sort(keyed), lambda x: x["x"]))
    return cur.select([f"`{c}`" for c in df.columns] + [out])


def digest(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_pii(docs: DataFrame) -> DataFrame:
    """The digest columns of the query over ``documents``."""
    p = find_pii(docs.select("doc_id", "text"))
    of = lambda k: lambda x: x["kind"] == k
    is_base = lambda x: x["kind"].isin(*BASE)
    return p.select(
        "doc_id",
        *[F.size(F.filter("pii", of(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(digest(F.filter("pii", is_base)), 256).alias("base_sha256"),
        digest(F.col("pii")).alias("spans"),
        F.array_max(F.transform("pii", lambda x: x["score"])).alias("top_score"))
