"""Operator 4, license scans by diagonal voting. DataFrame functions only.

All rolling word k-grams of all texts are joined to the positions of the same
k-gram in the license templates. A copy of a template lines up on one diagonal
(document position minus template position); a copy with words added or left out
on neighbouring ones. Votes are counted per diagonal, neighbouring diagonals are
merged, and a merged span is accepted when enough of its template is covered.

The join compares the hash and then the words themselves, so a vote is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Phrases whose places are reported as they stand, and labels.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
# Template sentences of the labels, in words of lower case.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
            "and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted "
              "provided that the following conditions are met"),
)
K = 3              # words of a gram; no phrase is shorter
MERGE = 2          # diagonals this near belong to one copy
COVER = 0.6        # share of a template's grams that a span must hold
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased. ``lower`` also changes other
    letters, which no template holds; the one that would become an ASCII letter
    by itself, the Kelvin sign, is put out of the way first."""
    plain = F.lower(F.replace(text, F.lit("K"), F.lit("ĸ")))
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def template_grams(spark: SparkSession) -> DataFrame:
    """One row per gram of each template: a fixed table of some ninety rows."""
    rows = []
    for tid, (label, text) in enumerate([*PHRASES.items(), *TEMPLATES]):
        w = text.split()
        for i in range(len(w) - K + 1):
            rows.append((tid, label, tid < len(PHRASES), len(w) - K + 1, i, " ".join(w[i:i + K])))
    g = spark.createDataFrame(rows, "tid int, label string, phrase boolean, n_grams int, tpos int, tgram string")
    return g.withColumn("thash", F.xxhash64("tgram"))


def license_votes(df: DataFrame, text: str = "text") -> DataFrame:
    """Votes ``(row, n_words, rest, tid, label, phrase, n_grams, tpos, pos)``. One
    row with a null ``tid`` stands for every text itself and alone carries its
    other columns (``rest``), so no text is lost and votes stay narrow."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != text]
    cur = df.select(
        F.monotonically_increasing_id().alias("row"), (F.struct(*rest) if rest else F.struct(F.lit(0).alias("_"))).alias("rest"),
        words(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("w"))
    grams = F.when(F.size("w") >= K, F.transform(
        F.sequence(F.lit(0), F.size("w") - K),
        lambda i: F.concat_ws(" ", *[F.get(F.col("w"), i + j) for j in range(K)]))).otherwise(
            F.array().cast("array<string>"))
    # a null in front stands for the text itself
    cur = cur.select("row", "rest", F.size("w").cast("long").alias("n_words"),
                     F.concat(F.array(F.lit(None).cast("string")), grams).alias("g"))
    cur = cur.select("row", "rest", "n_words", F.posexplode("g").alias("pos", "gram"))
    cur = cur.withColumn("hash", F.xxhash64("gram"))
    t = F.broadcast(template_grams(df.sparkSession))  # fixed size
    hit = cur.join(t, (F.col("hash") == F.col("thash")) & (F.col("gram") == F.col("tgram")), "left")
    return hit.filter("tid IS NOT NULL OR pos = 0").select(
        "row", "n_words", F.when(F.col("pos") == 0, F.col("rest")).alias("rest"),
        "tid", "label", "phrase", "n_grams", "tpos", (F.col("pos") - 1).alias("pos"))


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """Each row of ``df`` without its text, with ``n_words``, ``places`` (starts of
    the phrases, an array of ``(label, start)``), ``spans`` (accepted copies of
    templates, an array of ``(label, start, end, score)`` in words) and
    ``row_score`` (share of the best covered template, 0 without votes).

    A null or empty text has no words and no spans. Repeated rows are scanned one
    by one; other columns stay. Raises ``ValueError`` when one of them has the
    name of a new column. Texts are scanned whole; only votes (a few per license
    line) and one small row per text are shuffled, once.
    """
    new = ("n_words", "places", "spans", "row_score")
    rest = [c for c in df.columns if c != text]
    if clash := {c.lower() for c in rest} & set(new):
        raise ValueError(f"columns {sorted(clash)} exist")
    v = license_votes(df, text).repartition("row").withColumn("diag", F.col("pos") - F.col("tpos"))
    d = v.groupBy("row", "tid", "diag").agg(
        F.max("n_words").alias("n_words"), F.first("rest", True).alias("rest"),
        F.max("label").alias("label"), F.max("phrase").alias("phrase"),
        F.max("n_grams").alias("n_grams"), F.collect_set("tpos").alias("tset"),
        F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    by = W.partitionBy("row", "tid").orderBy("diag")
    gap = F.when(F.col("diag") - F.lag("diag").over(by) <= MERGE, 0).otherwise(1)
    d = d.withColumn("gap", F.when(F.col("phrase"), 1).otherwise(gap)).withColumn("span", F.sum("gap").over(by))
    s = d.groupBy("row", "tid", "span").agg(
        F.max("n_words").alias("n_words"), F.first("rest", True).alias("rest"),
        F.max("label").alias("label"), F.max("phrase").alias("phrase"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("tset")))) / F.max("n_grams")).alias("cover"),
        F.min("lo").cast("long").alias("lo"), (F.max("hi") + K).cast("long").alias("hi"))
    place = F.col("phrase") & (F.col("cover") == 1)
    good = ~F.col("phrase") & (F.col("cover") >= COVER)
    r = s.groupBy("row").agg(
        F.max("n_words").alias("n_words"), F.first("rest", True).alias("rest"),
        F.array_sort(F.collect_list(F.when(place, F.struct("label", F.col("lo").alias("start"))))).alias("places"),
        F.array_sort(F.collect_list(F.when(good, F.struct(
            "label", F.col("lo").alias("start"), F.col("hi").alias("end"),
            F.col("cover").alias("score"))))).alias("spans"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("row_score"))
    return r.select(*[F.col("rest").getField(c).alias(c) for c in rest], *new)


def op4_licenses(docs: DataFrame) -> DataFrame:
    """The digest columns of the query over ``documents``."""
    s = scan_licenses(docs.select("doc_id", "text"))
    starts = F.transform("places", lambda x: x["start"])
    names = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return s.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(names("places")).alias("base_labels"),
        joined(F.concat(names("places"), names("spans"))).alias("labels"),
        F.col("row_score").alias("score"))
