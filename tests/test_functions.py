from pyspark.sql import functions as F

from lakeprobe.functions import LAYOUTS, money_label, parse_date, parse_layouts, parse_number, size_label


def test_parse_date_layouts(spark):
    texts = ["2024-01-02", "2024/01/02", "01/02/2024", "13/02/2024", "20240102",
             "Jan 5 2024", "2024", "not a date", None, "x" * 100,
             " " * 40 + "2024-01-02" + " " * 30]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(parse_date(F.col("s")).cast("string")).collect()]
    assert got == ["2024-01-02 00:00:00", "2024-01-02 00:00:00", "2024-01-02 00:00:00",
                   "2024-02-13 00:00:00", "2024-01-02 00:00:00", "2024-01-05 00:00:00",
                   "2024-01-01 00:00:00", None, None, None, "2024-01-02 00:00:00"]


def test_parse_number_guards(spark):
    texts = ["1d", "2F", "1e5f", "inf", "nan", " 2 ", "1_000", "1,000", "-3.5e2", ".5", "abc"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(parse_number(F.col("s"))).collect()]
    assert got == [None, None, None, float("inf"), None, 2.0, None, None, -350.0, 0.5, None]


def test_labels(spark):
    df = spark.createDataFrame([(5.0, 512), (2500.0, 2048), (1_250_000.0, 3 * 1_048_576),
                                (999.4, 5 * 1_073_741_824)], "v double, b long")
    rows = df.select(money_label(F.col("v")), size_label(F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [("$5", "512 B"), ("$2K", "2.0 KB"),
                                        ("$1.2M", "3.0 MB"), ("$999", "5.0 GB")]


def test_dates_and_codes_never_reach_the_number_cast(spark, monkeypatch):
    """A failed cast costs an exception a value; an ANSI cast in its place would raise."""
    monkeypatch.setattr(type(F.col("x")), "try_cast", lambda self, t: self.cast(t))
    texts = ["2024-01-02", "1-URGENT", "5-LOW", "01/02/2024", "12:30", "+49 30-1", "1e-5", "-1.5E+3", "0x1p-3", " 7 ", "-.5", "1d", "inf"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r["n"] for r in df.select(parse_number(F.col("s")).alias("n")).collect()]
    assert got == [None] * 6 + [1e-5, -1500.0, 0.125, 7.0, -0.5, None, float("inf")]


def test_words_meet_no_pattern(spark, monkeypatch):
    """A pattern decodes the whole text: words are told from dates and numbers by bytes."""
    odd = ["Jan 5 2024", "Jan 15 2024", "\t2024-01-02", "-2024", "20240102", "2024/01/02", " 01/02/2024 ", "13/02/2024", "2024-01-02 03:04:05",
           "1.5", "INFINITY", "-inf", "NaN", "\n7", "+.5", "7", "Jan  5 2024", "A123456789", "2024010", "", "   ", "é 2024"]
    df = spark.createDataFrame([(t,) for t in odd], "s string")
    got = df.select(parse_number(F.col("s")).alias("n"), parse_layouts(F.col("s")).cast("array<string>").alias("d")).collect()
    dates = {t: LAYOUTS[next(i for i, x in enumerate(r["d"]) if x)] for t, r in zip(odd, got) if r["d"] and any(r["d"])}
    assert dates == {"-2024": "ISO", "Jan 5 2024": "MMM d yyyy", "Jan 15 2024": "MMM d yyyy", "\t2024-01-02": "ISO", "20240102": "yyyyMMdd",
                     "2024/01/02": "yyyy/MM/dd", " 01/02/2024 ": "MM/dd/yyyy", "13/02/2024": "dd/MM/yyyy", "2024-01-02 03:04:05": "ISO"}
    assert {t: r["n"] for t, r in zip(odd, got) if r["n"] is not None} == {
        "-2024": -2024.0, "20240102": 20240102.0, "1.5": 1.5, "INFINITY": float("inf"), "-inf": float("-inf"), "\n7": 7.0, "+.5": 0.5,
        "7": 7.0, "2024010": 2024010.0}
    monkeypatch.setattr(type(F.col("x")), "rlike", lambda self, p: F.raise_error(F.concat(self, F.lit(p))).cast("boolean"))
    words = ["k", "R", "Yes", "P1", "BUILDING", "Customer#000000001", "page_view", "x" * 5000, "Ünï", None]
    df = spark.createDataFrame([(t,) for t in words], "s string")
    got = df.select(parse_number(F.col("s")).alias("n"), parse_layouts(F.col("s")).alias("d"), parse_date(F.col("s")).alias("p")).collect()
    assert all(r["n"] is None and not any(r["d"] or []) and r["p"] is None for r in got)
