"""Distributions: exact quantiles, claims summary, histogram, category shares
(A1-A7, P3, P4, T6, T7)."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.nulls import clean
from ..functions.text import cut_label, money_label
from ..session import ensure_checkpoint_dir
from .rules import CLAIM_TRUTH, claims_columns
from .schema import ColumnInfo, by_position, columns_of, schema_frame

# Claim percentiles and their labels.
CLAIM_PERCENTILES = ((0.25, "P25"), (0.50, "P50 (Median)"), (0.75, "P75"),
                     (0.90, "P90"), (0.95, "P95"), (0.99, "P99"))
HIST_BINS = 20
TOP_CATEGORIES = 20


SUB_BUCKETS = 4096


def rank_error(k: int) -> float:
    """Rank error that a KLL sketch of size ``k`` keeps in 99 of 100 queries, as a share
    of its values."""
    return 2.296 / k ** 0.9723


def sketch_brackets(sketches: DataFrame, keys: list[str], probs: list[float], k: int) -> DataFrame:
    """``keys + [n, lo, hi]``: values that enclose each target rank, from stored KLL
    sketches (``sketch``) of size ``k``: three times their rank error to either side."""
    err = rank_error(k)
    widths = [4 * err, 3 * err + 0.1, 1.0]       # the function takes constant ranks only
    need = F.lit(3 * err) + F.lit(3.0) / F.col("n")
    inside = lambda x: min(1.0, max(0.0, x))

    def edge(sign: int) -> Column:
        each = [F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(inside(p + sign * w)) for p in probs])) for w in widths]
        return F.when(need <= widths[0], each[0]).when(need <= widths[1], each[1]).otherwise(each[2])

    return sketches.withColumn("n", F.kll_sketch_get_n_double("sketch")).select(*keys, "n", edge(-1).alias("lo"), edge(1).alias("hi"))


def mark_counts(rows: DataFrame, keys: list[str], marks: dict[int, Column]) -> DataFrame:
    """``keys + [i, b, cnt]``: how many rows have the value ``b`` (not null) of mark ``i``.

    Rows are counted by all marks together, and only these combinations are then set
    apart, so no row is copied per mark. Steps of brackets along a line only move at
    their edges: there are no more combinations of them than steps and edges.
    """
    names = {i: f"_m{i + 1}" for i in marks}
    together = rows.select(*keys, *[m.alias(names[i]) for i, m in marks.items()]).groupBy(*keys, *names.values()).agg(
        F.count(F.lit(1)).alias("_n"))
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(name).alias("b")) for i, name in names.items()])
    return together.select(*keys, "_n", F.explode(each).alias("x")).where("x.b IS NOT NULL").groupBy(
        *keys, F.col("x.i").alias("i"), F.col("x.b").alias("b")).agg(F.sum("_n").alias("cnt"))


def quantiles(long: DataFrame, keys: list[str], probs: list[float], method: str = "exact",
              accuracy: int = 10_000, few_groups: bool = False, sketches: DataFrame | None = None,
              sketch_k: int = 1024) -> DataFrame:
    """Linear-interpolated quantiles of ``v`` per ``keys`` group.

    ``long`` holds ``keys + [v]`` with ``v`` a non-null double. Returns
    ``keys + [q_no, p, value]``. ``few_groups`` promises that the number of groups
    is bounded by a schema and lets the small tables of brackets be broadcast.

    ``exact`` never gathers a group into one task. Pass 1 brackets each target
    rank by ``percentile_approx`` (3 ranks and twice the sketch's error to either
    side). Pass 2 counts the values below the brackets and in 4,096 equal steps of
    each bracket, which finds the step that holds the rank. Pass 3 ranks the
    grouped values of that step alone: about n / accuracy / 1,000 of them. A rank
    outside its bracket raises an error. What passes 1 and 2 found is written to the
    checkpoint folder at once, so ``long`` is read three times and no more. With
    ``sketches``, a stored table ``keys + [sketch]`` of the same values' KLL sketches
    (size ``sketch_k``), the brackets come from these and it is read twice; values
    other in number than the sketches' raise an error.
    ``approx`` returns the sketch estimate.
    """
    order = sorted(range(len(probs)), key=lambda i: probs[i])
    ps = [float(probs[i]) for i in order]
    at = lambda values, i: F.element_at(F.array(*[F.lit(x) for x in values]), i + 1)
    if method == "approx":
        est = long.groupBy(*keys).agg(F.percentile_approx("v", F.array(*map(F.lit, ps)), accuracy).alias("_q"))
        out = est.select(*keys, F.posexplode("_q").alias("_i", "value"))
        return out.select(*keys, at(order, F.col("_i")).alias("q_no"), at(ps, F.col("_i")).alias("p"), "value")
    hint = F.broadcast if few_groups else (lambda d: d)
    widths = [3.0 / accuracy, 10.0 / accuracy, 1e-2, 1e-1, 1.0]
    edges = [x for p in ps for d in widths for x in (max(0.0, p - d), min(1.0, p + d))]
    need = F.lit(3.0) / F.col("n") + F.lit(2.0 / accuracy)

    def bound(i: int, side: int) -> Column:
        expr = F.col("_b")[(i * len(widths) + len(widths) - 1) * 2 + side]
        for w in range(len(widths) - 2, -1, -1):
            expr = F.when(F.lit(widths[w]) >= need, F.col("_b")[(i * len(widths) + w) * 2 + side]).otherwise(expr)
        return expr

    q = len(ps)
    if sketches is None:
        brackets = long.groupBy(*keys).agg(
            F.count("v").alias("n"), F.percentile_approx("v", F.array(*map(F.lit, edges)), accuracy).alias("_b"),
        ).select(*keys, "n", F.array(*[bound(i, 0) for i in range(q)]).alias("lo"), F.array(*[bound(i, 1) for i in range(q)]).alias("hi"))
    else:
        brackets = sketch_brackets(sketches, keys, ps, sketch_k)
    ensure_checkpoint_dir(long.sparkSession)
    brackets = brackets.checkpoint()  # a row per group

    v = F.col("v")
    edge = lambda side, i: F.get(F.col(side), F.lit(i))

    def step(i: int) -> Column:
        lo, hi = edge("lo", i), edge("hi", i)
        part = F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * SUB_BUCKETS), F.lit(SUB_BUCKETS - 1))).otherwise(0)
        return F.when((v >= lo) & (v <= hi), part).cast("int")

    # every value once, with the number of brackets that start above it, and once
    # more in each bracket that holds it
    each = F.sequence(F.lit(0), F.lit(q - 1))
    inside = [F.struct(F.lit(i).alias("i"), step(i).alias("b")) for i in range(q)]
    starts_above = reduce(add, [(edge("lo", i) > v).cast("int") for i in range(q)])
    placed = long.join(hint(brackets), list(keys))
    counts = mark_counts(placed, keys, {-1: starts_above} | {i: step(i) for i in range(q)}).checkpoint()
    below = counts.where("i = -1").groupBy(*keys).agg(F.array(*[
        F.coalesce(F.sum(F.when(F.col("b") >= q - i, F.col("cnt"))), F.lit(0)) for i in range(q)]).alias("below"),
        F.sum("cnt").alias("seen"))
    run = Window.partitionBy(*keys, "i").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = (F.col("n") - 1) * at(ps, F.col("i"))
    steps = counts.where("i >= 0").withColumn("upto", F.sum("cnt").over(run)).join(hint(below), list(keys)).join(
        hint(brackets.select(*keys, "n")), list(keys))
    other = F.raise_error(F.lit("the values are not those of the sketches")).cast("bigint")
    start = F.when(F.col("seen") == F.col("n"), F.get("below", F.col("i")) + F.col("upto") - F.col("cnt")).otherwise(other)
    ranks = (steps.withColumn("start", start).withColumn("r_lo", F.floor(h)).withColumn("r_hi", F.ceil(h))
             .withColumn("frac", h - F.floor(h)))
    holds = lambda r: (F.col("start") <= F.col(r)) & (F.col(r) < F.col("start") + F.col("cnt"))
    hits = ranks.where(holds("r_lo") | holds("r_hi")).select(*keys, "i", "b", "start", "r_lo", "r_hi", "frac")
    held = reduce(or_, [v.between(edge("lo", i), edge("hi", i)) for i in range(q)])
    near = placed.where(held).select(*keys, "v", F.explode(F.array(*inside)).alias("x")).where(
        "x.b IS NOT NULL").select(*keys, "v", "x.*")
    values = near.join(hint(hits), [*keys, "i", "b"]).groupBy(
        *keys, "i", "b", "start", "r_lo", "r_hi", "frac", "v").agg(F.count(F.lit(1)).alias("cnt"))
    run = Window.partitionBy(*keys, "i", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = values.withColumn("start", F.col("start") + F.sum("cnt").over(run) - F.col("cnt"))
    pick = lambda r: F.max(F.when(holds(r), F.col("v")))
    out = values.groupBy(*keys, "i", "frac").agg(pick("r_lo").alias("a"), pick("r_hi").alias("z"))
    found = brackets.select(*keys, F.explode(each).alias("i")).join(out, [*keys, "i"], "left")
    sure = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
    return found.select(*keys, at(order, F.col("i")).alias("q_no"), at(ps, F.col("i")).alias("p"),
                        (sure("a") + (sure("z") - sure("a")) * F.col("frac")).alias("value"))


def numeric_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """Unpivot chosen numeric columns to (column, v) without missing values."""
    infos = [c for c in columns_of(df) if c.name in cols]
    arr = F.array(*[F.struct(F.lit(c.name).alias("column"),
                             clean(F.col(c.ref), c.dtype).cast("double").alias("v"))
                    for c in infos])
    return by_position(df).select(F.explode(arr).alias("_x")).select("_x.*").where(F.col("v").isNotNull())


# --------------------------------------------------------------------------
# Claims (R3 picks the columns; A1-A5 measure them)

def claim_columns_of(df: DataFrame) -> dict:
    """R3 for one table, evaluated on its schema (no data read)."""
    spark = df.sparkSession
    r = claims_columns(schema_frame(spark, df, "_")).first()
    return {"amount": r["amount_col"], "flag": r["flag_col"], "count": r["count_col"]}


def claim_predicate(df: DataFrame, cols: dict) -> Column | None:
    """Which rows carry a claim (amount, else flag, else count)."""
    info = {c.name: c for c in columns_of(df)}
    ref = lambda name: F.col("`" + name.replace("`", "``") + "`")
    if cols["amount"]:
        x = clean(ref(cols["amount"]), info[cols["amount"]].dtype)
        return x.isNotNull() & (x > 0)
    if cols["flag"]:
        c = ref(cols["flag"])
        s = F.when(c.isNull(), F.lit("nan")).otherwise(F.lower(c.cast("string")))
        if info[cols["flag"]].kind == "boolean":
            s = F.when(c.isNull(), F.lit("nan")).when(c, "true").otherwise("false")
        return s.isin(*CLAIM_TRUTH)
    if cols["count"]:
        x = clean(ref(cols["count"]), info[cols["count"]].dtype)
        return x.isNotNull() & (x > 0)
    return None


def claims_rate(df: DataFrame, dataset: str = "data") -> DataFrame:
    """A1: claims found, claiming rows and percent (2 dp, over all rows)."""
    cols = claim_columns_of(df)
    pred = claim_predicate(df, cols)
    detected = sorted({c for c in cols.values() if c})
    if pred is None:
        return df.sparkSession.createDataFrame(
            [], "dataset string, detected_fields string, total_claims bigint, claiming_pct double")
    return df.agg(F.count_if(pred).alias("t"), F.count(F.lit(1)).alias("n")).select(
        F.lit(dataset).alias("dataset"),
        F.lit(",".join(detected)).alias("detected_fields"),
        F.col("t").cast("bigint").alias("total_claims"),
        F.round(F.when(F.col("n") > 0, F.col("t") * 100.0 / F.col("n")), 2).alias("claiming_pct"))


def claim_values(df: DataFrame) -> DataFrame | None:
    """Positive claim amounts as ``(column, v)``; None without an amount."""
    cols = claim_columns_of(df)
    if not cols["amount"]:
        return None
    pred = claim_predicate(df, cols)
    return numeric_long(df.where(pred), [cols["amount"]])


_STATS = "dataset string, n bigint, avg_claim double, max_claim double, total_paid double, skewness double"


def _moments(v: Column) -> list[Column]:
    """Aggregates of A2 (but the median) and A3 over the non-null values of ``v``:
    skewness only when n > 3, 0 for constant values."""
    n = F.count(v)
    adj = F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2)
    return [n.cast("bigint").alias("n"), F.avg(v).alias("avg_claim"), F.max(v).alias("max_claim"),
            F.sum(v).alias("total_paid"), F.when(n > 3, F.coalesce(adj, F.lit(0.0))).alias("skewness")]


def claims_moments(df: DataFrame, dataset: str = "data") -> DataFrame:
    """A2 without the median, and A3: one aggregate over positive claim amounts,
    NULLs when there are none."""
    vals = claim_values(df)
    if vals is None:
        return df.sparkSession.createDataFrame([], _STATS)
    return vals.agg(*_moments(F.col("v"))).select(F.lit(dataset).alias("dataset"), "*")


_SUMMARY = ("dataset string, detected_fields string, total_claims bigint, claiming_pct double, "
            "avg_claim double, median_claim double, max_claim double, total_paid double, skewness double")


def claims_summary(df: DataFrame, dataset: str = "data", method: str = "exact",
                   percentiles: DataFrame | None = None) -> DataFrame:
    """A1-A3 in one row; no row when the table has no claims columns. One
    aggregate, and the median from ``percentiles`` (the table's
    ``claims_percentiles``) where they are there already."""
    cols = claim_columns_of(df)
    pred = claim_predicate(df, cols)
    names = [c.split(" ")[0] for c in _SUMMARY.split(", ")]
    if pred is None:
        return df.sparkSession.createDataFrame([], _SUMMARY)
    detected = ",".join(sorted({c for c in cols.values() if c}))
    v = F.lit(None).cast("double")
    if cols["amount"]:
        info = next(c for c in columns_of(df) if c.name == cols["amount"])
        amount = F.col("`" + info.name.replace("`", "``") + "`")
        v = F.when(pred, clean(amount, info.dtype).cast("double"))
    out = df.select(pred.alias("claims"), v.alias("v")).agg(
        F.count_if("claims").cast("bigint").alias("total_claims"), F.count(F.lit(1)).alias("rows"), *_moments(F.col("v")))
    out = out.withColumn("claiming_pct", F.round(F.when(F.col("rows") > 0, F.col("total_claims") * 100.0 / F.col("rows")), 2))
    out = out.select(F.lit(dataset).alias("dataset"), F.lit(detected).alias("detected_fields"), "*")
    if cols["amount"]:
        if percentiles is None:
            percentiles = claims_percentiles(df, dataset, method)
        out = out.join(F.broadcast(percentiles.where("p = 0.5").select("dataset", F.col("value").alias("median_claim"))), "dataset", "left")
    else:
        out = out.withColumns({"median_claim": F.lit(None).cast("double"), "skewness": F.lit(None).cast("double")})
    return out.select(*names)


def claims_amount_stats(df: DataFrame, dataset: str = "data", method: str = "exact") -> DataFrame:
    """A2 + A3: mean, median, max, total and adjusted skewness of positive claim
    amounts; one row of NULLs when no amount is positive."""
    stats = claims_moments(df, dataset)
    vals = claim_values(df)
    if vals is None:
        return stats.withColumn("median_claim", F.lit(None).cast("double")).select(
            "dataset", "n", "avg_claim", "median_claim", "max_claim", "total_paid", "skewness")
    med = quantiles(vals, ["column"], [0.5], method, few_groups=True).select(
        F.lit(dataset).alias("dataset"), F.col("value").alias("median_claim"))
    return stats.join(F.broadcast(med), "dataset", "left").select(
        "dataset", "n", "avg_claim", "median_claim", "max_claim", "total_paid", "skewness")


def claims_percentiles(df: DataFrame, dataset: str = "data", method: str = "exact") -> DataFrame:
    """A4: P25..P99 of positive claim amounts, one row each."""
    vals = claim_values(df)
    if vals is None:
        return df.sparkSession.createDataFrame([], "dataset string, q_no int, label string, p double, value double")
    labels = F.array(*[F.lit(lbl) for _, lbl in CLAIM_PERCENTILES])
    q = quantiles(vals, ["column"], [p for p, _ in CLAIM_PERCENTILES], method, few_groups=True)
    return q.select(F.lit(dataset).alias("dataset"), "q_no",
                    F.element_at(labels, F.col("q_no") + 1).alias("label"), "p", "value")


def claims_histogram(df: DataFrame, dataset: str = "data", bins: int = HIST_BINS) -> DataFrame:
    """A5: equal-width bins over positive claim amounts (only when n > 10),
    last bin closed, empty bins kept; when min = max the range is widened by
    0.5 each side."""
    vals = claim_values(df)
    schema = "dataset string, bin int, label string, lo double, hi double, count bigint"
    if vals is None:
        return df.sparkSession.createDataFrame([], schema)
    rng = vals.agg(F.min("v").alias("mn"), F.max("v").alias("mx"), F.count("v").alias("n")).where(
        F.col("n") > 10).select(
        F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo0"),
        F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi0"))
    # One-row range, joined to every value (broadcast of a single row).
    binned = vals.crossJoin(F.broadcast(rng)).select(
        F.least(F.width_bucket("v", "lo0", "hi0", F.lit(bins)), F.lit(bins)).cast("int").alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    edges = rng.select("lo0", "hi0", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    step = (F.col("hi0") - F.col("lo0")) / bins
    lo = F.col("lo0") + step * (F.col("bin") - 1)
    hi = F.when(F.col("bin") == bins, F.col("hi0")).otherwise(F.col("lo0") + step * F.col("bin"))
    out = edges.select("bin", lo.alias("lo"), hi.alias("hi")).join(F.broadcast(counts), "bin", "left")
    return out.select(
        F.lit(dataset).alias("dataset"), "bin",
        F.concat(money_label(F.col("lo")), F.lit("–"), money_label(F.col("hi"))).alias("label"),
        "lo", "hi", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


# --------------------------------------------------------------------------
# Category shares

TOP_BUCKETS = 1 << 16


def top_values(long: DataFrame, key: str, top: int = TOP_CATEGORIES, buckets: int = TOP_BUCKETS) -> tuple[DataFrame, int]:
    """L2 by a bound: the ``top`` most frequent values of each ``key`` (ties by value),
    exactly, without shuffling all distinct values.

    ``long`` holds ``key`` and a non-null ``value``; the number of keys is bounded by a
    schema. Returns ``(key, value, count, total, rank)`` and how many buckets had to be
    counted by value after the first ones.

    Pass 1 counts rows in ``buckets`` hash buckets a key. A bucket's rows are an upper
    bound for each of its values. Pass 2 counts the values of the ``2 * top`` fullest
    buckets, which gives a lower bound for the last place. Only buckets with at least so
    many rows can hold a better value: mostly none, and the bound has decided; else pass
    3 counts the values of those. In the worst case, values of much the same frequency,
    these are all, and it is a plain group-by.
    """
    spark = long.sparkSession
    ensure_checkpoint_dir(spark)
    rows = long.withColumn("_b", F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    full = Window.partitionBy(key).orderBy(F.desc("n"), "_b")
    place = Window.partitionBy(key).orderBy(F.desc("count"), "value")

    def best(chosen: DataFrame, others: DataFrame | None = None) -> DataFrame:
        # a number per bucket, so the size of the broadcast follows from the parameters
        got = rows.join(F.broadcast(chosen.select(key, "_b")), [key, "_b"]).groupBy(key, "value").agg(F.count(F.lit(1)).alias("count"))
        got = got if others is None else got.unionByName(others.select(key, "value", "count"))
        return got.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top).checkpoint()

    heavy = counts.withColumn("r", F.row_number().over(full)).where(F.col("r") <= 2 * top)
    found = best(heavy)
    last = found.groupBy(key).agg(F.when(F.count(F.lit(1)) == top, F.min("count")).otherwise(0).alias("last"))
    rest = counts.join(heavy.select(key, "_b"), [key, "_b"], "left_anti").join(F.broadcast(last), key).where(F.col("n") >= F.col("last")).checkpoint()
    more = rest.count()
    if more:
        found = best(rest, found)
    total = counts.groupBy(key).agg(F.sum("n").alias("total"))
    return found.join(F.broadcast(total), key).select(key, "value", "count", "total", F.col("rank").cast("int").alias("rank")), more


def _plain_value(c: Column, info: ColumnInfo) -> Column:
    """Equal values with equal hashes: -0.0 as 0.0."""
    x = clean(c, info.dtype)
    return F.when(x == 0, F.lit(0.0).cast(info.dtype)).otherwise(x) if info.is_float else x


def _shares(ranked: DataFrame, dataset: str, *more: str) -> DataFrame:
    return ranked.select(
        F.lit(dataset).alias("dataset"), "column", "rank", cut_label(F.col("value")).alias("label"),
        F.col("count").cast("bigint").alias("count"), F.round(F.col("count") * 100.0 / F.col("total"), 1).alias("pct"), *more)


def category_distribution(df: DataFrame, column: str, dataset: str = "data",
                          top: int = TOP_CATEGORIES, buckets: int = TOP_BUCKETS) -> DataFrame:
    """Share (%) of each value among non-null rows, top ``top`` by count
    (ties by value); labels cut to 20 characters after grouping. The shuffle is
    bounded (``top_values``)."""
    info = {c.name: c for c in columns_of(df)}[column]
    vals = by_position(df).select(F.lit(column).alias("column"), _plain_value(F.col(info.ref), info).alias("value")).where(
        F.col("value").isNotNull())
    return _shares(top_values(vals, "column", top, buckets)[0], dataset)


# Categories that get a share table, in this order.
HEATMAP_CATEGORIES = ("Geography", "Product", "Pet", "Customer", "Policy")


def heatmap_columns(prof_rows: list) -> list[tuple[str, str]]:
    """A7 column choice: the first text (``object``) column of each category."""
    out = []
    for cat in HEATMAP_CATEGORIES:
        cands = sorted((r["ordinal"], r["column"]) for r in prof_rows
                       if r["category"] == cat and r["dtype"] == "object")
        if cands:
            out.append((cat, cands[0][1]))
    return out


def coverage_heatmaps(df: DataFrame, prof: DataFrame, dataset: str = "data",
                      top: int = TOP_CATEGORIES) -> DataFrame:
    """A6 for the chosen column of each heatmap category, all in the same passes:
    the columns are unpivoted, the shuffle is bounded (``top_values``). The profile is
    one row per column, so reading it is schema-sized."""
    rows = prof.select("ordinal", "column", "category", "dtype").collect()
    chosen = heatmap_columns(rows)
    if not chosen:
        return df.sparkSession.createDataFrame(
            [], "dataset string, column string, rank int, label string, count bigint, pct double, category string")
    info = {c.name: c for c in columns_of(df)}
    arr = F.array(*[F.struct(F.lit(cat).alias("category"), F.col(info[col].ref).cast("string").alias("value")) for cat, col in chosen])
    long = by_position(df).select(F.explode(arr).alias("x")).select("x.*").where("value IS NOT NULL")
    names = F.create_map(*[F.lit(x) for pair in chosen for x in pair])
    ranked = top_values(long, "category", top)[0].withColumn("column", names[F.col("category")])
    return _shares(ranked, dataset, "category")
