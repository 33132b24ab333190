"""DuckDB oracle SQL for the driver's correctness check.

Independent SQL for each registered query, over the same parquet tables
(pre-registered views). Per-column work is generated as ``UNION ALL`` arms
from the known table schemas. Doubles are rounded to 4 digits on both sides.
"""

from __future__ import annotations

import re

import oracle_values as R
from lakeprobe.plans.fixtures import FIXTURES, VIEWS, fixture_sql
from oracle_values import (CATEGORY_RULES, CHECK_NAMES, CLAIM_AMOUNT, CLAIM_COUNT, CLAIM_FLAG,
                           CUSTOMER_EXACT, CUSTOMER_PATTERN, HEATMAP_CATEGORIES, LEAKAGE_OVERRIDE,
                           POLICY_EXACT, POLICY_PATTERN, ROADMAP_STEPS)

AS_OF = "2024-01-10"

# Table schemas (name, type) as in TESTDATA / FIXTURES.
SCHEMAS = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
                 ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
             ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
               ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
               ("event_type", "string"), ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"),
                  ("source", "string"), ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"),
                      ("text", "string")],
    "policy_fx": [("policy_id", "bigint"), ("customer_id", "bigint"),
                  ("inception_date", "timestamp_ntz"), ("claim_amount", "double"),
                  ("claim_count", "int"), ("has_claim", "string"), ("exposure", "double"),
                  ("premium", "double"), ("province", "string"), ("loss_ratio", "double"),
                  ("tenure", "int"), ("renewed", "string")],
    "dirty_fx": [("event_id", "bigint"), ("event_date", "timestamp_ntz"), ("customer_id", "bigint"),
                 ("channel", "string"), ("claim_amount", "double"), ("paid_amount_copy", "double"),
                 ("sparse_score", "double"), ("policy_no", "bigint"), ("mixed_txt", "string"),
                 ("const_txt", "string"), ("renewal_date", "string"), ("net_premium", "double")],
    "labelled_fx": [("doc_id", "bigint"), ("lang", "string"), ("source", "string"),
                    ("n_chars", "bigint"), ("quality_label", "int"), ("toxic_flag", "int")],
}
TABLES = [t for t in SCHEMAS if t not in FIXTURES]
FIXTURE_NAMES = list(FIXTURES)


def src(name: str) -> str:
    return f"({fixture_sql(name)})" if name in VIEWS else name


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def kind(t: str) -> tuple[str, str]:
    if t in ("int", "bigint"):
        return "numeric", "integer"
    if t == "double":
        return "numeric", "float"
    if t == "string":
        return "string", "object"
    if t.startswith("timestamp"):
        return "temporal", "datetime"
    return "nested", "nested"


def category_sql(name: str) -> str:
    n = f"lower(replace({lit(name)}, ' ', '_'))"
    arms = " ".join(f"WHEN regexp_matches({n}, {lit(p)}) THEN {lit(c)}" for c, p in CATEGORY_RULES)
    return (f"CASE WHEN regexp_matches({n}, {lit(LEAKAGE_OVERRIDE)}) THEN 'Potential Leakage' "
            f"ELSE CASE {arms} ELSE 'Other' END END")


def parse_date_sql(x: str) -> str:
    x = f"trim({x})"
    g = (f"CASE WHEN regexp_matches({x}, '^(\\s*[+-]?\\d|[A-Za-z]{{3}} \\d)') THEN "
         f"coalesce(CASE WHEN regexp_matches({x}, '^\\s*[+-]?\\d{{4}}') THEN try_cast({x} AS TIMESTAMP) END, "
         f"CASE WHEN regexp_matches({x}, '^\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}$') THEN try_strptime({x}, '%Y/%m/%d') END, "
         f"CASE WHEN regexp_matches({x}, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') THEN coalesce(try_strptime({x}, '%m/%d/%Y'), try_strptime({x}, '%d/%m/%Y')) END, "
         f"CASE WHEN regexp_matches({x}, '^\\d{{8}}$') THEN try_strptime({x}, '%Y%m%d') END, "
         f"CASE WHEN regexp_matches({x}, '^[A-Za-z]{{3}} \\d{{1,2}} \\d{{4}}$') THEN try_strptime({x}, '%b %d %Y') END) END")
    return g


# The layouts a text column can be read by, in order, as (shape, read by).
LAYOUT_SQL = (
    ("ISO", "^\\s*[+-]?\\d{4}($|-)", "try_cast({x} AS TIMESTAMP)"),
    ("yyyy/MM/dd", "^\\d{4}/\\d{1,2}/\\d{1,2}$", "try_strptime({x}, '%Y/%m/%d')"),
    ("MM/dd/yyyy", "^\\d{1,2}/\\d{1,2}/\\d{4}$", "try_strptime({x}, '%m/%d/%Y')"),
    ("dd/MM/yyyy", "^\\d{1,2}/\\d{1,2}/\\d{4}$", "try_strptime({x}, '%d/%m/%Y')"),
    ("yyyyMMdd", "^\\d{8}$", "try_strptime({x}, '%Y%m%d')"),
    ("MMM d yyyy", "^[A-Za-z]{3} \\d{1,2} \\d{4}$", "try_strptime({x}, '%b %d %Y')"),
)
LAYOUT_COLUMNS = ("booked_date", "paid_date", "due_date", "sent_date", "priority")


def layouts_sql() -> str:
    """CTEs: l (row, column, layout, its place, value as read), w (votes per column and
    layout), b (the layout that reads a column)."""
    arms = []
    for i, c in enumerate(LAYOUT_COLUMNS, 1):
        x = f"trim({q(c)})"
        for k, (name, shape, read) in enumerate(LAYOUT_SQL):
            one = f"CASE WHEN regexp_matches({x}, {lit(shape)}) THEN {read.format(x=x)} END"
            arms.append(f"SELECT order_id, {i} AS ordinal, {lit(c)} AS \"column\", {lit(name)} AS layout, {k} AS k, {one} AS v FROM {src('layout_fx')}")
    return (f"WITH l AS ({' UNION ALL '.join(arms)}), "
            f"w AS (SELECT ordinal, \"column\", layout, k, CAST(count(v) AS BIGINT) AS votes FROM l GROUP BY ALL HAVING count(v) > 0), "
            f"b AS (SELECT ordinal, arg_min(layout, -votes * 10 + k) AS best FROM w GROUP BY ordinal)\n")


def layout_profile_sql() -> str:
    cols = " UNION ALL ".join(f"SELECT {i} AS ordinal, {lit(c)} AS \"column\", count({q(c)}) AS non_null FROM {src('layout_fx')}"
                              for i, c in enumerate(LAYOUT_COLUMNS, 1))
    return layouts_sql() + (
        f"SELECT c.ordinal, c.\"column\", CASE WHEN coalesce(r.n, 0) > c.non_null * 0.7 THEN 'datetime (string)' ELSE 'object' END AS dtype, "
        f"b.best AS date_layout, CAST(coalesce(r.n, 0) AS BIGINT) AS date_parsed, CAST(c.non_null - coalesce(r.n, 0) AS BIGINT) AS bad_dates, "
        f"CAST(coalesce(a.n, 0) - coalesce(r.n, 0) AS BIGINT) AS layout_conflicts, CAST(coalesce(r.f, 0) AS BIGINT) AS future_dates "
        f"FROM ({cols}) c LEFT JOIN b USING (ordinal) "
        f"LEFT JOIN (SELECT l.ordinal, count(v) AS n, count(CASE WHEN v > TIMESTAMP '{AS_OF}' THEN 1 END) AS f FROM l JOIN b ON l.ordinal = b.ordinal AND l.layout = b.best GROUP BY l.ordinal) r USING (ordinal) "
        f"LEFT JOIN (SELECT ordinal, count(DISTINCT order_id) AS n FROM l WHERE v IS NOT NULL GROUP BY ordinal) a USING (ordinal)")


def layout_read_sql() -> str:
    return layouts_sql() + (
        "SELECT order_id, " + ", ".join(f"strftime(any_value(CASE WHEN l.\"column\" = {lit(c)} THEN v END), '%Y-%m-%d') AS {q(c)}" for c in LAYOUT_COLUMNS[:4])
        + " FROM l LEFT JOIN b ON l.ordinal = b.ordinal AND l.layout = b.best WHERE b.best IS NOT NULL OR l.ordinal = 5 GROUP BY order_id")


def parse_number_sql(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '(?i)^\\s*[+-]?(\\d|\\.\\d|inf|nan)') "
            f"AND NOT regexp_matches({x}, '[0-9.][dDfF]\\s*$') AND NOT isnan(try_cast({x} AS DOUBLE)) "
            f"THEN try_cast({x} AS DOUBLE) END")


def profile_arm(ds: str, i: int, name: str, t: str) -> str:
    k, label = kind(t)
    x = q(name)
    nn = f"CAST(count({x}) AS BIGINT)"
    uniq = "CAST(NULL AS BIGINT)" if k == "nested" else f"CAST(count(DISTINCT {x}) AS BIGINT)"
    if k == "string":
        pdx = parse_date_sql(x)
        dp = f"CAST(count({pdx}) AS BIGINT)"
        npd = f"CAST(count({parse_number_sql(x)}) AS BIGINT)"
        dtype = f"CASE WHEN count({pdx}) > count({x}) * 0.7 THEN 'datetime (string)' ELSE 'object' END"
        bad = f"CAST(count_if({x} IS NOT NULL AND {pdx} IS NULL) AS BIGINT)"
        fut = f"CAST(count_if({pdx} > TIMESTAMP '{AS_OF}') AS BIGINT)"
    else:
        dp = npd = "CAST(NULL AS BIGINT)"
        dtype = lit(label)
        bad = "CAST(0 AS BIGINT)"
        fut = f"CAST(count_if({x} > TIMESTAMP '{AS_OF}') AS BIGINT)" if k == "temporal" else "CAST(0 AS BIGINT)"
    neg = f"CAST(count_if({x} < 0) AS BIGINT)" if k == "numeric" else "CAST(NULL AS BIGINT)"
    return (f"SELECT {lit(ds)} AS dataset, {i} AS ordinal, {lit(name)} AS \"column\", {lit(k)} AS kind, "
            f"{dtype} AS dtype, {category_sql(name)} AS category, CAST(count(*) AS BIGINT) AS rows, "
            f"{nn} AS non_null, {uniq} AS unique_values, {dp} AS date_parsed, {npd} AS num_parsed, "
            f"{neg} AS negatives, {bad} AS bad_dates, {fut} AS future_dates FROM {src(ds)}")


def profile_sql(datasets: list[str]) -> str:
    arms = [profile_arm(ds, i, n, t) for ds in datasets for i, (n, t) in enumerate(SCHEMAS[ds])]
    body = "\nUNION ALL\n".join(arms)
    return (f"SELECT *, CASE WHEN rows > 0 THEN non_null / rows END AS coverage, "
            f"round(non_null / rows * 100, 1) AS coverage_pct FROM (\n{body}\n)")


def with_profile(datasets: list[str], select: str) -> str:
    return f"WITH p AS ({profile_sql(datasets)})\n{select}"


def flags(cond: str) -> str:
    return (f"CAST(count_if({cond}) AS BIGINT) AS flagged, "
            f"coalesce(string_agg(CASE WHEN {cond} THEN \"column\" END, ',' ORDER BY \"column\"), '') AS detail")


def status_row(no: int, status: str, value: str, inner: str) -> str:
    return (f"SELECT dataset, {no} AS check_no, {lit(CHECK_NAMES[no - 1])} AS \"check\", {status} AS status, "
            f"round(CAST({value} AS DOUBLE), 4) AS value, flagged, detail FROM ({inner})")


DATE_COLUMN = "(lower(category) LIKE '%date%' OR lower(dtype) LIKE '%date%')"


def profile_checks(p: str = "p") -> dict[int, str]:
    """Status SQL of the checks that read only the profile."""
    def pw(c: str) -> str:
        return f"CASE WHEN {c} = 0 THEN 'pass' ELSE 'warn' END"

    def grouped(cond: str, extra: str = "") -> str:
        return f"SELECT dataset, {extra}{flags(cond)} FROM {p} GROUP BY dataset"

    dc = f"(SELECT * FROM {p} WHERE {DATE_COLUMN})"
    issue = "(rows - non_null + bad_dates > 0 OR future_dates > 0)"
    c4 = "kind IN ('numeric', 'string') AND unique_values <= 1"
    c8 = "category IN ('Identifiers', 'Dates', 'Exposure') AND coverage_pct < 95"
    c9 = "kind = 'string' AND num_parsed > 0 AND num_parsed < non_null * 0.9"
    c10 = "dtype = 'object' AND category <> 'Identifiers' AND unique_values > 100"
    c11 = "(category IN ('Claims', 'Exposure', 'Premium') AND kind = 'numeric' AND negatives > 0)"
    three = "CASE WHEN flagged = 0 THEN 'pass' WHEN flagged < 5 THEN 'warn' ELSE 'fail' END"
    q6 = (f"SELECT d.dataset, coalesce(sum(rows - non_null + bad_dates), 0) AS v, "
          f"CAST(count_if({issue}) AS BIGINT) AS flagged, "
          f"coalesce(string_agg(CASE WHEN {issue} THEN \"column\" END, ',' ORDER BY \"column\"), '') AS detail "
          f"FROM (SELECT DISTINCT dataset FROM {p}) d LEFT JOIN {dc} c "
          f"ON d.dataset = c.dataset GROUP BY d.dataset")
    return {
        1: status_row(1, "CASE WHEN v < 5 THEN 'pass' WHEN v < 20 THEN 'warn' ELSE 'fail' END", "v",
                      grouped("non_null < rows", "sum(rows - non_null) * 100.0 / sum(rows) AS v, ")),
        4: status_row(4, pw("flagged"), "flagged", grouped(c4)),
        5: status_row(5, three, "flagged", grouped("coverage < 0.30")),
        6: status_row(6, pw("flagged"), "v", q6),
        8: status_row(8, pw("flagged"), "flagged", grouped(c8)),
        9: status_row(9, pw("flagged"), "flagged", grouped(c9)),
        10: status_row(10, pw("flagged"), "flagged", grouped(c10)),
        11: status_row(11, pw("flagged"), "v",
                       grouped(c11, f"coalesce(sum(CASE WHEN {c11} THEN negatives END), 0) AS v, ")),
        12: status_row(12, "CASE WHEN v >= 85 THEN 'pass' WHEN v >= 60 THEN 'warn' ELSE 'fail' END", "v",
                       grouped("coverage < 0.5", "avg(coverage * 100) AS v, ")),
    }


def dup_rows_status(ds: str) -> str:
    inner = (f"SELECT {lit(ds)} AS dataset, CAST(n - u AS BIGINT) AS flagged, '' AS detail, n FROM "
             f"(SELECT (SELECT count(*) FROM {src(ds)}) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM {src(ds)})) AS u)")
    pct = "CASE WHEN n > 0 THEN round(flagged * 100.0 / n, 2) ELSE 0.0 END"
    return status_row(2, f"CASE WHEN flagged = 0 THEN 'pass' WHEN {pct} < 5 THEN 'warn' ELSE 'fail' END", pct, inner)


def dup_cols_status(ds: str) -> str:
    cols = [n for n, _ in SCHEMAS[ds]]
    txt = lambda c: f"CAST({q(c)} AS VARCHAR)"
    eqs = [f"count_if({txt(a)} IS DISTINCT FROM {txt(b)}) = 0 AS e_{i}_{j}"
           for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    # pair (later j, first i): i is the first column equal to j
    pair_terms = []
    for j, b in enumerate(cols):
        for i, a in enumerate(cols[:j]):
            earlier = " AND ".join(f"NOT e_{k}_{j}" for k in range(i)) or "TRUE"
            pair_terms.append(f"CASE WHEN e_{i}_{j} AND {earlier} THEN {lit(b + '=' + a)} END")
    arr = "list_sort(list_filter([" + ", ".join(pair_terms) + "], lambda x: x IS NOT NULL))"
    inner = (f"SELECT {lit(ds)} AS dataset, CAST(len({arr}) AS BIGINT) AS flagged, array_to_string({arr}, ',') AS detail "
             f"FROM (SELECT {', '.join(eqs)} FROM {src(ds)})")
    return status_row(3, "CASE WHEN flagged = 0 THEN 'pass' ELSE 'warn' END", "flagged", inner)


def outliers_sql(ds: str) -> str:
    num = [n for n, t in SCHEMAS[ds] if kind(t)[0] == "numeric"]
    arms = []
    for n in num:
        x = q(n)
        arms.append(
            f"SELECT {lit(n)} AS \"column\", q1, q3, q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi, "
            f"(SELECT CAST(count_if({x} < b.q1 - 3 * (b.q3 - b.q1) OR {x} > b.q3 + 3 * (b.q3 - b.q1)) AS BIGINT) FROM {src(ds)}) AS outliers "
            f"FROM (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {src(ds)}) b WHERE q3 - q1 <> 0")
    return "\nUNION ALL\n".join(arms)


def outliers_status(ds: str) -> str:
    inner = (f"SELECT {lit(ds)} AS dataset, coalesce(sum(outliers), 0) AS v, {flags('outliers > 0')} "
             f"FROM ({outliers_sql(ds)})")
    return status_row(7, "CASE WHEN flagged = 0 THEN 'pass' WHEN flagged < 5 THEN 'warn' ELSE 'fail' END", "v", inner)


def status_sql(datasets: list[str]) -> str:
    """All twelve status rows for each dataset (profile CTE ``p`` in scope)."""
    pc = profile_checks()
    arms = [pc[k] for k in (1, 4, 5, 6, 8, 9, 10, 11, 12)]
    for ds in datasets:
        arms += [dup_rows_status(ds), dup_cols_status(ds), outliers_status(ds)]
    return "\nUNION ALL\n".join(arms)


def date_detail_sql(p: str = "p") -> str:
    return (f"SELECT dataset, ordinal, \"column\", rows - non_null AS null_dates, bad_dates, "
            f"rows - non_null + bad_dates AS unparseable, future_dates FROM {p} WHERE {DATE_COLUMN}")


def check_detail_sql(ds: str) -> str:
    """One row per flagged column and number (profile CTE ``p`` in scope)."""
    def arm(no: int, cond: str, metrics: dict[str, str], source: str = "p") -> list[str]:
        return [f"SELECT {lit(ds)} AS dataset, {no} AS check_no, {lit(CHECK_NAMES[no - 1])} AS \"check\", \"column\", "
                f"{lit(m)} AS metric, round(CAST({v} AS DOUBLE), 4) AS value FROM {source} WHERE {cond}" for m, v in metrics.items()]

    gone = "rows - non_null"
    arms = arm(1, f"{gone} > 0", {"missing": gone})
    arms += arm(4, "kind IN ('numeric', 'string') AND unique_values <= 1", {"non_null": "non_null"})
    arms += arm(5, "coverage < 0.3", {"coverage": "coverage"})
    arms += arm(6, f"{DATE_COLUMN} AND ({gone} + bad_dates > 0 OR future_dates > 0)", {
        "null_dates": gone, "bad_dates": "bad_dates", "unparseable": f"{gone} + bad_dates", "future_dates": "future_dates"})
    arms += arm(7, "outliers > 0", {k: k for k in ("outliers", "q1", "q3", "lo", "hi")}, f"({outliers_sql(ds)})")
    arms += arm(8, "category IN ('Identifiers', 'Dates', 'Exposure') AND coverage_pct < 95", {"coverage_pct": "coverage_pct"})
    arms += arm(9, "kind = 'string' AND num_parsed > 0 AND num_parsed < non_null * 0.9", {"numeric_share": "num_parsed / non_null"})
    arms += arm(10, "dtype = 'object' AND category <> 'Identifiers' AND unique_values > 100", {"unique_values": "unique_values"})
    arms += arm(11, "category IN ('Claims', 'Exposure', 'Premium') AND kind = 'numeric' AND negatives > 0", {"negatives": "negatives"})
    arms += arm(12, "coverage < 0.5", {"coverage": "coverage"})
    cols = [n for n, _ in SCHEMAS[ds]]
    for j, b in enumerate(cols):
        same = [f"(SELECT count(CASE WHEN CAST({q(a)} AS VARCHAR) IS DISTINCT FROM CAST({q(b)} AS VARCHAR) THEN 1 END) FROM {src(ds)}) = 0"
                for a in cols[:j]]
        first = " ".join(f"WHEN {e} THEN {i}" for i, e in enumerate(same))
        if same:
            arms += arm(3, "place IS NOT NULL", {"equal_to_place": "place"},
                        f"(SELECT {lit(b)} AS \"column\", CASE {first} END AS place)")
    return "\nUNION ALL\n".join(arms)


# --------------------------------------------------------------------------
# claims

def claim_cols(ds: str) -> dict:
    cols = SCHEMAS[ds]
    num = lambda t: kind(t)[0] == "numeric"
    first = lambda pat, need_num: next((n for n, t in cols if re.search(pat, n, re.I) and (num(t) or not need_num)), None)
    return {"amount": first(CLAIM_AMOUNT, True), "flag": first(CLAIM_FLAG, False),
            "count": first(CLAIM_COUNT, True)}


def claim_pred(ds: str) -> str | None:
    c = claim_cols(ds)
    if c["amount"]:
        return f"({q(c['amount'])} IS NOT NULL AND {q(c['amount'])} > 0)"
    if c["flag"]:
        return f"coalesce(lower(CAST({q(c['flag'])} AS VARCHAR)), 'nan') IN ('1', 'true', 'yes', 'y')"
    if c["count"]:
        return f"({q(c['count'])} IS NOT NULL AND {q(c['count'])} > 0)"
    return None


def claims_sql(ds: str) -> str | None:
    """dataset, detected_fields, total_claims, claiming_pct, skewness (4 dp)."""
    pred = claim_pred(ds)
    if pred is None:
        return None
    c = claim_cols(ds)
    det = ",".join(sorted({v for v in c.values() if v}))
    if c["amount"]:
        x = q(c["amount"])
        skew = (f"(SELECT CASE WHEN count({x}) > 3 THEN coalesce(skewness({x}), 0.0) END FROM {src(ds)} WHERE {pred})")
    else:
        skew = "CAST(NULL AS DOUBLE)"
    return (f"SELECT {lit(ds)} AS dataset, {lit(det)} AS detected_fields, CAST(count_if({pred}) AS BIGINT) AS total_claims, "
            f"round(count_if({pred}) * 100.0 / count(*), 2) AS claiming_pct, round({skew}, 4) AS skewness FROM {src(ds)}")


# --------------------------------------------------------------------------
# rule layer

def rx(pattern: str) -> str:
    return f"regexp_matches(\"column\", {lit(pattern)}, 'i')"


def targets_sql(p: str = "p") -> str:
    flag = rx(R.FREQ_FLAG)
    fcond = f"({flag} OR ({rx(R.FREQ_COUNT)} AND kind = 'numeric'))"
    g = (f"SELECT dataset, "
         f"arg_min(\"column\", ordinal) FILTER (WHERE {fcond}) AS fcol, "
         f"arg_min({flag}, ordinal) FILTER (WHERE {fcond}) AS fflag, "
         f"arg_min(\"column\", ordinal) FILTER (WHERE {rx(R.SEV_AMOUNT)}) AS sev_amt, "
         f"arg_min(\"column\", ordinal) FILTER (WHERE {rx(R.SEV_COUNT)}) AS sev_cnt, "
         f"arg_max(\"column\", ordinal) FILTER (WHERE {rx(R.EL_SEVERITY)}) AS el_sev, "
         f"arg_max(\"column\", ordinal) FILTER (WHERE {rx(R.EL_EXPOSURE)}) AS el_exp, "
         f"arg_max(\"column\", ordinal) FILTER (WHERE {rx(R.EL_FREQUENCY)}) AS el_freq, "
         f"arg_min(\"column\", ordinal) FILTER (WHERE {rx(R.RETENTION)}) AS ret "
         f"FROM {p} GROUP BY dataset")

    def srcs(*cols):
        arr = "[" + ", ".join(cols) + "]"
        return f"array_to_string(list_sort(list_distinct(list_filter({arr}, lambda x: x IS NOT NULL))), ',')"

    arms = [
        f"SELECT dataset, 1 AS seq, CASE WHEN fflag THEN 'Claim Frequency (Binary)' ELSE 'Claim Count (Frequency)' END AS name, "
        f"'Frequency Target' AS type, CASE WHEN fflag THEN fcol || ' = 1 (claim occurred)' ELSE 'SUM(' || fcol || ') / Exposure' END AS formula, "
        f"CASE WHEN fflag THEN 92 ELSE 88 END AS confidence, fcol AS source_columns FROM g WHERE fcol IS NOT NULL",
        f"SELECT dataset, 2, 'Claim Severity', 'Severity Target', "
        f"CASE WHEN sev_cnt IS NOT NULL THEN sev_amt || ' / ' || sev_cnt ELSE sev_amt || ' (where claim > 0)' END, "
        f"CASE WHEN sev_cnt IS NOT NULL THEN 95 ELSE 82 END, {srcs('sev_amt', 'sev_cnt')} FROM g WHERE sev_amt IS NOT NULL",
        f"SELECT dataset, 3, 'Expected Loss', 'Expected Loss Target', "
        f"'(' || el_sev || ' / ' || el_exp || ')' || CASE WHEN el_freq IS NOT NULL THEN ' × ' || el_freq ELSE '' END, 78, "
        f"{srcs('el_sev', 'el_exp', 'el_freq')} FROM g WHERE el_sev IS NOT NULL AND el_exp IS NOT NULL",
        "SELECT dataset, 4, 'Retention / Lapse', 'Retention Target', ret || ' (binary: lapsed vs. retained)', 72, ret FROM g WHERE ret IS NOT NULL",
        f"SELECT dataset, 5 + ordinal, \"column\", 'Explicit Label', \"column\", 75, \"column\" FROM {p} WHERE category = 'Potential Targets'",
    ]
    allt = "\nUNION ALL\n".join(arms)
    return (f"g AS ({g}), t AS ({allt}), "
            f"u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY dataset, lower(name) ORDER BY seq) = 1), "
            f"targets AS (SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY confidence DESC, seq) AS INTEGER) AS target_rank, "
            f"name, type, formula, CAST(confidence AS INTEGER) AS confidence, source_columns FROM u)")


def features_sql(p: str = "p") -> str:
    hv = ", ".join(lit(c) for c in R.HIGH_VALUE_CATEGORIES)
    cls = (f"CASE WHEN category = 'Identifiers' THEN 'Low Value' WHEN category = 'Potential Leakage' THEN 'Potential Leakage' "
           f"WHEN coverage_pct < 20 THEN 'Low Value' WHEN unique_values <= 1 THEN 'Low Value' "
           f"WHEN {rx(R.LEAKAGE)} THEN 'Potential Leakage' WHEN {rx(R.SUSPICIOUS)} THEN 'Suspicious' "
           f"WHEN {rx(R.HIGH_VALUE)} OR category IN ({hv}) THEN 'High Value' ELSE 'Modelling Feature' END")
    conf = (f"CASE WHEN category = 'Identifiers' THEN 95 WHEN category = 'Potential Leakage' THEN 85 "
            f"WHEN coverage_pct < 20 THEN 90 WHEN unique_values <= 1 THEN 98 "
            f"WHEN {rx(R.LEAKAGE)} THEN 75 WHEN {rx(R.SUSPICIOUS)} THEN 70 "
            f"WHEN {rx(R.HIGH_VALUE)} OR category IN ({hv}) THEN least(95, 60 + CAST(floor(coverage_pct / 3) AS INTEGER)) ELSE 55 END")
    rank = " ".join(f"WHEN classification = {lit(k)} THEN {r}" for k, r in R.FEATURE_RANK)
    return (f"f0 AS (SELECT dataset, ordinal, \"column\" AS name, {cls} AS classification, CAST({conf} AS INTEGER) AS confidence "
            f"FROM {p} WHERE category <> 'Potential Targets'), "
            f"f1 AS (SELECT *, CAST(CASE {rank} ELSE 5 END AS INTEGER) AS class_rank FROM f0), "
            f"features AS (SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY class_rank, ordinal) AS INTEGER) AS feature_rank, "
            f"name, classification, confidence, class_rank FROM f1)")


def facts_sql(datasets: list[str]) -> str:
    """CTEs: p (profile), s (status), c (claims), targets, features, facts."""
    claims = [claims_sql(ds) for ds in datasets]
    claims = [c for c in claims if c] or [
        "SELECT CAST(NULL AS VARCHAR) AS dataset, NULL AS detected_fields, NULL AS total_claims, "
        "CAST(NULL AS DOUBLE) AS claiming_pct, CAST(NULL AS DOUBLE) AS skewness WHERE FALSE"]
    return (f"WITH p AS ({profile_sql(datasets)}), s AS ({status_sql(datasets)}), "
            f"c AS ({' UNION ALL '.join(claims)}), {targets_sql()}, {features_sql()}, "
            f"facts AS (SELECT pp.*, coalesce(n_checks, 0) AS n_checks, coalesce(n_pass, 0) AS n_pass, "
            f"coalesce(n_warn, 0) AS n_warn, coalesce(n_fail, 0) AS n_fail, coalesce(n_targets, 0) AS n_targets, "
            f"coalesce(n_high, 0) AS n_high, coalesce(n_leak, 0) AS n_leak, coalesce(n_susp, 0) AS n_susp, "
            f"CASE WHEN c.dataset IS NULL THEN 0 ELSE 1 END AS has_claims, c.claiming_pct, c.skewness FROM "
            f"(SELECT dataset, max(rows) AS rows, avg(coverage_pct) AS avg_cov, count(DISTINCT category) AS n_categories, "
            f"count_if(coverage_pct < 30) AS n_sparse, max(CASE WHEN category = 'Exposure' THEN 1 ELSE 0 END) AS has_exposure, "
            f"max(CASE WHEN category = 'Premium' THEN 1 ELSE 0 END) AS has_premium, "
            f"max(CASE WHEN category = 'Geography' THEN 1 ELSE 0 END) AS has_geo, "
            f"max(CASE WHEN category = 'Pet' THEN 1 ELSE 0 END) AS has_pet, "
            f"max(CASE WHEN category = 'Dates' THEN 1 ELSE 0 END) AS has_dates FROM p GROUP BY dataset) pp "
            f"LEFT JOIN (SELECT dataset, count(*) AS n_checks, count_if(status = 'pass') AS n_pass, "
            f"count_if(status = 'warn') AS n_warn, count_if(status = 'fail') AS n_fail FROM s GROUP BY dataset) ss USING (dataset) "
            f"LEFT JOIN (SELECT dataset, count(*) AS n_targets FROM targets GROUP BY dataset) tt USING (dataset) "
            f"LEFT JOIN (SELECT dataset, count_if(classification = 'High Value') AS n_high, "
            f"count_if(classification = 'Potential Leakage') AS n_leak, count_if(classification = 'Suspicious') AS n_susp "
            f"FROM features GROUP BY dataset) ff USING (dataset) LEFT JOIN c USING (dataset))\n")


def readiness_sql(datasets: list[str]) -> str:
    return facts_sql(datasets) + (
        "SELECT dataset, completeness, quality, target_availability, structural_richness, score, "
        "CASE WHEN score >= 80 THEN 'ready' WHEN score >= 60 THEN 'usable' WHEN score >= 40 THEN 'needs review' "
        "ELSE 'needs preparation' END AS band FROM (SELECT *, "
        "CAST(completeness + quality + target_availability + structural_richness AS INTEGER) AS score FROM ("
        "SELECT dataset, CAST(least(25, round_even(avg_cov / 4, 0)) AS INTEGER) AS completeness, "
        "CAST(CASE WHEN n_checks > 0 THEN least(25, round_even(n_pass / n_checks * 25, 0)) ELSE 12 END AS INTEGER) AS quality, "
        "CAST(CASE WHEN n_targets >= 2 THEN 25 WHEN n_targets = 1 THEN 15 ELSE 5 END AS INTEGER) AS target_availability, "
        "CAST(least(25, n_categories * 3) AS INTEGER) AS structural_richness FROM facts))")


def findings_sql(datasets: list[str]) -> str:
    arms = [
        ("opportunities", 1, "n_targets >= 2", "CAST(n_targets AS VARCHAR) || ' Modelling Targets Available'", "High", 90, "TRUE"),
        ("opportunities", 2, "n_high >= 5", "CAST(n_high AS VARCHAR) || ' High-Value Features Identified'", "High", 80, "FALSE"),
        ("opportunities", 3, "rows >= 100000", "'Large Dataset — Statistical Power Available'", "Medium", 95, "FALSE"),
        ("risks", 1, "n_leak > 0", "CAST(n_leak AS VARCHAR) || ' Potential Leakage Features Detected'", "High", 75, "TRUE"),
        ("risks", 2, "n_sparse > 0", "CAST(n_sparse AS VARCHAR) || ' Sparse Columns — Credibility Risk'", "Medium", 90, "FALSE"),
        ("risks", 3, "coalesce(abs(skewness) > 2, FALSE)", "'Highly Skewed Claim Distribution'", "High", 85, "TRUE"),
        ("analytical_risks", 1, "n_susp > 0", "CAST(n_susp AS VARCHAR) || ' Suspicious Features Require Validation'", "High", 70, "TRUE"),
        ("analytical_risks", 2, "n_targets = 0", "'No Clear Modelling Target Detected'", "High", 80, "TRUE"),
        ("business_observations", 1, "has_claims = 1", "'Claiming Rate: ' || coalesce(CAST(claiming_pct AS VARCHAR), '?') || '%'", "Medium", 95, "FALSE"),
        ("business_observations", 2, "has_geo = 1", "'Geographic Segmentation Available'", "Medium", 85, "FALSE"),
    ]
    note = "CASE WHEN claiming_pct < 20 THEN 'low rate' END"
    parts = [f"SELECT dataset, '{sec}' AS section, {o} AS o, {title} AS title, '{imp}' AS impact, {conf} AS confidence, "
             f"{rev} AS human_review, {note if (sec, o) == ('business_observations', 1) else 'CAST(NULL AS VARCHAR)'} AS note "
             f"FROM facts WHERE {cond}" for sec, o, cond, title, imp, conf, rev in arms]
    parts.append("SELECT dataset, 'quality_issues', check_no, 'FAIL: ' || \"check\", 'High', 95, TRUE, NULL FROM "
                 "(SELECT * FROM s WHERE status = 'fail' QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY check_no) <= 5)")
    parts.append("SELECT dataset, 'quality_issues', check_no + 100, 'WARNING: ' || \"check\", 'Medium', 85, FALSE, NULL FROM "
                 "(SELECT * FROM s WHERE status = 'warn' QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY check_no) <= 4)")
    secs = "CASE section WHEN 'opportunities' THEN 1 WHEN 'risks' THEN 2 WHEN 'quality_issues' THEN 3 WHEN 'analytical_risks' THEN 4 ELSE 5 END"
    return facts_sql(datasets) + (
        f"SELECT dataset, CAST({secs} AS INTEGER) AS section_no, section, "
        f"CAST(row_number() OVER (PARTITION BY dataset, section ORDER BY o) AS INTEGER) AS item_no, title, impact, "
        f"CAST(confidence AS INTEGER) AS confidence, human_review, note FROM ({' UNION ALL '.join(parts)})")


def finding_columns_sql(datasets: list[str]) -> str:
    """One row per finding and column it is about, in order."""
    feature = lambda c: f"SELECT dataset, name AS c, feature_rank AS k FROM features WHERE classification = '{c}'"
    claim = "SELECT dataset, unnest(string_split(detected_fields, ',')) AS c, generate_subscripts(string_split(detected_fields, ','), 1) AS k FROM c"
    by = {
        "% Modelling Targets Available": "SELECT dataset, name AS c, target_rank AS k FROM targets",
        "% High-Value Features Identified": feature("High Value"),
        "% Potential Leakage Features Detected": feature("Potential Leakage"),
        "% Sparse Columns%": "SELECT dataset, \"column\" AS c, ordinal AS k FROM p WHERE coverage_pct < 30",
        "Highly Skewed%": claim,
        "% Suspicious Features Require Validation": feature("Suspicious"),
        "Claiming Rate%": claim,
        "Geographic%": "SELECT dataset, \"column\" AS c, ordinal AS k FROM p WHERE category = 'Geography'",
    }
    arms = [f"SELECT f.dataset, f.section, f.item_no, x.c, x.k FROM f JOIN ({inner}) x ON f.dataset = x.dataset WHERE f.title LIKE {lit(like)}"
            for like, inner in by.items()]
    arms.append("SELECT f.dataset, f.section, f.item_no, x.c, x.k FROM f JOIN (SELECT dataset, \"check\", "
                "unnest(string_split(detail, ',')) AS c, generate_subscripts(string_split(detail, ','), 1) AS k FROM s WHERE detail <> '') x "
                "ON f.dataset = x.dataset AND f.title IN ('FAIL: ' || x.\"check\", 'WARNING: ' || x.\"check\")")
    body = findings_sql(datasets)
    cut = body.index("SELECT dataset, CAST(CASE section")
    return (body[:cut].rstrip() + f", f AS ({body[cut:]}) SELECT dataset, section, item_no, "
            f"CAST(row_number() OVER (PARTITION BY dataset, section, item_no ORDER BY k) - 1 AS INTEGER) AS place, c AS \"column\" "
            f"FROM ({' UNION ALL '.join(arms)})")


def report_columns_sql(ds: str) -> str:
    ready, found = readiness_sql([ds]), findings_sql([ds])
    return (f"SELECT p.dataset, (SELECT score FROM ({ready})) AS score, CAST((SELECT count(*) FROM ({found})) AS INTEGER) AS n_findings, "
            f"ordinal, \"column\", dtype, category, non_null, round(coverage_pct, 4) AS coverage_pct, unique_values FROM ({profile_sql([ds])}) p")


def roadmap_sql(datasets: list[str]) -> str:
    steps = " UNION ALL ".join(
        f"SELECT {i + 1} AS step_order, {lit(k)} AS step_key, {lit(t)} AS title, {lit(pr)} AS priority, "
        f"{lit(ef)} AS effort, {lit(bv)} AS business_value" for i, (k, t, pr, ef, bv) in enumerate(ROADMAP_STEPS))
    gate = ("CASE step_key WHEN 'remediation' THEN n_fail > 0 OR n_warn > 3 WHEN 'exposure' THEN has_exposure = 1 "
            "WHEN 'claims_validation' THEN has_claims = 1 WHEN 'claims_overview' THEN has_claims = 1 "
            "WHEN 'severity' THEN has_claims = 1 WHEN 'frequency' THEN has_claims = 1 WHEN 'geography' THEN has_geo = 1 "
            "WHEN 'pet' THEN has_pet = 1 WHEN 'premium' THEN has_premium = 1 WHEN 'trends' THEN has_dates = 1 "
            "WHEN 'expected_loss' THEN has_claims = 1 AND has_exposure = 1 WHEN 'targets' THEN n_targets > 0 ELSE TRUE END")
    return facts_sql(datasets) + (
        f"SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY step_order) AS INTEGER) AS step_no, step_key, "
        f"replace(title, '{{n}}', CAST(n_targets AS VARCHAR)) AS title, priority, effort, business_value "
        f"FROM facts CROSS JOIN ({steps}) st WHERE {gate}")


# --------------------------------------------------------------------------
# one SQL text per registered query

def _money(x: str) -> str:
    return (f"CASE WHEN {x} >= 1000000 THEN printf('$%.1fM', {x} / 1000000) "
            f"WHEN {x} >= 1000 THEN printf('$%.0fK', {x} / 1000) ELSE printf('$%.0f', {x}) END")


def _ts_text(x: str) -> str:
    """Timestamp as text without trailing zeros in the fraction."""
    s = f"CAST({x} AS VARCHAR)"
    return f"CASE WHEN contains({s}, '.') THEN rtrim(rtrim({s}, '0'), '.') ELSE {s} END"


def _text(name: str, t: str) -> str:
    return _ts_text(q(name)) if t.startswith("timestamp") else f"CAST({q(name)} AS VARCHAR)"


def _round(cols: list[tuple[str, str]]) -> str:
    return ", ".join(f"round({q(n)}, 4) AS {q(n)}" if t == "double" else q(n) for n, t in cols)


def _samples(ds: str, key: str) -> str:
    arms = []
    for i, (n, t) in enumerate(SCHEMAS[ds]):
        if kind(t)[0] == "nested":
            continue
        arms.append(f"SELECT {i} AS ordinal, {lit(n)} AS \"column\", CAST(sample_no AS INTEGER) AS sample_no, value FROM "
                    f"(SELECT {_text(n, t)} AS value, row_number() OVER (ORDER BY {q(key)}, {_text(n, t)}) AS sample_no "
                    f"FROM {src(ds)} WHERE {q(n)} IS NOT NULL) WHERE sample_no <= 5")
    return "\nUNION ALL\n".join(arms)


def _find(pattern: str, exact: tuple, alias: str) -> str:
    n = "lower(replace(\"column\", ' ', '_'))"
    prio = " ".join(f"WHEN {n} = {lit(e)} THEN {i}" for i, e in enumerate(exact))
    prio = f"CASE {prio} WHEN {rx(pattern)} THEN {len(exact)} END"
    return (f"SELECT dataset, arg_min(\"column\", {prio} * 100000 + ordinal) FILTER (WHERE {prio} IS NOT NULL) AS {alias} "
            f"FROM p GROUP BY dataset")


def _claims_cols_sql() -> str:
    num = "kind = 'numeric'"
    return (f"SELECT dataset, arg_min(\"column\", ordinal) FILTER (WHERE {rx(CLAIM_AMOUNT)} AND {num}) AS amount_col, "
            f"arg_min(\"column\", ordinal) FILTER (WHERE {rx(CLAIM_FLAG)}) AS flag_col, "
            f"arg_min(\"column\", ordinal) FILTER (WHERE {rx(CLAIM_COUNT)} AND {num}) AS count_col FROM p GROUP BY dataset")


def _amount_vals(ds: str) -> str:
    c = claim_cols(ds)
    return f"SELECT {q(c['amount'])} AS v FROM {src(ds)} WHERE {claim_pred(ds)}"


def _share(ds: str, col: str, t: str, extra: str = "") -> str:
    x = q(col)
    return (f"SELECT {lit(ds)} AS dataset, {lit(col)} AS \"column\", CAST(rank AS INTEGER) AS rank, "
            f"substr(CAST(value AS VARCHAR), 1, 20) AS label, CAST(cnt AS BIGINT) AS count, "
            f"round(round(cnt * 100.0 / total, 1), 4) AS pct{extra} FROM (SELECT value, cnt, total, "
            f"row_number() OVER (ORDER BY cnt DESC, value) AS rank FROM (SELECT {x} AS value, count(*) AS cnt, "
            f"sum(count(*)) OVER () AS total FROM {src(ds)} WHERE {x} IS NOT NULL GROUP BY {x})) WHERE rank <= 20")


def _heatmap_cols(ds: str) -> list[tuple[str, str, str]]:
    cats = {}
    for i, (n, t) in enumerate(SCHEMAS[ds]):
        nn = n.lower().replace(" ", "_")
        cat = next((c for c, p in CATEGORY_RULES if re.search(p, nn, re.I)), "Other")
        if re.search(LEAKAGE_OVERRIDE, nn, re.I):
            cat = "Potential Leakage"
        if t == "string":
            cats.setdefault(cat, (n, t))
    return [(c, *cats[c]) for c in HEATMAP_CATEGORIES if c in cats]


def _date_range(ds: str) -> str:
    cands = []
    for n, t in SCHEMAS[ds]:
        if not re.search(r"date|dt|year|month", n, re.I):
            continue
        if t == "string":
            cands.append(parse_date_sql(q(n)))
        elif t.startswith("timestamp"):
            cands.append(q(n))
    keep = lambda i, agg: f"CASE WHEN count({cands[i]}) > count(*) * 0.3 THEN {agg}({cands[i]}) END"
    lo = "least(" + ", ".join(keep(i, "min") for i in range(len(cands))) + ")"
    hi = "greatest(" + ", ".join(keep(i, "max") for i in range(len(cands))) + ")"
    return (f"SELECT {lit(ds)} AS dataset, date_min, date_max, CASE WHEN date_min IS NOT NULL THEN date_min || ' → ' || date_max END AS date_range "
            f"FROM (SELECT strftime({lo}, '%Y-%m-%d') AS date_min, strftime({hi}, '%Y-%m-%d') AS date_max FROM {src(ds)})")


# Columns whose distinct values are counted together.
DISTINCT_GROUPS = {
    "customers": (("customer", "c_custkey"), ("orders", "o_custkey")),
    "parts": (("part", "p_partkey"), ("lineitem", "l_partkey")),
    "orders": (("orders", "o_orderkey"), ("lineitem", "l_orderkey")),
    "nations": (("nation", "n_nationkey"), ("customer", "c_nationkey"), ("supplier", "s_nationkey")),
    "texts": (("documents", "text"), ("benchmark", "text")),
    "prices": (("lineitem", "l_extendedprice"), ("orders", "o_totalprice")),
}
STORED = ("dataset, ordinal, \"column\", dtype, category, rows, non_null, round(coverage_pct, 4) AS coverage_pct, date_parsed, "
          "num_parsed, negatives, bad_dates, future_dates")


def distinct_groups_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT {lit(g)} AS name, CAST(count(DISTINCT v) AS BIGINT) AS exact, TRUE AS within_5_percent FROM ("
        + " UNION ALL ".join(f"SELECT CAST({q(c)} AS VARCHAR) AS v FROM {t}" for t, c in pairs) + ")"
        for g, pairs in DISTINCT_GROUPS.items())


def oracle_queries() -> dict[str, str]:
    d = "dirty_fx"
    pc = profile_checks()
    wp = lambda ds, sel: with_profile(ds, sel)
    out = {
        "src_parquet_scan": "SELECT * REPLACE (CAST(l_shipdate AS VARCHAR) AS l_shipdate) FROM lineitem",
        "src_csv_roundtrip": ("SELECT c_custkey, c_name || ', said \"' || c_mktsegment || '\"' || chr(10) || 'and left' AS c_name, "
                              "CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment, c_acctbal > 5000 AS is_rich FROM customer"),
        "src_csv_encoding": ("SELECT c_custkey, c_name || ' é' AS c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, "
                             "c_acctbal, c_mktsegment FROM customer"),
        "meta_shape": (f"SELECT 'lineitem' AS dataset, CAST(count(*) AS BIGINT) AS rows, CAST({len(SCHEMAS['lineitem'])} AS INTEGER) AS columns, "
                       "'PARQUET' AS file_type, TRUE AS has_bytes FROM lineitem"),
        "sink_report_json": wp([d], f"SELECT * REPLACE (CAST(check_no AS BIGINT) AS check_no) FROM ({status_sql([d])})"),
        "check_detail": wp([d], check_detail_sql(d)),
        "outlier_counts": (f"SELECT {lit(d)} AS dataset, \"column\", round(q1, 4) AS q1, round(q3, 4) AS q3, round(lo, 4) AS lo, "
                           f"round(hi, 4) AS hi, outliers FROM ({outliers_sql(d)})"),
        "date_detail": wp([d], date_detail_sql()),
        "claims_summary": "\nUNION ALL\n".join(
            f"SELECT c.dataset, detected_fields, total_claims, round(claiming_pct, 4) AS claiming_pct, round(avg(v), 4) AS avg_claim, "
            f"round(quantile_cont(v, 0.5), 4) AS median_claim, round(max(v), 4) AS max_claim, round(sum(v), 4) AS total_paid, "
            f"any_value(skewness) AS skewness FROM ({claims_sql(n)}) c, ({_amount_vals(n)}) GROUP BY ALL" for n in FIXTURE_NAMES[:2]),
        "roadmap_summary": (f"SELECT dataset, CAST(count(*) AS BIGINT) AS steps, CAST(count_if(priority = 'High') AS BIGINT) AS high_priority "
                            f"FROM ({roadmap_sql(FIXTURE_NAMES)}) GROUP BY dataset"),
        "profile_columns": wp(["lineitem"], "SELECT ordinal, \"column\", dtype, category, non_null, coverage_pct, unique_values FROM p"),
        "profile_coverage": wp(["lineitem"], "SELECT ordinal, \"column\", rows, non_null, round(coverage, 4) AS coverage, round(coverage_pct, 4) AS coverage_pct FROM p"),
        "profile_distinct": wp([d], "SELECT ordinal, \"column\", unique_values FROM p"),
        "profile_types": wp(TABLES + FIXTURE_NAMES, "SELECT dataset, ordinal, \"column\", dtype FROM p"),
        "profile_samples": _samples(d, "event_id"),
        "coverage_summary": wp(TABLES + FIXTURE_NAMES, "SELECT dataset, round(avg(coverage_pct), 1) AS avg_coverage, CAST(count_if(coverage_pct >= 99) AS BIGINT) AS fully_populated, CAST(count_if(coverage_pct < 30) AS BIGINT) AS sparse_columns FROM p GROUP BY dataset"),
        "rule_category": wp(TABLES + FIXTURE_NAMES, "SELECT dataset, ordinal, \"column\", category, non_null, round(coverage_pct, 4) AS coverage_pct FROM p"),
        "rule_find_column": wp(TABLES + FIXTURE_NAMES,
                               f"SELECT d.dataset, a.policy_column, b.customer_column, x.non_null AS policy_non_null, y.non_null AS customer_non_null FROM (SELECT DISTINCT dataset FROM p) d "
                               f"LEFT JOIN ({_find(POLICY_PATTERN, POLICY_EXACT, 'policy_column')}) a USING (dataset) "
                               f"LEFT JOIN ({_find(CUSTOMER_PATTERN, CUSTOMER_EXACT, 'customer_column')}) b USING (dataset) "
                               f"LEFT JOIN p x ON d.dataset = x.dataset AND a.policy_column = x.\"column\" "
                               f"LEFT JOIN p y ON d.dataset = y.dataset AND b.customer_column = y.\"column\""),
        "rule_claims_columns": wp(TABLES + FIXTURE_NAMES, (
            f"SELECT c.dataset, amount_col, flag_col, count_col, a.non_null AS amount_non_null, f.non_null AS flag_non_null, "
            f"n.non_null AS count_non_null FROM ({_claims_cols_sql()}) c "
            + " ".join(f'LEFT JOIN p {t} ON c.dataset = {t}.dataset AND {k}_col = {t}."column"'
                       for t, k in (("a", "amount"), ("f", "flag"), ("n", "count"))))),
        "claims_flag_amount": f"SELECT CAST(count_if(claim_amount IS NOT NULL AND claim_amount > 0) AS BIGINT) AS claims, CAST(count(*) AS BIGINT) AS rows FROM {src('policy_fx')}",
        "claims_flag_count": f"SELECT CAST(count_if(claim_count IS NOT NULL AND claim_count > 0) AS BIGINT) AS claims, CAST(count(*) AS BIGINT) AS rows FROM {src('policy_fx')}",
        "claims_flag_string": f"SELECT CAST(count_if(coalesce(lower(has_claim), 'nan') IN ('1', 'true', 'yes', 'y')) AS BIGINT) AS claims, CAST(count(*) AS BIGINT) AS rows FROM {src('policy_fx')}",
        "claims_rate": f"SELECT dataset, detected_fields, total_claims, claiming_pct FROM ({claims_sql('policy_fx')})",
        "claims_amount_stats": (f"SELECT 'policy_fx' AS dataset, CAST(count(v) AS BIGINT) AS n, round(avg(v), 4) AS avg_claim, "
                                f"round(quantile_cont(v, 0.5), 4) AS median_claim, round(max(v), 4) AS max_claim, "
                                f"round(sum(v), 4) AS total_paid, round(CASE WHEN count(v) > 3 THEN coalesce(skewness(v), 0.0) END, 4) AS skewness "
                                f"FROM ({_amount_vals('policy_fx')})"),
        "claims_skewness": (f"SELECT 'dirty_fx' AS dataset, CAST(count(v) AS BIGINT) AS n, "
                            f"round(CASE WHEN count(v) > 3 THEN coalesce(skewness(v), 0.0) END, 4) AS skewness FROM ({_amount_vals(d)})"),
        "claims_percentiles": "\nUNION ALL\n".join(
            f"SELECT 'policy_fx' AS dataset, CAST({i} AS INTEGER) AS q_no, {lit(lbl)} AS label, CAST({pr} AS DOUBLE) AS p, "
            f"round(quantile_cont(v, {pr}), 4) AS value FROM ({_amount_vals('policy_fx')})"
            for i, (pr, lbl) in enumerate(((0.25, "P25"), (0.5, "P50 (Median)"), (0.75, "P75"), (0.9, "P90"), (0.95, "P95"), (0.99, "P99")))),
        "claims_histogram": (f"WITH v AS ({_amount_vals('policy_fx')}), r AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo0, "
                             f"CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi0 FROM v HAVING count(v) > 10), "
                             f"b AS (SELECT least(CAST(floor(20 * (v - lo0) / (hi0 - lo0)) AS BIGINT) + 1, 20) AS bin FROM v, r), "
                             f"c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin), "
                             f"e AS (SELECT CAST(i AS INTEGER) AS bin, lo0 + (hi0 - lo0) / 20 * (i - 1) AS lo, "
                             f"CASE WHEN i = 20 THEN hi0 ELSE lo0 + (hi0 - lo0) / 20 * i END AS hi FROM r, range(1, 21) t(i)) "
                             f"SELECT 'policy_fx' AS dataset, e.bin, {_money('lo')} || '–' || {_money('hi')} AS label, round(lo, 4) AS lo, "
                             f"round(hi, 4) AS hi, CAST(coalesce(cnt, 0) AS BIGINT) AS count FROM e LEFT JOIN c USING (bin)"),
        "category_distribution": _share("lineitem", "l_quantity", "double"),
        "category_top_parts": _share("lineitem", "l_partkey", "bigint"),
        "category_top_prices": _share("lineitem", "l_extendedprice", "double"),
        "coverage_heatmaps": "\nUNION ALL\n".join(_share("policy_fx", n, t, f", {lit(c)} AS category") for c, n, t in _heatmap_cols("policy_fx")),
        "meta_claim_rate": (f"SELECT 'policy_fx' AS dataset, 'claim_amount' AS claim_column, "
                            f"CAST(count_if(claim_amount IS NOT NULL AND claim_amount > 0) AS BIGINT) AS claiming_entities, "
                            f"round(count_if(claim_amount IS NOT NULL AND claim_amount > 0) * 100.0 / count(*), 2) AS claim_rate FROM {src('policy_fx')}"),
        "meta_unique_entities": (f"SELECT 'policy_fx' AS dataset, 'policy_id' AS policy_column, 'customer_id' AS customer_column, "
                                 f"CAST(count(DISTINCT policy_id) AS BIGINT) AS unique_policies, "
                                 f"CAST(count(DISTINCT customer_id) AS BIGINT) AS unique_customers FROM {src('policy_fx')}"),
        "meta_date_range": _date_range(d),
        "check_missing": wp([d], pc[1]),
        "check_dup_rows": dup_rows_status(d),
        "check_dup_cols": dup_cols_status(d),
        "check_zero_variance": wp([d], pc[4]),
        "check_sparse": wp([d], pc[5]),
        "check_date_integrity": wp([d], pc[6]),
        "check_outliers": outliers_status(d),
        "check_unexpected_nulls": wp([d], pc[8]),
        "check_mixed_types": wp([d], pc[9]),
        "check_cardinality": wp([d], pc[10]),
        "check_negatives": wp([d], pc[11]),
        "check_coverage": wp([d], pc[12]),
        "check_status_all": wp([d], status_sql([d])),
        "scalar_parse_date": f"SELECT event_id, renewal_date, CAST({parse_date_sql('renewal_date')} AS VARCHAR) AS parsed FROM {src(d)}",
        "scalar_parse_number": f"SELECT event_id, mixed_txt, round({parse_number_sql('mixed_txt')}, 4) AS parsed FROM {src(d)}",
        "rule_targets": facts_sql(FIXTURE_NAMES) + (
            "SELECT t.*, (SELECT min(non_null) FROM p WHERE p.dataset = t.dataset AND "
            "list_contains(string_split(t.source_columns, ','), p.\"column\")) AS usable_rows FROM targets t"),
        "rule_features": facts_sql(FIXTURE_NAMES) + "SELECT * FROM features",
        "readiness_score": readiness_sql(FIXTURE_NAMES),
        "findings": findings_sql(FIXTURE_NAMES),
        "finding_columns": finding_columns_sql(FIXTURE_NAMES),
        "report_document": wp([d], status_sql([d])),
        "report_document_columns": report_columns_sql(d),
        "roadmap_steps": roadmap_sql(FIXTURE_NAMES),
        "date_layout_votes": layouts_sql() + ("SELECT 'layout_fx' AS dataset, ordinal, \"column\", layout, votes, layout = best AS chosen "
                                              "FROM w JOIN b USING (ordinal)"),
        "footer_counts": " UNION ALL ".join(
            f"SELECT 'lineitem' AS dataset, {i} AS ordinal, {lit(n)} AS \"column\", CAST(count(*) AS BIGINT) AS rows, CAST(count({q(n)}) AS BIGINT) AS non_null, "
            + ", ".join(f"CAST({f}({q(n)}) AS VARCHAR) AS {a}" if t in ("int", "bigint") else f"CAST(NULL AS VARCHAR) AS {a}" for f, a in (("min", "low"), ("max", "high")))
            + " FROM lineitem" for i, (n, t) in enumerate(SCHEMAS["lineitem"])),
        "footer_checks": wp(TABLES, " UNION ALL ".join((pc[1], pc[5], pc[12]))),
        "profile_observed": wp([d], f"SELECT {STORED} FROM p"),
        "catalog_refresh": wp(["lineitem"], f"SELECT {STORED} FROM p"),
        "catalog_lake": wp(TABLES, f"SELECT {STORED} FROM p"),
        "catalog_features": f"WITH p AS ({profile_sql(TABLES)}), {features_sql()} SELECT * FROM features",
        "catalog_distinct": distinct_groups_sql(),
        "catalog_outliers": (f"SELECT 'lineitem' AS dataset, \"column\", round(q1, 4) AS q1, round(q3, 4) AS q3, round(lo, 4) AS lo, "
                             f"round(hi, 4) AS hi, outliers FROM ({outliers_sql('lineitem')})"),
        "date_layout_profile": layout_profile_sql(),
        "date_layout_read": layout_read_sql(),
    }
    return {k: no_count_if(v) for k, v in out.items()}


def no_count_if(sql: str) -> str:
    """``count_if(x)`` -> ``count(CASE WHEN x THEN 1 END)``: DuckDB's count_if
    gives NULL, not 0, when every input is NULL."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, k, quote = 1, j + len(key), None
        while depth:
            ch = sql[k]
            if quote:
                if ch == quote:
                    quote = None
            elif ch in "'\"":
                quote = ch
            elif ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            k += 1
        inner = no_count_if(sql[j + len(key):k - 1])
        out.append(f"count(CASE WHEN {inner} THEN 1 END)")
        i = k
