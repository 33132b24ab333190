"""Fixture views over the test tables (policy_fx, dirty_fx, labelled_fx).

The test tables have no nulls, duplicates, claims or labels; these views add
them. Each is one SQL text that Spark runs with DataFrame parameters and that
other engines run with table names, so both read the very same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import table

POLICY_FX = """
SELECT l_orderkey AS policy_id, l_suppkey AS customer_id, l_shipdate AS inception_date,
  CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_discount END AS claim_amount,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS claim_count,
  CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'no' END AS has_claim,
  l_quantity / 50 AS exposure, l_extendedprice - 2000 AS premium,
  CASE WHEN l_linenumber < 7 THEN concat('P', CAST(l_linenumber AS STRING)) END AS province,
  l_tax AS loss_ratio, l_linenumber AS tenure, l_returnflag AS renewed
FROM {lineitem}
"""

_DIRTY_ARM = """
SELECT event_id, ts AS event_date, user_id AS customer_id, event_type AS channel,
  value AS claim_amount, value AS paid_amount_copy,
  CASE WHEN event_id % 4 = 0 THEN value END AS sparse_score,
  CASE WHEN event_id % 10 <> 0 THEN user_id END AS policy_no,
  CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(user_id AS STRING) END AS mixed_txt,
  'k' AS const_txt,
  CASE WHEN event_id % 20 = 0 THEN 'not a date' ELSE substr(CAST(ts AS STRING), 1, 10) END AS renewal_date,
  value - 10 AS net_premium
FROM {events}"""
DIRTY_FX = _DIRTY_ARM + "\nUNION ALL" + _DIRTY_ARM + " WHERE event_id % 50 = 0\n"

LABELLED_FX = """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality AS quality_label, l.toxic AS toxic_flag
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

# Dates as text: nine in ten day first, or month first, each with the other as minority;
# one column where only a few values decide; one of two other layouts.
_Y, _M, _D = (f"substr(CAST(o_orderdate AS STRING), {a}, {n})" for a, n in ((1, 4), (6, 2), (9, 2)))
_DMY, _MDY = f"concat({_D}, '/', {_M}, '/', {_Y})", f"concat({_M}, '/', {_D}, '/', {_Y})"
LAYOUT_FX = f"""
SELECT o_orderkey AS order_id,
  CASE WHEN o_orderkey % 10 = 0 THEN {_MDY} ELSE {_DMY} END AS booked_date,
  CASE WHEN o_orderkey % 10 = 0 THEN {_DMY} ELSE {_MDY} END AS paid_date,
  CASE WHEN CAST({_D} AS INT) <= 12 OR o_orderkey % 5 = 0 THEN {_DMY} ELSE 'unknown' END AS due_date,
  CASE WHEN o_orderkey % 7 = 0 THEN concat({_Y}, {_M}, {_D}) WHEN o_orderkey % 7 = 1 THEN concat({_Y}, '/', {_M}, '/', {_D})
    ELSE concat(' ', {_Y}, '-', {_M}, '-', {_D}) END AS sent_date,
  o_orderpriority AS priority
FROM {{orders}}
"""

FIXTURES = {
    "policy_fx": (POLICY_FX, ("lineitem",)),
    "dirty_fx": (DIRTY_FX, ("events",)),
    "labelled_fx": (LABELLED_FX, ("documents", "labels")),
}
# Every view by name; the rule keys run over FIXTURES only.
VIEWS = FIXTURES | {"layout_fx": (LAYOUT_FX, ("orders",))}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, deps = VIEWS[name]
    return spark.sql(sql, **{d: table(spark, sf_dir, d) for d in deps})


def fixture_sql(name: str) -> str:
    """The same view as SQL over plain table names."""
    sql, deps = VIEWS[name]
    return sql.format(**{d: d for d in deps})


def dataset(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or a fixture by name."""
    if name in VIEWS:
        return fixture(spark, sf_dir, name)
    return table(spark, sf_dir, name)
