"""The corpus pipeline: from documents to shards of clean, distinct, mixed text.

Each stage is one operator of ``lakeprobe.llm`` applied to all that the stage
before kept. The driver writes each result as Parquet and reads it again for the
next one; ``run`` does the same in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.llm.common import fresh, stored
from lakeprobe.llm.decontaminate import find_leaks
from lakeprobe.llm.jaccard import one_of_each
from lakeprobe.llm.mixing import in_order, mix
from lakeprobe.llm.sharding import shard, text_size
from lakeprobe.llm.toxicity import score_toxicity, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
N_SHARDS = 8
ORACLE_SQL = None  # training, hashing and scheduling are no SQL; see tests/llm


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject (score below 0.5). The
    model learns from the labels of the given documents. Null and empty texts,
    and all documents where there are no labels, stay."""
    model = train(docs, _table(spark, sf_dir, "labels"))
    out, = fresh(docs, "toxicity")
    return score_toxicity(docs, model, out=out).filter(F.col(f"{out}.score") < 0.5).drop(out)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that with the least id."""
    return one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    out, = fresh(docs, "leaks")
    return find_leaks(docs, _table(spark, sf_dir, "benchmark"), out=out).filter(F.size(out) == 0).drop(out)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix of their sources."""
    return in_order(mix(docs)).select(*[f"`{c}`" for c in docs.columns])


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``shard`` and ``slot``: the mix, cut into shards of near
    equal bytes. The order is that in which the stage before wrote its rows: by
    the number in a file's name, then by the row's place in the file. Documents
    that were not read from files are written first."""
    name, row = fresh(docs, "file_name_", "row_index_")
    place = (F.col("_metadata.file_name").alias(name), F.col("_metadata.row_index").alias(row))
    try:
        placed = docs.select("*", *place)
    except AnalysisException:
        placed = stored(docs).select("*", *place)
    part = F.regexp_extract(name, r"part-(\d+)", 1)
    key = F.shiftleft(F.coalesce(F.try_to_number(part, F.lit("9" * 9)).cast("long"), F.lit(0)), 36) + F.col(row)
    out = shard(placed, key, text_size(F.col("text")), N_SHARDS)
    return out.drop(name, row)


STAGES = [
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
