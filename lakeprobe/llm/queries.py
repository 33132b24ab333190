"""The queries of the operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .codes import op13_codes
from .decontaminate import op8_decontamination
from .jaccard import op3_jaccard
from .langid import op9_langid
from .licenses import op4_licenses
from .mixing import op10_mixing
from .multiindex import op12_neighbours
from .oracles import oracle_sql
from .pii import op1_pii
from .sharding import op7_sharding
from .spelling import op11_spelling
from .tokens import op2_tokens
from .toxicity import op5_toxicity
from .vectors import op6_vectors


__all__ = ["oracle_sql", "queries"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _over(op: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(*[_table(spark, sf_dir, t) for t in tables])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": _over(op1_pii, "documents"),
        "op2_tokens": _over(op2_tokens, "documents"),
        "op3_jaccard": _over(op3_jaccard, "documents"),
        "op4_licenses": _over(op4_licenses, "documents"),
        "op5_toxicity": _over(op5_toxicity, "documents", "labels"),
        "op6_vectors": _over(op6_vectors, "embeddings"),
        "op7_sharding": _over(op7_sharding, "documents"),
        "op8_decontamination": _over(op8_decontamination, "documents", "benchmark"),
        "op9_langid": _over(op9_langid, "documents"),
        "op10_mixing": _over(op10_mixing, "documents"),
        "op11_spelling": _over(op11_spelling, "documents"),
        "op12_neighbours": _over(op12_neighbours, "embeddings"),
        "op13_codes": _over(op13_codes, "embeddings"),
    }
