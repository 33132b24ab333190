"""Helpers shared by the operators: scratch tables in the shared folder."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


_made: list[str] = []    # scratch paths of this driver


def scratch(spark) -> str:
    """A fresh path below the shared folder of ``spark.checkpoint.dir``."""
    _made.append(f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}")
    return _made[-1]


def cleanup(spark) -> int:
    """Remove the scratch tables that this driver has written, and return how many.
    Results read them: call it when what they went into is written. Until then a
    result can be worked out again after the loss of an executor."""
    jvm, gone = spark._jvm, 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. Cuts the lineage:
    what follows survives lost executors and never repeats the work before."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Mark a stored table of id-sized rows for broadcast when its counted size
    allows it; else leave the join to Spark's shuffle joins."""
    return F.broadcast(df) if df.count() <= max_rows else df


def bounded_rows(df: DataFrame, rows: int, seed: int = 0) -> pd.DataFrame:
    """All of ``df``, or an even sample of about ``rows`` and never more, on the
    driver. The rows are counted first and drawn one by one where they lie, so no
    partition sends more than its share and the total is ``rows`` but for chance."""
    total = df.count()
    if total > rows:
        df = df.filter(F.rand(seed) < rows / total)
    return df.toPandas().head(rows)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
