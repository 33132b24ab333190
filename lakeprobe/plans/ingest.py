"""Profile while writing (S7, C1): the counts of a profile as observed metrics of a write
that happens anyway, so an ingest costs no second scan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.parse import parse_layouts
from ..operators.profile import _LAYOUT, as_of_lit, column_metrics, finish_profile, partial_schema
from ..operators.schema import by_position, columns_of

# Observed metrics pass through Python, whose dates end with the year 9999; digits in text can
# read as a later year, so timestamps travel as text.
_ROWS, _METRICS = partial_schema().replace("timestamp_ntz", "string").split(", ", 1)


def write_profiled(df: DataFrame, path: str, dataset: str = "data", as_of=None, fmt: str = "parquet", mode: str = "errorifexists",
                   partition_by: list[str] | None = None, batch: int = 200) -> DataFrame:
    """Write ``df`` below ``path`` and return its profile without distinct counts
    (``unique_values`` is NULL): a row per column.

    The rows pass through the observation on their way into the files, so the last stage
    counts each written partition once, retries included. ``batch`` columns go into one
    observation. An empty table is written and profiled as such.
    """
    cols, clock = columns_of(df), as_of_lit(as_of)
    text = [ci for ci in cols if ci.kind == "string"]
    p = by_position(df).select("*", *[parse_layouts(F.col(ci.ref)).alias(f"d{ci.ordinal}") for ci in text])
    seen = []
    for start in range(0, max(len(cols), 1), batch):
        seen.append(Observation(f"profile-{uuid.uuid4().hex}"))
        p = p.observe(seen[-1], F.count(F.lit(1)).alias("rows"),
                      F.array(*[column_metrics(ci, clock) for ci in cols[start:start + batch]]).cast(f"array<struct<{_METRICS}>>").alias("m"))
    out = p.select(*[F.col(ci.ref).alias(ci.name) for ci in cols])
    writer = out.write.mode(mode).format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    rows = [(o.get["rows"], *m) for o in seen for m in o.get["m"]]
    sent = df.sparkSession.createDataFrame(rows, f"{_ROWS}, {_METRICS}").coalesce(1)
    parts = sent.withColumns({"last": F.col("last").cast("timestamp_ntz"), "layouts": F.col("layouts").cast(_LAYOUT)})
    return finish_profile(parts.withColumn("unique_values", F.lit(None).cast("bigint")).withColumn("dataset", F.lit(dataset)))
