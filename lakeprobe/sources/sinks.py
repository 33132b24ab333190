"""Result sinks (S6): each result table as JSON lines or Parquet, or one JSON document
per dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.report import nan_to_null, report_document


def write_report(results: dict[str, DataFrame], path: str, fmt: str = "json",
                 mode: str = "overwrite") -> list[str]:
    """Write every result table under ``path/<name>``; NaN is written as
    null. Returns the written folders."""
    out = []
    for name, df in results.items():
        target = f"{path.rstrip('/')}/{name}"
        nan_to_null(df).write.mode(mode).format(fmt).save(target)
        out.append(target)
    return out


def write_document(results: dict[str, DataFrame], path: str, mode: str = "overwrite") -> DataFrame:
    """Write ``report_document(results)`` below ``path``: one JSON object per dataset and
    line, with NULLs spelled out. Returns the document, whose schema reads it back."""
    doc = report_document(results)
    doc.write.mode(mode).option("ignoreNullFields", False).json(path)
    return doc
