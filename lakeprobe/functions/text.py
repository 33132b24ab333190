"""Name normalisation and display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_name(c: Column) -> Column:
    """Lower case, spaces to underscores."""
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def cut_label(c: Column, n: int = 20) -> Column:
    """First ``n`` characters of the text form."""
    return F.substring(c.cast("string"), 1, n)


def money_label(v: Column) -> Column:
    """``$1.2M`` / ``$3K`` / ``$9``; ties round to even first, as the
    reference's formatting does (Java's would round them up)."""
    return (
        F.when(v >= 1_000_000, F.format_string("$%.1fM", F.bround(v / 1_000_000, 1)))
        .when(v >= 1_000, F.format_string("$%.0fK", F.bround(v / 1_000, 0)))
        .otherwise(F.format_string("$%.0f", F.bround(v, 0)))
    )


def size_label(b: Column) -> Column:
    """Byte count as ``1.2 GB`` / ``3.4 MB`` / ``5.6 KB`` / ``7 B``."""
    return (
        F.when(b.isNull(), F.lit(None).cast("string"))
        .when(b >= 1_073_741_824, F.format_string("%.1f GB", b / 1_073_741_824))
        .when(b >= 1_048_576, F.format_string("%.1f MB", b / 1_048_576))
        .when(b >= 1024, F.format_string("%.1f KB", b / 1024))
        .otherwise(F.format_string("%d B", b.cast("long")))
    )


def ymd(ts: Column) -> Column:
    """Timestamp to ``YYYY-MM-DD``."""
    return F.date_format(ts, "yyyy-MM-dd")
