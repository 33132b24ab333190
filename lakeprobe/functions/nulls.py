"""The null model.

pandas treats NaN, None and NaT alike as missing; Spark counts NaN as a value
(``count``, ``count(distinct)``) and ``NaN > 0`` is true. Every float column is
passed through :func:`clean` once, so NaN becomes NULL before any metric.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType


def is_float_type(dt: DataType) -> bool:
    return isinstance(dt, (FloatType, DoubleType))


def clean(c: Column, dt: DataType) -> Column:
    """NaN -> NULL for float columns; other types pass through."""
    if is_float_type(dt):
        return F.nanvl(c, F.lit(None).cast(dt))
    return c


def is_missing(c: Column, dt: DataType) -> Column:
    """True for NULL, and for NaN in float columns."""
    if is_float_type(dt):
        return c.isNull() | F.isnan(c)
    return c.isNull()
