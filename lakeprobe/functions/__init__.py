"""Column-level helpers (JVM-side expressions only, no Python UDFs)."""

from .nulls import clean, is_missing
from .parse import DATE_FORMATS, LAYOUTS, parse_date, parse_date_as, parse_layouts, parse_number
from .text import cut_label, money_label, norm_name, size_label, ymd

__all__ = [
    "clean", "is_missing", "DATE_FORMATS", "LAYOUTS", "parse_date", "parse_date_as", "parse_layouts", "parse_number",
    "cut_label", "money_label", "norm_name", "size_label", "ymd",
]
