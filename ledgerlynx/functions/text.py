"""Number-to-text rules used by the explanation and embedding texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grouped(value: Column, decimals: int) -> Column:
    """``1,234.50`` style, rounded half-even."""
    return F.format_number(value, decimals)


def fixed(value: Column, decimals: int) -> Column:
    """``1234.50`` style, rounded half-even."""
    pattern = "0" if decimals == 0 else "0." + "0" * decimals
    return F.call_function("format_number", value, F.lit(pattern))


def float_text(value: Column) -> Column:
    """Shortest decimal text of a double, in plain notation from 1e-4 to 1e16.

    A plain cast switches to ``1.0E7`` notation at ten million.
    """
    plain = value.cast("string")
    wide = F.regexp_replace(
        plain.cast("decimal(38,17)").cast("string"), r"(\.\d*?[1-9])0+$|\.0+$", "$1")
    wide = F.when(wide.contains("."), wide).otherwise(F.concat(wide, F.lit(".0")))
    size = F.abs(value)
    needs_plain = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    return F.when(needs_plain, wide).otherwise(plain)


def or_blank(value: Column) -> Column:
    """Text of a value; a missing one is the empty string (concat would be NULL)."""
    return F.coalesce(value.cast("string"), F.lit(""))
