"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_or(df: DataFrame, name: str, default) -> Column:
    """``name`` if the frame has it, else ``default``; decided while planning."""
    if name in df.columns:
        return F.col(name)
    return default if isinstance(default, Column) else F.lit(default)


def count_true(condition: Column) -> Column:
    """Number of rows where the condition holds (NULL counts as not holding)."""
    return F.count_if(F.coalesce(condition, F.lit(False)))
