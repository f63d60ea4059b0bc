"""Projection and filter steps that the other operators are written with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlynx.config import DEFAULTS


def select_extend(df: DataFrame, **columns: Column) -> DataFrame:
    """Keep every column and add or overwrite the named ones."""
    return df.withColumns(columns)


def select_project(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Only the named columns, each from a column name or an expression."""
    return df.select(*[
        (F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()
    ])


def select_rename_display(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The listed columns that exist, under their display names, in list order."""
    return df.select(*[F.col(c).alias(n) for c, n in names.items() if c in df.columns])


def filter_flag(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose boolean column is true."""
    return df.where(F.col(flag))


def filter_pair(df: DataFrame, id_a: str, id_b: str, similarity: str,
                threshold: float = DEFAULTS.similarity) -> DataFrame:
    """Pairs of different items at or above a similarity."""
    return df.where((F.col(id_a) != F.col(id_b)) & (F.col(similarity) >= F.lit(threshold)))


def filter_high_risk(scored: DataFrame, threshold: float = DEFAULTS.alert_min) -> DataFrame:
    """Rows whose 0-1 risk score reaches the threshold."""
    return scored.where(F.col("risk_score") >= F.lit(threshold))


def parse_timestamps(df: DataFrame, text_col: str = "timestamp", out: str = "ts") -> DataFrame:
    """Parse ISO-8601 text; unreadable values become NULL."""
    return df.withColumn(out, F.try_to_timestamp(F.col(text_col)))


def drop_null_ts(df: DataFrame, text_col: str = "timestamp", out: str = "ts") -> DataFrame:
    """Parse the timestamp text and drop the rows where it is unreadable."""
    return parse_timestamps(df, text_col, out).dropna(subset=[out])
