"""Duplicates found by comparing fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlynx.functions import money
from ledgerlynx.functions.skew import attach_by_key

EXACT_FIELDS = ("vendor_id", "amount", "description")


def dup_key_counts(invoices: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Size, first id and total amount of each group of equal ``fields``."""
    return invoices.groupBy(*(fields or EXACT_FIELDS)).agg(
        F.count(F.lit(1)).alias("duplicate_count"),
        F.min("invoice_id").alias("first_invoice_id"),
        money.total("group_total"),
    )


def exact_duplicates(invoices: DataFrame, exact_match_fields: Sequence[str] | None = None) -> DataFrame:
    """Each invoice with the size and total of its group of equal fields.

    Groups are aggregated first and only the ones with more than one member
    are joined back, so a huge group of copies is never held by one task.
    """
    fields = list(exact_match_fields or EXACT_FIELDS)
    repeated = dup_key_counts(invoices, fields).where(F.col("duplicate_count") > 1)
    marked = attach_by_key(
        invoices, repeated, fields, "duplicate_count", "invoice_id",
        how="left", null_safe=True)
    return marked.selectExpr(
        *[f"`{c}`" for c in invoices.columns],
        "duplicate_count IS NOT NULL AS is_duplicate",
        "coalesce(duplicate_count, 1L) AS duplicate_count",
        "coalesce(group_total, amount) AS duplicate_group_total",
        "coalesce(first_invoice_id, invoice_id) AS first_invoice_id")


def fuzzy_duplicates(
    invoices: DataFrame,
    amount_tolerance: float = 0.01,
    normalize: bool = False,
) -> DataFrame:
    """Groups of one vendor, description and 100-unit amount bucket, with their
    spread; a group within the tolerance is flagged."""
    description = F.col("description")
    if normalize:
        description = F.lower(F.trim(F.regexp_replace(description, r"\s+", " ")))
    groups = invoices.groupBy(
        "vendor_id",
        description.alias("desc_normalized"),
        ((F.col("amount") / F.lit(100.0)).cast("bigint") * 100).alias("amount_bucket"),
    ).agg(
        F.count(F.lit(1)).alias("count_in_bucket"),
        F.min("amount").alias("min_amount"),
        F.max("amount").alias("max_amount"),
    )
    spread = F.try_divide(F.col("max_amount") - F.col("min_amount"), F.col("max_amount"))
    flag = (F.col("count_in_bucket") > 1) & (spread <= F.lit(amount_tolerance))
    return groups.select(
        "*",
        (spread * F.lit(100.0)).alias("amount_spread_pct"),
        F.coalesce(flag, F.lit(False)).alias("is_fuzzy_duplicate_group"),
    )
