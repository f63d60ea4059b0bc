"""Duplicate pairs on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlynx.config import DEFAULTS
from ledgerlynx.functions.vectors import dot, norm
from ledgerlynx.operators.embedding import Embedder, compute_embeddings

#: Windows that a slot of the state is long: a row is kept 2 + 2 / SLOT_WINDOWS times.
SLOT_WINDOWS = 4


def stream_duplicates(
    invoices: DataFrame,
    similarity_threshold: float = DEFAULTS.similarity,
    time_window_hours: int = 24,
    watermark: str = "1 day",
    embedder: str | Embedder = "hash",
) -> DataFrame:
    """Similar invoices of one vendor within a time window, each pair once per order.

    An interval self-join: the time bound lets the state store forget rows once
    the watermark has passed. The similarity is part of the join condition, so
    only matching pairs leave the join. The equality key holds a time slot of ``SLOT_WINDOWS`` windows
    beside the vendor, so a busy vendor spans many state partitions: the left copy of a row is in its
    own slot, the right one in each slot that its window reaches (one or two), and a pair meets once.
    """
    rows = compute_embeddings(invoices, embedder).withWatermark("ts", watermark)
    length = norm(F.col("embedding"))
    unit = rows.select(
        "invoice_id", "vendor_id", "amount", "ts",
        F.transform("embedding", lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0)))
        .alias("unit"))
    window = time_window_hours * 3_600_000_000
    slot = lambda shift: F.floor((F.unix_micros("ts") + F.lit(shift)) / F.lit(max(1, SLOT_WINDOWS * window)))
    slots = {1: slot(0), 2: F.explode(F.sequence(slot(-window), slot(window)))}
    a, b = (unit.select(*[F.col(c).alias(f"{c}_{i}") for c in unit.columns], slots[i].alias(f"slot_{i}")) for i in (1, 2))
    reach = F.expr(f"INTERVAL {time_window_hours} HOURS")
    similarity = F.round(dot(F.col("unit_1"), F.col("unit_2")), 6)
    return a.join(
        b,
        F.col("vendor_id_1").eqNullSafe(F.col("vendor_id_2"))  # those without a vendor are one block, as in batch
        & (F.col("slot_1") == F.col("slot_2"))
        & (F.col("ts_2") >= F.col("ts_1") - reach)
        & (F.col("ts_2") <= F.col("ts_1") + reach)
        & (F.col("invoice_id_1") != F.col("invoice_id_2"))
        & (similarity >= F.lit(similarity_threshold)),
    ).select(
        "invoice_id_1", "invoice_id_2", "amount_1", "amount_2", "ts_1", "ts_2",
        similarity.alias("similarity"))
