"""Vendor statistics and the checks of an invoice against its vendor's history.

``history`` says which of the vendor's invoices count:

* ``final``    all of them, the row itself included (the state at end of input)
* ``arrival``  the ones up to and including the row, by (ts, invoice_id)
* ``prior``    only the ones before it
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlynx.config import DEFAULTS
from ledgerlynx.functions import money
from ledgerlynx.functions.skew import attach_by_key
from ledgerlynx.schemas import INVOICE_COLUMNS, VENDOR_STATS_COLUMNS
from ledgerlynx.session import scratch_path

STATS_COLUMNS = [c for c in VENDOR_STATS_COLUMNS if c != "vendor_id"]
HISTORY_COLUMNS = [f"vendor_{c}" for c in STATS_COLUMNS]
#: Rows that a task sorts when a history is cut into chunks of rows.
RANGE_ROWS = 100_000


# --------------------------------------------------------------- aggregates

def vendor_stats(invoices: DataFrame, bank_rule: str = "max") -> DataFrame:
    """One row of statistics per vendor.

    ``bank_rule``: ``max`` takes the greatest account number, ``latest`` the
    account of the newest invoice.

    The first step groups by vendor and account, so that it needs no text in
    its aggregation buffers and runs as a hash aggregate with partial results
    on the map side; the second one combines the few accounts of a vendor.
    """
    if bank_rule not in ("max", "latest"):
        raise ValueError(f"bank_rule must be 'max' or 'latest', not {bank_rule!r}")
    steps = ["max(amount) AS hi", "min(amount) AS lo", "max(ts) AS last_ts"]
    bank = "max(bank_account)"
    if bank_rule == "latest":
        steps.append("max(struct(ts, invoice_id)) AS newest")
        bank = "max_by(bank_account, newest)"
    per_account = invoices.groupBy("vendor_id", "bank_account").agg(
        *money.moment_sums(), *map(F.expr, steps))
    per_vendor = per_account.groupBy("vendor_id").agg(*money.merged_moment_sums(), *map(F.expr, [
        "max(hi) AS max_amount", "min(lo) AS min_amount",
        "max(last_ts) AS last_invoice_time",
        f"{bank} AS last_bank_account",
    ]))
    return per_vendor.selectExpr(
        "vendor_id", "n AS total_invoices",
        f"{money.TOTAL} AS total_amount", f"{money.MEAN} AS avg_amount",
        "max_amount", "min_amount", "last_invoice_time", "last_bank_account",
        f"{money.stddev_sql('max_amount', 'min_amount')} AS stddev_amount")


def category_patterns(invoices: DataFrame) -> DataFrame:
    """Count, mean amount and share of each category within its vendor."""
    per_category = invoices.groupBy("vendor_id", "category").agg(
        F.count(F.lit(1)).alias("count"), money.total("total"))
    # the window runs over one row per (vendor, category), not over invoices
    return per_category.selectExpr(
        "vendor_id", "category", "count",
        "total / count AS avg_amount",
        "count / sum(count) OVER (PARTITION BY vendor_id) AS frequency")


def velocity(
    invoices: DataFrame,
    window_minutes: int = 60,
    hop_minutes: int = 5,
) -> DataFrame:
    """Invoices and amount per vendor in sliding windows.

    When the hop divides the window, rows are first counted in panes of one
    hop, and only these counts are copied to the windows that cover them; each
    row is then aggregated once instead of once per window.
    """
    count, total = F.expr("count(1) AS n"), money.total("total")
    if window_minutes % hop_minutes:
        return invoices.groupBy(
            "vendor_id",
            F.window("ts", f"{window_minutes} minutes", f"{hop_minutes} minutes").alias("w"),
        ).agg(count, total).selectExpr(
            "vendor_id", "n AS invoice_count", "total AS total_amount",
            "w.start AS window_start", "w.end AS window_end")
    return windows_of_panes(panes(invoices, hop_minutes), window_minutes, hop_minutes)


def panes(invoices: DataFrame, hop_minutes: int = 5) -> DataFrame:
    """Counts and exact sums per vendor and ``pane`` of one hop, also on a stream. Rows without a
    timestamp are in no pane."""
    return invoices.groupBy(
        "vendor_id", F.window("ts", f"{hop_minutes} minutes").alias("pane"),
    ).agg(*money.total_sums())


def windows_of_panes(panes: DataFrame, window_minutes: int = 60, hop_minutes: int = 5) -> DataFrame:
    """The sliding windows of ``panes`` of one hop, which must divide the window."""
    return panes.selectExpr(
        "vendor_id", "n", "sa", "sb", "big", "bq", "lost",
        f"explode(sequence(pane.start - INTERVAL {window_minutes - hop_minutes} MINUTES, "
        f"pane.start, INTERVAL {hop_minutes} MINUTES)) AS window_start",
    ).groupBy("vendor_id", "window_start").agg(*money.merged_total_sums()).selectExpr(
        "vendor_id", "n AS invoice_count", f"{money.TOTAL} AS total_amount",
        "window_start",
        f"window_start + INTERVAL {window_minutes} MINUTES AS window_end")


# ------------------------------------------------------------------ history

def join_vendor_stats(invoices: DataFrame, stats: DataFrame) -> DataFrame:
    """Each invoice with the statistics of its vendor under ``vendor_*`` names."""
    renamed = stats.selectExpr("vendor_id", *[f"{c} AS vendor_{c}" for c in STATS_COLUMNS])
    return attach_by_key(
        invoices, renamed, ["vendor_id"], "vendor_total_invoices", "invoice_id", null_safe=True)


def running_history(
    invoices: DataFrame,
    include_self: bool = True,
    bank_rule: str = "max",
    grain: str = "hour",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Each invoice with the statistics of its vendor so far.

    Order within a vendor is (ts, invoice_id). One window per vendor would put
    all rows of a busy vendor into one task, so the history is cut into
    calendar chunks of ``grain``: chunk totals are running-summed per vendor
    (one row per chunk), and a window inside each (vendor, chunk) adds the rows
    since the chunk began. All the statistics combine exactly. Rows without a
    timestamp come first and form one chunk per vendor.

    With ``chunk_rows`` chunks are cut by number of rows instead: the rows are range partitioned by
    (vendor, ts, invoice_id), numbered in each range and written once, so a vendor with all its rows in
    one second is still spread evenly. That costs a count and a sorted copy of the rows.

    ``bank_rule``: ``max`` is the greatest account so far, ``previous`` the
    account of the invoice just before this one.
    """
    if bank_rule not in ("max", "previous"):
        raise ValueError(f"bank_rule must be 'max' or 'previous', not {bank_rule!r}")
    start_of_time = F.lit("0001-01-01 00:00:00").cast("timestamp")
    parts = {f"__{m}": c for m, c in money.moment_columns().items()}
    chunked = invoices.withColumn("__chunk", F.coalesce(F.date_trunc(grain, "ts"), start_of_time)) \
        if chunk_rows is None else _cut_by_rows(invoices, chunk_rows)
    rows = chunked.withColumns(parts)
    place = F.struct("ts", "invoice_id")
    chunks = rows.groupBy("vendor_id", "__chunk").agg(
        F.count(F.lit(1)).alias("n"), *[F.try_sum(p).alias(p) for p in parts],
        F.max("amount").alias("hi"), F.min("amount").alias("lo"),
        F.max("ts").alias("last_ts"), F.max("bank_account").alias("bank_max"),
        F.max_by(F.struct("bank_account"), place).alias("bank_last"),
    )
    before = (Window.partitionBy("vendor_id").orderBy("__chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = chunks.select(
        F.col("vendor_id").alias("__vendor"), F.col("__chunk").alias("__start"),
        F.sum("n").over(before).alias("n0"), *[F.try_sum(p).over(before).alias(f"{p}0") for p in parts],
        F.max("hi").over(before).alias("hi0"), F.min("lo").over(before).alias("lo0"),
        F.max("last_ts").over(before).alias("last_ts0"),
        F.max("bank_max").over(before).alias("bank_max0"),
        F.last("bank_last").over(before).alias("bank_last0"),
    )
    # invoices without a vendor share one history, as any other vendor's do
    joined = rows.join(offsets, F.col("vendor_id").eqNullSafe(F.col("__vendor"))
                       & (F.col("__chunk") == F.col("__start")), "left")

    ordered = Window.partitionBy("vendor_id", "__chunk").orderBy("ts", "invoice_id")
    seen = ordered.rowsBetween(Window.unboundedPreceding, 0 if include_self else -1)

    def plus(part: str) -> Column:
        base, here = F.col(f"{part}0"), F.try_sum(part).over(seen)
        return F.coalesce(base + here, base, here, F.lit(0))

    bank_max = F.greatest(F.col("bank_max0"), F.max("bank_account").over(seen))
    previous = F.when(F.row_number().over(ordered) == 1, F.col("bank_last0.bank_account")) \
        .otherwise(F.lag("bank_account").over(ordered))
    running = joined.select(
        *invoices.columns,
        (F.coalesce(F.col("n0"), F.lit(0)) + F.count(F.lit(1)).over(seen)).alias("n"),
        *[plus(f"__{m}").alias(m) for m in (*money.MOMENTS, "lost")],
        F.greatest(F.col("hi0"), F.max("amount").over(seen)).alias("vendor_max_amount"),
        F.least(F.col("lo0"), F.min("amount").over(seen)).alias("vendor_min_amount"),
        F.greatest(F.col("last_ts0"), F.max("ts").over(seen)).alias("vendor_last_invoice_time"),
        (bank_max if bank_rule == "max" else previous).alias("vendor_last_bank_account"))
    return running.selectExpr(
        *invoices.columns, "n AS vendor_total_invoices",
        f"{money.TOTAL} AS vendor_total_amount", f"{money.MEAN} AS vendor_avg_amount",
        "vendor_max_amount", "vendor_min_amount",
        "vendor_last_invoice_time", "vendor_last_bank_account",
        f"{money.stddev_sql('vendor_max_amount', 'vendor_min_amount')} AS vendor_stddev_amount",
    ).select(*invoices.columns, *HISTORY_COLUMNS)


def _cut_by_rows(invoices: DataFrame, chunk_rows: int) -> DataFrame:
    """The rows with ``__chunk``, the number of their run of ``chunk_rows`` rows in the order of (vendor,
    ts, id). Written and read back: range borders come from a sample and must be the same for all later
    steps. A range holds many chunks, as the driver hears from the task of every range."""
    spark = invoices.sparkSession
    pieces = max(1, -(-invoices.count() // max(chunk_rows, RANGE_ROWS)))
    path = scratch_path(spark, "ranges")
    order = ("vendor_id", "ts", "invoice_id")
    at = F.monotonically_increasing_id()  # the range, then 33 bits for the row in it
    cut = invoices.repartitionByRange(pieces, *order).sortWithinPartitions(*order).withColumn("__at", at) \
        .withColumn("__chunk", F.expr(f"__at - __at % (1L << 33) + (__at % (1L << 33)) div {chunk_rows}")).drop("__at")
    cut.write.parquet(path)
    return spark.read.schema(cut.schema).parquet(path)


def with_history(
    invoices: DataFrame,
    stats: DataFrame | None = None,
    history: str = "final",
    bank_rule: str = "max",
) -> DataFrame:
    """Invoices with their ``vendor_*`` history columns."""
    if history == "final":
        return join_vendor_stats(
            invoices, vendor_stats(invoices, bank_rule) if stats is None else stats)
    if history in ("arrival", "prior"):
        rule = "previous" if bank_rule in ("latest", "previous") else "max"
        return running_history(invoices, include_self=history == "arrival", bank_rule=rule)
    raise ValueError(f"history must be 'final', 'arrival' or 'prior', not {history!r}")


# ------------------------------------------------------------------- checks

# A vendor that has invoices but no mean (none has an amount, or one is no number) is unknown
# history: NULL, which later steps take as a reason to look, not as "no deviation".
DEVIATION_PCT = """CASE WHEN vendor_avg_amount > 0
    THEN (amount - vendor_avg_amount) / vendor_avg_amount * 100D
    WHEN vendor_avg_amount IS NULL AND vendor_total_invoices > 0 THEN NULL ELSE 0D END"""


def _bank_changed(earlier_invoices: int = 1) -> str:
    return (f"coalesce(vendor_total_invoices > {earlier_invoices} "
            "AND bank_account <> vendor_last_bank_account, false) AS bank_account_changed")


def anomalies(
    invoices: DataFrame,
    stats: DataFrame | None = None,
    z_threshold: float = DEFAULTS.z_score,
    history: str = "final",
) -> DataFrame:
    """Z-score of the amount within its vendor, and the flags drawn from it.

    With ``final`` history the vendor's maximum includes the row itself, so
    ``exceeds_historical_max`` can only hold under ``prior``. An unknown score (no
    amount, or a vendor without known statistics) is NULL and flagged.
    """
    rows = with_history(invoices, stats, history)
    return rows.withColumn("amount_z_score", F.expr(
        "CASE WHEN vendor_stddev_amount > 0 "
        "THEN (amount - vendor_avg_amount) / vendor_stddev_amount "
        "WHEN vendor_stddev_amount IS NULL AND vendor_total_invoices > 0 THEN NULL ELSE 0D END")
    ).selectExpr(
        *invoices.columns,
        "vendor_avg_amount AS vendor_avg", "vendor_stddev_amount AS vendor_stddev",
        "vendor_max_amount AS vendor_max", "vendor_total_invoices", "amount_z_score",
        f"coalesce(abs(amount_z_score) > {float(z_threshold)}D, true) AS is_amount_anomaly",
        f"vendor_total_invoices <= {DEFAULTS.new_vendor_invoices} AS is_new_vendor",
        f"coalesce(amount > vendor_max_amount * {DEFAULTS.over_max_factor}D, false) "
        "AS exceeds_historical_max")


def bank_changes(
    invoices: DataFrame,
    stats: DataFrame | None = None,
    rule: str = "max",
) -> DataFrame:
    """Does the invoice name another account than its vendor used?

    ``max`` and ``latest`` compare with the vendor's account over all invoices,
    ``previous`` with the invoice just before.
    """
    if rule == "previous":
        rows, needed = with_history(invoices, history="prior", bank_rule="previous"), 0
    else:
        rows, needed = with_history(invoices, stats, "final", rule), 1
    return rows.selectExpr(
        "invoice_id", "vendor_id", "bank_account AS current_bank_account",
        "vendor_last_bank_account AS previous_bank_account", "vendor_total_invoices",
        _bank_changed(needed))


def deviation(
    invoices: DataFrame,
    stats: DataFrame | None = None,
    history: str = "final",
) -> DataFrame:
    """Distance of the amount from the vendor's mean in percent; an unknown one is NULL and high."""
    return with_history(invoices, stats, history).selectExpr(
        "*", f"{DEVIATION_PCT} AS deviation_percentage",
    ).selectExpr(
        "invoice_id", "vendor_id", "amount", "vendor_avg_amount", "vendor_total_invoices",
        "deviation_percentage", "abs(deviation_percentage) AS abs_deviation_percentage",
        f"coalesce(abs(deviation_percentage) > {DEFAULTS.high_deviation_pct}D, true) AS is_high_deviation")


def enrich_vendor(
    invoices: DataFrame,
    stats: DataFrame | None = None,
    history: str = "final",
    bank_rule: str = "max",
) -> DataFrame:
    """Invoices with their vendor's statistics and the ratios drawn from them."""
    rows = with_history(invoices, stats, history, bank_rule)
    carried = [c for c in invoices.columns if c not in INVOICE_COLUMNS]
    needed = 0 if history == "prior" else 1
    return rows.selectExpr(
        *INVOICE_COLUMNS, *carried,
        "vendor_avg_amount", "vendor_total_invoices", "vendor_total_amount",
        "vendor_max_amount", "vendor_min_amount", "vendor_stddev_amount",
        "vendor_last_bank_account",
        f"{DEVIATION_PCT} AS deviation_percentage",
        "try_divide(amount, vendor_avg_amount) AS amount_vs_avg_ratio",
        "try_divide(amount, vendor_max_amount) AS amount_vs_max_ratio",
        _bank_changed(needed))
