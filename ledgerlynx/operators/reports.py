"""Roll-ups for monitoring and display."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlynx.config import DEFAULTS
from ledgerlynx.functions import money
from ledgerlynx.functions.columns import col_or, count_true
from ledgerlynx.functions.text import grouped
from ledgerlynx.operators.relational import select_rename_display

STATUS_LABELS = {"AUTO_APPROVE": "Approved", "AUTO_REJECT": "Rejected", "REVIEW_REQUIRED": "Pending"}
DISPLAY_NAMES = {
    "invoice_id": "INVOICE", "vendor_id": "VENDOR", "amount": "AMOUNT",
    "risk_score": "RISK SCORE", "status": "STATUS", "time": "TIME",
}
TREND_BUCKETS = ["Low Risk", "Medium Risk", "High Risk"]
CURRENCY = "₹"


def _rows() -> Column:
    return F.count(F.lit(1))


def _amount_sum() -> Column:
    return money.total("total_amount")


def risk_summary(scored: DataFrame) -> DataFrame:
    """Count, mean score and amount per level."""
    return scored.groupBy("risk_level").agg(
        _rows().alias("count"), F.avg("risk_score").alias("avg_risk_score"),
        _amount_sum())


def alert_summary_amount(explanations: DataFrame) -> DataFrame:
    """Count and amount per level; the amount is 0 where the frame has none."""
    amount = (_amount_sum() if "amount" in explanations.columns
              else F.lit(0.0).alias("total_amount"))
    return explanations.groupBy("risk_level").agg(_rows().alias("count"), amount)


def alert_summary_score(alerts: DataFrame) -> DataFrame:
    """Count and mean score per level."""
    return alerts.groupBy("risk_level").agg(
        _rows().alias("count"), F.avg("risk_score").alias("avg_score"))


def vendor_risk_summary(scored: DataFrame) -> DataFrame:
    """Per vendor: invoices, HIGH ones, mean score and amount."""
    return scored.groupBy("vendor_id").agg(
        _rows().alias("total_invoices"),
        count_true(F.col("risk_level") == "HIGH").alias("high_risk_count"),
        F.avg("risk_score").alias("avg_risk_score"),
        _amount_sum())


def batch_report(
    explanations: DataFrame,
    since: dt.datetime | str | None = None,
    until: dt.datetime | str | None = None,
) -> DataFrame:
    """One row of totals; ``since`` (inclusive) and ``until`` (exclusive) bound ``ts``."""
    rows = explanations
    if since is not None:
        rows = rows.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until is not None:
        rows = rows.where(F.col("ts") < F.lit(until).cast("timestamp"))
    level = F.col("risk_level")
    return rows.agg(
        _rows().alias("total_flagged"),
        count_true(level == "HIGH").alias("high_risk_count"),
        count_true(level == "MEDIUM").alias("medium_risk_count"),
        F.avg("risk_score").alias("avg_risk_score"))


def decision_counts(decided: DataFrame) -> DataFrame:
    decision = col_or(decided, "decision", F.lit(None).cast("string"))
    return decided.agg(
        count_true(decision == "AUTO_APPROVE").alias("approved"),
        count_true(decision == "REVIEW_REQUIRED").alias("under_review"),
        count_true(decision == "AUTO_REJECT").alias("rejected"),
        _rows().alias("total"))


def kpi_cards(decided: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """Invoices, high-risk items and the share decided without a person.

    Without a separate ``alerts`` frame the high-risk items are counted in the
    same pass as the rest.
    """
    if alerts is None:
        high = count_true(F.col("risk_score") >= F.lit(DEFAULTS.alert_min))
    else:
        high = F.max(alerts.select(_rows()).scalar())
    decision = col_or(decided, "decision", F.lit(None).cast("string"))
    automatic = count_true(decision.isin("AUTO_APPROVE", "AUTO_REJECT"))
    rate = F.try_divide(automatic.cast("double"), _rows()) * F.lit(100.0)
    return decided.agg(
        _rows().alias("total_invoices"),
        F.coalesce(high, F.lit(0)).alias("high_risk"),
        F.coalesce(rate, F.lit(0.0)).alias("automation_rate"))


def kpi_monthly(decided: DataFrame) -> DataFrame:
    """Invoices per month and the change against the month before, in percent."""
    monthly = decided.where(F.col("ts").isNotNull()) \
        .groupBy(F.to_date(F.date_trunc("month", "ts")).alias("month")) \
        .agg(_rows().alias("invoices"))
    before = monthly.select(
        F.add_months("month", 1).alias("month"), F.col("invoices").alias("prev_invoices"))
    prev = F.coalesce("prev_invoices", F.lit(0).cast("bigint"))
    change = (F.col("invoices") - prev).cast("double") / prev * F.lit(100.0)
    return monthly.join(before, "month", "left").select(
        "month", "invoices", prev.alias("prev_invoices"),
        F.when(prev > 0, change).otherwise(F.lit(0.0)).alias("change_pct"))


def group_size_pivot(decided: DataFrame) -> DataFrame:
    """Rows per day and risk bucket, one column per bucket, 0 where there are none.

    Scores are on the 0-1 scale when the highest of the whole table is at most
    1, otherwise on the 0-100 scale. Both ways are counted in one pass and the
    highest score, taken from the daily rows, picks one.
    """
    low, medium = DEFAULTS.low_max, DEFAULTS.medium_max
    # a missing score counts as high
    tests = {
        TREND_BUCKETS[0]: "{s} <= {low}D",
        TREND_BUCKETS[1]: "{s} > {low}D AND {s} <= {medium}D",
        TREND_BUCKETS[2]: "{s} IS NULL OR {s} > {medium}D",
    }
    counts = [
        F.expr(f"count_if({test.format(s=s, low=low, medium=medium)}) AS `{name} {scale}`")
        for scale, s in (("1", "risk_score * 100D"), ("100", "CAST(risk_score AS DOUBLE)"))
        for name, test in tests.items()
    ]
    daily = decided.where("ts IS NOT NULL").groupBy(F.to_date("ts").alias("day")).agg(
        F.max("risk_score").alias("highest"), *counts)
    return daily.withColumn("highest", F.expr("max(highest) OVER ()")).select("day", *[
        F.when(F.col("highest") <= 1.0, F.col(f"{name} 1"))
        .otherwise(F.col(f"{name} 100")).alias(name) for name in TREND_BUCKETS])


def risk_trend_7d(decided: DataFrame, end: dt.date, days: int = 7) -> DataFrame:
    """Rows per risk bucket for each of the ``days`` days up to ``end``, 0-filled."""
    last = F.lit(end).cast("date")
    first = F.date_sub(last, days - 1)
    counts = group_size_pivot(decided).where(F.col("day").between(first, last))
    calendar = decided.sparkSession.range(1).select(
        F.explode(F.sequence(first, last)).alias("day"))
    return calendar.join(counts, "day", "left").fillna(0, subset=TREND_BUCKETS).select(
        "day", F.date_format("day", "E").alias("label"),
        *[F.col(b).alias(b.lower().replace(" ", "_")) for b in TREND_BUCKETS])


def top_alerts(alerts: DataFrame, n: int = 3) -> DataFrame:
    """The n highest scores; ties by id. Without a score, the n smallest ids."""
    order = [F.desc("risk_score")] if "risk_score" in alerts.columns else []
    return alerts.orderBy(*order, F.asc("invoice_id")).limit(n)


def recent_transactions(decided: DataFrame, n: int = 15) -> DataFrame:
    """The n newest rows."""
    return decided.orderBy(F.desc("ts"), F.desc("invoice_id")).limit(n)


def bounded_buffer(rows: DataFrame, n: int = 500) -> DataFrame:
    """What a display that keeps the newest n rows would hold."""
    return recent_transactions(rows, n)


def transactions_view(decided: DataFrame, n: int | None = 15) -> DataFrame:
    """Display form of the newest rows (of all rows with ``n=None``)."""
    rows = decided if n is None else recent_transactions(decided, n)
    shown = {}
    if "amount" in rows.columns:
        shown["amount"] = F.concat(F.lit(CURRENCY), grouped(F.col("amount"), 0))
    if "decision" in rows.columns:
        labels = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])
        shown["status"] = F.try_element_at(labels, F.col("decision"))
    if "ts" in rows.columns:
        shown["time"] = F.date_format("ts", "HH:mm")
    return select_rename_display(rows.withColumns(shown), DISPLAY_NAMES)


def similarity_sort(matches: DataFrame, similarity: str = "similarity", *ties: str) -> DataFrame:
    """Matches from most to least similar; ``ties`` order equal ones."""
    return matches.orderBy(F.desc(similarity), *ties)
