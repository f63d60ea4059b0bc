"""Decisions and alerts drawn from a 0-1 risk score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlynx.config import DEFAULTS, Thresholds
from ledgerlynx.functions.text import float_text


def decisions(scored: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Every column plus the decision, its confidence, flags and reason. Where the deviation from the
    vendor's history is a column but unknown, nothing is approved without a look."""
    known = "deviation_percentage IS NOT NULL AND " if "deviation_percentage" in scored.columns else ""

    def pick(approved: str, rejected: str, review: str) -> Column:
        return F.expr(
            f"CASE WHEN {known}risk_score < {t.approve_max / 100.0}D THEN {approved} "
            f"WHEN risk_score >= {t.reject_min / 100.0}D THEN {rejected} "
            f"ELSE {review} END")

    return scored.withColumns({
        "decision": pick("'AUTO_APPROVE'", "'AUTO_REJECT'", "'REVIEW_REQUIRED'"),
        "decision_confidence": pick("(1D - risk_score) * 100D", "risk_score * 100D", "50D"),
        "requires_action": pick("false", "false", "true"),
        "auto_approved": pick("true", "false", "false"),
        "auto_rejected": pick("false", "true", "false"),
        # fixed texts
        "decision_reason": pick(
            "'Low risk score - invoice meets all safety criteria'",
            "'High fraud probability - multiple risk factors detected'",
            "'Moderate risk - requires manual verification'"),
    })


def risk_alerts(scored: DataFrame) -> DataFrame:
    """One alert per invoice of level HIGH."""
    score = F.col("risk_score")
    return scored.where(F.col("risk_level") == "HIGH").select(
        "invoice_id", "vendor_id", "amount", "risk_score", "risk_level",
        F.concat(
            F.lit("HIGH RISK: Invoice "), F.col("invoice_id"),
            F.lit(" from vendor "), F.col("vendor_id"),
            F.lit(" flagged with risk score "), float_text(score)).alias("alert_message"),
        F.lit(True).alias("requires_review"),
        F.when(score >= F.lit(DEFAULTS.critical_min), "CRITICAL").otherwise("HIGH")
        .alias("priority"))
