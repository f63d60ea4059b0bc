"""Risk scores of an invoice row.

The component scores are expressions over one enriched row, so a composite
score is a single projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlynx.config import DEFAULTS, Thresholds
from ledgerlynx.functions.columns import col_or
from ledgerlynx.functions.skew import attach_by_key
from ledgerlynx.functions.text import float_text


# -------------------------------------------------------------- expressions

# The rating of each band and the weight of each rating.
AMOUNT_RISK = """
  (CASE WHEN amount > 50000 THEN 0.8D WHEN amount > 25000 THEN 0.5D
        WHEN amount > 10000 THEN 0.3D ELSE 0.1D END) * 0.25D
  + (CASE WHEN amount >= 9500 AND amount < 10000 THEN 0.9D
          WHEN amount >= 9000 AND amount < 9500 THEN 0.6D ELSE 0D END) * 0.35D
  + (CASE WHEN abs(deviation_percentage) > 100 THEN 0.9D
          WHEN abs(deviation_percentage) > 50 THEN 0.6D
          WHEN abs(deviation_percentage) > 25 THEN 0.3D ELSE 0D END) * 0.35D
  + (CASE WHEN amount % 1000 = 0 THEN 0.4D WHEN amount % 100 = 0 THEN 0.2D
          ELSE 0D END) * 0.05D"""
VENDOR_RISK = """
  (CASE WHEN vendor_total_invoices <= 1 THEN 0.8D WHEN vendor_total_invoices <= 3 THEN 0.6D
        WHEN vendor_total_invoices <= 5 THEN 0.3D ELSE 0D END) * 0.3D
  + (CASE WHEN vendor_stddev_amount > vendor_avg_amount THEN 0.7D
          WHEN vendor_stddev_amount > vendor_avg_amount * 0.5D THEN 0.4D
          ELSE 0.1D END) * 0.2D
  + (CASE WHEN bank_account_changed THEN 0.95D ELSE 0D END) * 0.5D"""
PAYMENT_RISK = """
  (CASE payment_method WHEN 'Wire Transfer' THEN 0.6D WHEN 'Check' THEN 0.3D ELSE 0.1D END)"""
DUPLICATE_RISK = f"""
  {PAYMENT_RISK} * 0.4D + (CASE WHEN is_duplicate THEN 0.9D ELSE 0D END) * 0.6D"""


def amount_risk_score() -> Column:
    """Size, nearness to an approval limit, deviation and roundness."""
    return F.expr(AMOUNT_RISK)


def vendor_risk_score() -> Column:
    """Few invoices, scattered amounts, changed bank account."""
    return F.expr(VENDOR_RISK)


def temporal_risk_score(
    use_calendar: bool = False,
    office_hours: tuple[int, int] = (8, 18),
) -> Column:
    """A constant by default; with ``use_calendar`` weekends and hours outside
    ``office_hours`` (start inclusive, end exclusive) count as risky."""
    if not use_calendar:
        return F.lit(0.1)
    start, end = office_hours
    weekend = F.dayofweek("ts").isin(1, 7)
    after_hours = (F.hour("ts") < start) | (F.hour("ts") >= end)
    return F.when(weekend | after_hours, F.lit(0.5)).otherwise(F.lit(0.1))


def pattern_risk_score(with_duplicates: bool = False) -> Column:
    """Payment method, and ``is_duplicate`` where that is known."""
    return F.expr(DUPLICATE_RISK if with_duplicates else PAYMENT_RISK)


def similarity_of(df: DataFrame) -> str:
    """Expression of the row's duplicate similarity, 0 where none was computed."""
    for name in ("semantic_similarity_score", "duplicate_similarity_score"):
        if name in df.columns:
            return f"coalesce({name}, 0D)"
    return "0D"


# ---------------------------------------------------------------- operators

def join_left_dup_flag(invoices: DataFrame, duplicate_info: DataFrame) -> DataFrame:
    """Adds ``is_duplicate`` by invoice id; an invoice without a match is not one.

    ``duplicate_info`` may list an invoice several times, once per pair.
    """
    flag = col_or(duplicate_info, "is_duplicate", True)
    per_invoice = duplicate_info.groupBy("invoice_id").agg(F.max(flag).alias("__dup"))
    base = invoices.drop("is_duplicate")
    return base.join(per_invoice, "invoice_id", "left").select(
        *base.columns, F.coalesce("__dup", F.lit(False)).alias("is_duplicate"))


def amount_risk(enriched: DataFrame) -> DataFrame:
    return enriched.select("invoice_id", amount_risk_score().alias("amount_risk_score"))


def vendor_risk(enriched: DataFrame) -> DataFrame:
    return enriched.select("invoice_id", vendor_risk_score().alias("vendor_risk_score"))


def temporal_risk(invoices: DataFrame, use_calendar: bool = False,
                  office_hours: tuple[int, int] = (8, 18)) -> DataFrame:
    return invoices.select(
        "invoice_id",
        temporal_risk_score(use_calendar, office_hours).alias("temporal_risk_score"))


def pattern_risk(invoices: DataFrame, duplicate_info: DataFrame | None = None) -> DataFrame:
    """Pattern score; rows that carry ``is_duplicate`` (``exact_duplicates`` marks them) need
    no ``duplicate_info``, which is for a table of its own and costs a join."""
    if duplicate_info is None:
        marked = "is_duplicate" in invoices.columns
        return invoices.select("invoice_id", pattern_risk_score(marked).alias("pattern_risk_score"))
    return join_left_dup_flag(invoices, duplicate_info).select(
        "invoice_id", pattern_risk_score(True).alias("pattern_risk_score"))


def add_composite(
    enriched: DataFrame,
    with_duplicates: bool = False,
    weights: dict[str, float] | None = None,
    use_calendar: bool = False,
    score: str = "risk_score",
    t: Thresholds = DEFAULTS,
) -> DataFrame:
    """The row plus its component scores, their weighted sum and its level."""
    w = weights or t.composite_weights
    parts = enriched.withColumns({
        "amount_risk": amount_risk_score(),
        "vendor_risk": vendor_risk_score(),
        "temporal_risk": temporal_risk_score(use_calendar),
        "pattern_risk": pattern_risk_score(with_duplicates),
    })
    scored = parts.withColumn(score, F.expr(" + ".join(
        f"{name}_risk * {float(w[name])!r}D"
        for name in ("amount", "vendor", "temporal", "pattern"))))
    factors = [float_text(F.col(f"{name}_risk"))
               for name in ("amount", "vendor", "temporal", "pattern")]
    return scored.withColumns({
        "risk_level": F.expr(
            f"CASE WHEN {score} >= {t.medium_max / 100.0}D THEN 'HIGH' "
            f"WHEN {score} >= {t.low_max / 100.0}D THEN 'MEDIUM' ELSE 'LOW' END"),
        "risk_factors": F.concat_ws(",", *factors),
        # fixed values: confidence by the number of invoices
        "confidence": F.expr(
            "CASE WHEN vendor_total_invoices > 10 THEN 0.9D "
            "WHEN vendor_total_invoices > 5 THEN 0.7D ELSE 0.5D END"),
    })


def composite_risk(
    enriched: DataFrame,
    duplicate_info: DataFrame | None = None,
    weights: dict[str, float] | None = None,
    use_calendar: bool = False,
) -> DataFrame:
    """Weighted 0-1 score with its level, factors and confidence; ``is_duplicate`` of the
    rows counts, or the one joined from ``duplicate_info``."""
    if duplicate_info is not None:
        enriched = join_left_dup_flag(enriched, duplicate_info)
    return add_composite(
        enriched, "is_duplicate" in enriched.columns, weights, use_calendar).select(
        "invoice_id", "vendor_id", "amount", "tax", "bank_account", "ts", "description",
        "amount_risk", "vendor_risk", "temporal_risk", "pattern_risk",
        "risk_score", "risk_level", "risk_factors", "confidence")


def add_points(enriched: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """The row plus the four triggers, ``risk_points`` (0-100) and the breakdown. An unknown
    deviation triggers like a large one."""
    triggers = {
        "deviation_triggered": f"coalesce(abs(deviation_percentage) > {t.deviation_pct}D, true)",
        "bank_change_triggered": "bank_account_changed",
        "duplicate_triggered": f"{similarity_of(enriched)} > {t.similarity}D",
        "tax_mismatch_triggered": f"tax < amount * {t.tax_min_pct / 100.0}D "
                                  f"OR tax > amount * {t.tax_max_pct / 100.0}D",
    }
    given = {
        "Deviation": f"IF(deviation_triggered, {t.points_deviation}, 0)",
        "BankChange": f"IF(bank_change_triggered, {t.points_bank_change}, 0)",
        "Duplicate": f"IF(duplicate_triggered, {t.points_duplicate}, 0)",
        "TaxMismatch": f"IF(tax_mismatch_triggered, {t.points_tax}, 0)",
    }
    breakdown = ", ' ', ".join(f"'{name}:', {p}" for name, p in given.items())
    return enriched.withColumns(
        {name: F.expr(f"coalesce({rule}, false)") for name, rule in triggers.items()}
    ).withColumns({
        "risk_points": F.expr(f"least({t.points_cap}, {' + '.join(given.values())})"),
        "risk_breakdown": F.expr(f"concat({breakdown})"),
    })


def _points_band(high: str, medium: str, low: str, t: Thresholds) -> Column:
    return F.expr(
        f"CASE WHEN risk_points > {t.medium_max}D THEN '{high}' "
        f"WHEN risk_points > {t.low_max}D THEN '{medium}' ELSE '{low}' END")


def points_level(t: Thresholds = DEFAULTS) -> Column:
    return _points_band("High", "Medium", "Low", t)


def points_decision(t: Thresholds = DEFAULTS) -> Column:
    return _points_band("Reject", "Review", "Approve", t)


def realtime_risk(enriched: DataFrame) -> DataFrame:
    """Points score with its level, decision, triggers and breakdown."""
    return add_points(enriched).select(
        "invoice_id", "vendor_id", "amount", "tax",
        F.col("risk_points").alias("risk_score"),
        points_level().alias("risk_level"),
        points_decision().alias("decision"),
        "deviation_triggered", "bank_change_triggered", "duplicate_triggered",
        "tax_mismatch_triggered", "risk_breakdown")


def join_registry(invoices: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``registered_account``; "" for a vendor the registry lacks.

    ``registry`` has one row (vendor_id, registered_account) per vendor.
    """
    sizes = invoices.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("n"))
    joined = attach_by_key(
        invoices, registry.select("vendor_id", "registered_account"),
        ["vendor_id"], "n", "invoice_id", how="left", sizes=sizes)
    return joined.select(
        *invoices.columns,
        F.coalesce("registered_account", F.lit("")).alias("registered_account"))


def registry_risk(
    invoices: DataFrame,
    registry: DataFrame,
    t: Thresholds = DEFAULTS,
) -> DataFrame:
    """Score against the registered account, amount bands, round sums and night hours."""
    # fixed values: bands and parts of the score
    total = """
      CASE WHEN amount > 80000 THEN 0.40D WHEN amount > 40000 THEN 0.20D
           WHEN amount > 9000 AND amount < 10000 THEN 0.30D ELSE 0D END
      + IF(amount % 1000 = 0, 0.10D, 0D)
      + IF(coalesce(bank_account <> registered_account, true), 0.45D, 0D)
      + IF(hour(ts) < 5, 0.20D, 0D)"""

    def band(high: str, medium: str, low: str) -> Column:
        return F.expr(f"CASE WHEN risk_score >= {t.registry_reject}D THEN '{high}' "
                      f"WHEN risk_score >= {t.registry_review}D THEN '{medium}' ELSE '{low}' END")

    rows = join_registry(invoices, registry)
    return rows.withColumn("risk_score", F.expr(f"least(round({total}, 4), 1D)")).withColumns({
        "risk_level": band("HIGH", "MEDIUM", "LOW"),
        "decision": band("AUTO_REJECT", "REVIEW_REQUIRED", "AUTO_APPROVE"),
        "is_alert": F.expr(f"risk_score >= {t.registry_alert}D"),
    }).drop("registered_account")
