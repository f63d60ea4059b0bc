"""From invoices to decisions, alerts, explanations and monitoring tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlynx.config import DEFAULTS, Thresholds
from ledgerlynx.operators import decisions as dec
from ledgerlynx.operators import duplicates, explain, relational, reports, risk, similarity, vendor
from ledgerlynx.operators.embedding import Embedder
from ledgerlynx.session import drop_path, scratch_path
from ledgerlynx.sources import sinks


@dataclass(frozen=True)
class ScoringConfig:
    """``points`` uses the additive 0-100 score, otherwise the weighted one.

    ``thresholds`` has every business threshold and weight; the two similarity and
    alert thresholds beside it override theirs when given.
    """

    points: bool = True
    semantic: bool = False
    thresholds: Thresholds = DEFAULTS
    semantic_threshold: float | None = None
    embedder: str | Embedder = "hash"
    bank_rule: str = "max"
    alert_threshold: float | None = None
    use_calendar: bool = False
    text_model: Callable | None = None

    @property
    def similar(self) -> float:
        return self.thresholds.similarity if self.semantic_threshold is None else self.semantic_threshold

    @property
    def alert_min(self) -> float:
        return self.thresholds.alert_min if self.alert_threshold is None else self.alert_threshold


def score(
    invoices: DataFrame,
    cfg: ScoringConfig = ScoringConfig(),
    stats: DataFrame | None = None,
) -> DataFrame:
    """The wide scored row that every output is a projection of.

    Carries the vendor history, the duplicate findings, the component risks
    and both scales of the points score: ``risk_points`` 0-100 and
    ``risk_score`` 0-1.
    """
    if stats is None:
        stats = vendor.vendor_stats(invoices, cfg.bank_rule)
    if cfg.semantic:
        marked = similarity.enrich_semantic(invoices, cfg.similar, cfg.embedder) \
            .withColumn("is_duplicate", F.col("has_semantic_duplicate"))
    else:
        marked = duplicates.exact_duplicates(invoices)
    enriched = vendor.enrich_vendor(marked, stats, bank_rule=cfg.bank_rule)
    rows = risk.add_points(enriched, cfg.thresholds)
    rows = risk.add_composite(
        rows, with_duplicates=True, use_calendar=cfg.use_calendar, score="composite_score", t=cfg.thresholds)
    if cfg.points:
        return rows.withColumns({
            "risk_score": F.col("risk_points") / F.lit(100.0),
            "risk_level": F.upper(risk.points_level(cfg.thresholds)),
        })
    # the audit text reads points, so the weighted score is put on that scale
    return rows.withColumns({
        "risk_score": F.col("composite_score"),
        "risk_points": F.col("composite_score") * F.lit(100.0),
    })


def outputs_of(
    scored: DataFrame,
    stats: DataFrame,
    cfg: ScoringConfig = ScoringConfig(),
) -> dict[str, DataFrame]:
    """Every output table as a plan over the scored rows."""
    decided = dec.decisions(scored, cfg.thresholds)
    alerts = relational.filter_high_risk(decided, cfg.alert_min)
    explanations = (explain.explain_model(alerts, cfg.text_model) if cfg.text_model
                    else explain.explain_rule(alerts))
    out = {
        "vendor_stats": stats,
        "risk_scores": scored,
        "autonomous_decisions": decided,
        "high_risk_alerts": alerts,
        "explanations": explanations,
        "all_invoices_explained": explain.explain_audit(scored, cfg.thresholds),
    }
    if cfg.points:
        out["realtime_risk_scores"] = scored.select(
            "invoice_id", "vendor_id", "amount", "tax", "risk_points", "risk_score",
            "risk_level", risk.points_decision(cfg.thresholds).alias("decision"),
            "deviation_triggered", "bank_change_triggered", "duplicate_triggered",
            "tax_mismatch_triggered", "risk_breakdown")
    return out


def build(invoices: DataFrame, cfg: ScoringConfig = ScoringConfig()) -> dict[str, DataFrame]:
    """All tables, lazily; nothing runs until one of them is used (with ``semantic``, only a count
    of the largest vendor)."""
    stats = vendor.vendor_stats(invoices, cfg.bank_rule)
    out = outputs_of(score(invoices, cfg, stats), stats, cfg)
    out["anomalies"] = vendor.anomalies(invoices, stats)
    out["velocity"] = vendor.velocity(invoices)
    return out


def monitoring_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The dashboard's tables, from the result of ``build``."""
    return {
        "alert_summary": reports.alert_summary_score(tables["high_risk_alerts"]),
        "vendor_risk_summary": reports.vendor_risk_summary(tables["risk_scores"]),
        "vendor_stats": tables["vendor_stats"],
        "all_risk_scores": tables["risk_scores"],
        "high_risk_alerts": tables["high_risk_alerts"],
    }


def run_batch(
    invoices: DataFrame,
    folder: str,
    cfg: ScoringConfig = ScoringConfig(),
) -> dict[str, str]:
    """Write all outputs of a finite table.

    The statistics and the scored rows are written once to the shared folder
    and read back: six outputs then scan a table instead of repeating joins,
    and a lost executor costs a re-read, not the whole lineage. The two scratch
    tables go when the outputs are written.
    """
    spark = invoices.sparkSession
    stats_path, scored_path = scratch_path(spark, "stats"), scratch_path(spark, "scored")
    vendor.vendor_stats(invoices, cfg.bank_rule).write.parquet(stats_path)
    stats = spark.read.parquet(stats_path)
    score(invoices, cfg, stats).write.parquet(scored_path)
    scored = spark.read.parquet(scored_path)
    try:
        return sinks.write_jsonl(outputs_of(scored, stats, cfg), folder)
    finally:
        drop_path(spark, stats_path)
        drop_path(spark, scored_path)
