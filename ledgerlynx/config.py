"""Business thresholds and weights shared by the scoring operators."""

from __future__ import annotations

from dataclasses import dataclass


# They decide which invoices are flagged, so they are part of the
# contract with existing users and must not drift.
@dataclass(frozen=True)
class Thresholds:
    # weights of the composite score; the temporal weight is what is left of 1
    weight_amount: float = 0.35
    weight_vendor: float = 0.30
    weight_pattern: float = 0.35

    # points score
    deviation_pct: float = 30.0
    similarity: float = 0.85
    tax_min_pct: float = 5.0
    tax_max_pct: float = 10.0
    points_deviation: int = 30
    points_bank_change: int = 40
    points_duplicate: int = 50
    points_tax: int = 20
    points_cap: int = 100

    # level and decision bands on the 0-100 scale
    low_max: float = 30.0
    medium_max: float = 70.0
    approve_max: float = 30.0
    reject_min: float = 70.0

    # alerts, on the 0-1 scale
    alert_min: float = 0.6
    critical_min: float = 0.8

    # vendor behaviour
    z_score: float = 3.0
    new_vendor_invoices: int = 3
    over_max_factor: float = 1.5
    high_deviation_pct: float = 50.0

    # audit wording, on the 0-100 scale
    audit_high: float = 61.0
    audit_medium: float = 31.0

    # registry scorer, on the 0-1 scale
    registry_reject: float = 0.65
    registry_review: float = 0.35
    registry_alert: float = 0.60

    @property
    def weight_temporal(self) -> float:
        return 1.0 - self.weight_amount - self.weight_vendor - self.weight_pattern

    @property
    def composite_weights(self) -> dict[str, float]:
        return {
            "amount": self.weight_amount,
            "vendor": self.weight_vendor,
            "temporal": self.weight_temporal,
            "pattern": self.weight_pattern,
        }


DEFAULTS = Thresholds()
