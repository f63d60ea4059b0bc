"""Golden cases and the boundaries of every threshold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import same
from ledgerlynx.operators import decisions as dec
from ledgerlynx.operators import duplicates, explain, relational, reports, risk, vendor
from ledgerlynx.plans import scoring

AUDIT = [
    ((100, 85.0, True, 0.92, True),
     "This invoice presents significant fraud indicators with a risk score of 100/100. Multiple "
     "critical fraud indicators were identified: amount deviation of 85.0% from vendor's "
     "historical average, recent bank account change, high similarity (0.92) to existing "
     "invoices, and tax calculation inconsistency. The convergence of these anomalies requires "
     "immediate attention to prevent potential financial loss. Recommended action: immediate "
     "manual review and payment hold."),
    ((50, 45.0, True, 0.30, False),
     "This invoice exhibits moderate risk factors with a risk score of 50/100. Multiple fraud "
     "indicators were detected: amount deviation of 45.0% from vendor's historical average and "
     "recent bank account change. The combination of these factors elevates the risk profile "
     "substantially. Recommended action: verification of invoice details and vendor "
     "confirmation."),
    ((20, 5.0, False, 0.12, True),
     "This invoice shows minimal risk indicators with a risk score of 20/100. The primary "
     "concern is tax calculation inconsistency. This pattern warrants attention as it deviates "
     "from normal transaction behavior. Recommended action: standard processing with routine "
     "audit."),
    ((0, -2.0, False, 0.05, False),
     "This invoice shows minimal risk indicators with a risk score of 0/100. All key fraud "
     "indicators are within acceptable ranges. Recommended action: standard processing with "
     "routine audit."),
]


def test_audit_texts(spark):
    rows = [(i, float(p), d, b, s, t) for i, ((p, d, b, s, t), _) in enumerate(AUDIT)]
    df = spark.createDataFrame(
        rows, "i int, risk_score double, deviation_percentage double, bank_account_changed "
              "boolean, duplicate_similarity_score double, tax_mismatch boolean")
    got = {r.i: r.risk_explanation for r in explain.explain_audit(df).collect()}
    assert got == {i: text for i, (_, text) in enumerate(AUDIT)}


@pytest.mark.parametrize("points, word", [
    (61, "significant"), (60.9, "moderate"), (31, "moderate"), (30.9, "minimal")])
def test_audit_bands(spark, points, word):
    row = spark.range(1).select(explain.audit_text(
        F.lit(float(points)), F.lit(0.0), F.lit(False), F.lit(0.85), F.lit(False)).alias("t"))
    text = row.first().t
    assert word in text and "All key fraud indicators" in text


ENRICHED = ("invoice_id string, vendor_id string, amount double, tax double, bank_account string, "
            "ts timestamp, description string, payment_method string, deviation_percentage "
            "double, vendor_total_invoices long, vendor_avg_amount double, vendor_stddev_amount "
            "double, bank_account_changed boolean")


def enriched(spark, *rows):
    plain = dict(
        invoice_id="I", vendor_id="V", amount=5000.0, tax=350.0, bank_account="A",
        ts=dt.datetime(2024, 1, 3, 12), description="d", payment_method="ACH",
        deviation_percentage=0.0, vendor_total_invoices=20, vendor_avg_amount=5000.0,
        vendor_stddev_amount=10.0, bank_account_changed=False)
    return spark.createDataFrame(
        [tuple({**plain, "invoice_id": f"I{i}", **r}.values()) for i, r in enumerate(rows)],
        ENRICHED)


def test_worked_row(spark):
    row = enriched(spark, dict(
        amount=9750.0, tax=1170.0, deviation_percentage=60.0, vendor_total_invoices=2,
        vendor_avg_amount=100.0, vendor_stddev_amount=200.0, bank_account_changed=True,
        payment_method="Wire Transfer"))
    info = row.select("invoice_id", F.lit(True).alias("is_duplicate"))
    out = dec.decisions(risk.composite_risk(row, info)).first()
    assert round(out.amount_risk, 9) == 0.55
    assert round(out.vendor_risk, 9) == 0.795
    assert out.temporal_risk == 0.1
    assert round(out.pattern_risk, 9) == 0.78
    assert round(out.risk_score, 9) == 0.704
    assert (out.risk_level, out.confidence, out.decision) == ("HIGH", 0.5, "AUTO_REJECT")
    assert round(out.decision_confidence, 9) == 70.4
    assert dec.risk_alerts(risk.composite_risk(row, info)).first().priority == "HIGH"
    points = risk.realtime_risk(row).first()
    assert (points.risk_score, points.risk_level, points.decision) == (90, "High", "Reject")
    assert points.risk_breakdown == "Deviation:30 BankChange:40 Duplicate:0 TaxMismatch:20"


@pytest.mark.parametrize("field, value, risk_value", [
    ("amount", 50000.5, 0.8 * .25), ("amount", 50000.0, 0.5 * .25 + 0.4 * .05),
    ("amount", 25000.5, 0.5 * .25), ("amount", 25000.0, 0.3 * .25 + 0.4 * .05),
    ("amount", 10000.5, 0.3 * .25), ("amount", 10000.0, 0.1 * .25 + 0.4 * .05),
    ("amount", 9999.5, 0.1 * .25 + 0.9 * .35), ("amount", 9500.0, .025 + 0.9 * .35 + .2 * .05),
    ("amount", 9499.5, .025 + 0.6 * .35), ("amount", 9000.0, .025 + 0.6 * .35 + .4 * .05),
    ("amount", 8999.5, .025), ("amount", 4200.0, .025 + .2 * .05), ("amount", 4210.0, .025),
    ("deviation_percentage", -100.5, .025 + .02 + .9 * .35),
    ("deviation_percentage", 100.0, .025 + .02 + .6 * .35),
    ("deviation_percentage", 50.0, .025 + .02 + .3 * .35),
    ("deviation_percentage", 25.0, .025 + .02),
])
def test_amount_risk_bounds(spark, field, value, risk_value):
    out = risk.amount_risk(enriched(spark, {field: value})).first()
    assert out.amount_risk_score == pytest.approx(risk_value)


@pytest.mark.parametrize("n, sd, changed, want", [
    (1, 0.0, False, .24 + .02), (2, 0.0, False, .18 + .02), (4, 0.0, False, .09 + .02),
    (6, 0.0, False, .02), (6, 5000.0, False, .08), (6, 5000.5, False, .14),
    (6, 2500.0, False, .02), (6, 2500.5, False, .08), (6, 0.0, True, .02 + .475)])
def test_vendor_risk_bounds(spark, n, sd, changed, want):
    out = risk.vendor_risk(enriched(spark, dict(
        vendor_total_invoices=n, vendor_stddev_amount=sd, bank_account_changed=changed))).first()
    assert out.vendor_risk_score == pytest.approx(want)


@pytest.mark.parametrize("row, points, level, decision", [
    (dict(deviation_percentage=30.0), 0, "Low", "Approve"),
    (dict(deviation_percentage=-30.5), 30, "Low", "Approve"),
    (dict(bank_account_changed=True), 40, "Medium", "Review"),
    (dict(bank_account_changed=True, deviation_percentage=31.0), 70, "Medium", "Review"),
    (dict(bank_account_changed=True, deviation_percentage=31.0, tax=249.0), 90, "High", "Reject"),
    (dict(tax=250.0), 0, "Low", "Approve"), (dict(tax=249.99), 20, "Low", "Approve"),
    (dict(tax=500.0), 0, "Low", "Approve"), (dict(tax=500.01), 20, "Low", "Approve")])
def test_points_bounds(spark, row, points, level, decision):
    out = risk.realtime_risk(enriched(spark, row)).first()
    assert (out.risk_score, out.risk_level, out.decision) == (points, level, decision)


@pytest.mark.parametrize("similarity, points", [(0.85, 0), (0.8501, 50)])
def test_points_similarity(spark, similarity, points):
    df = enriched(spark, {}).withColumn("semantic_similarity_score", F.lit(similarity))
    assert risk.realtime_risk(df).first().risk_score == points


def test_points_cap(spark):
    df = enriched(spark, dict(bank_account_changed=True, deviation_percentage=99.0, tax=0.0))
    out = risk.realtime_risk(df.withColumn("duplicate_similarity_score", F.lit(0.9))).first()
    assert out.risk_score == 100


@pytest.mark.parametrize("score, decision, alert", [
    (0.29999, "AUTO_APPROVE", False), (0.3, "REVIEW_REQUIRED", False),
    (0.59999, "REVIEW_REQUIRED", False), (0.6, "REVIEW_REQUIRED", True),
    (0.69999, "REVIEW_REQUIRED", True), (0.7, "AUTO_REJECT", True)])
def test_decision_bounds(spark, score, decision, alert):
    df = spark.createDataFrame([("I", score)], "invoice_id string, risk_score double")
    out = dec.decisions(df)
    assert out.first().decision == decision
    assert relational.filter_high_risk(out).isEmpty() is not alert
    assert out.first().requires_action is (decision == "REVIEW_REQUIRED")


@pytest.mark.parametrize("score, priority", [(0.79, "HIGH"), (0.8, "CRITICAL")])
def test_alert_priority(spark, score, priority):
    df = spark.createDataFrame(
        [("I", "V", 1.0, score, "HIGH")],
        "invoice_id string, vendor_id string, amount double, risk_score double, "
        "risk_level string")
    assert dec.risk_alerts(df).first().priority == priority


def test_registry_bounds(spark, make):
    night = dt.datetime(2024, 1, 3, 4, 59)
    inv = make(
        dict(amount=80000.5), dict(amount=80000.0), dict(amount=40000.5), dict(amount=9000.5),
        dict(amount=9000.0), dict(amount=9999.5, bank_account="B"), dict(vendor_id="none"),
        dict(ts=night), dict(amount=80000.5, bank_account="B", ts=night))
    registry = spark.createDataFrame([("V1", "A1")], "vendor_id string, registered_account string")
    rows = {r.invoice_id: r for r in risk.registry_risk(inv, registry).collect()}
    assert [rows[f"I{i}"].risk_score for i in range(9)] == [
        0.4, 0.3, 0.2, 0.3, 0.1, 0.75, 0.45, 0.2, 1.0]
    assert rows["I0"].decision == "REVIEW_REQUIRED" and rows["I5"].decision == "AUTO_REJECT"
    assert rows["I1"].decision == "AUTO_APPROVE" and rows["I5"].is_alert


def test_fuzzy_tolerance(make):
    inv = make(dict(amount=100.0), dict(amount=101.0), dict(vendor_id="V2", amount=199.0),
               dict(vendor_id="V2", amount=101.0), dict(vendor_id="V3", amount=0.0),
               dict(vendor_id="V4", amount=1000.0, description=" A  b"),
               dict(vendor_id="V4", amount=1000.0, description="a B "))
    out = {(r.vendor_id, r.desc_normalized): r for r in duplicates.fuzzy_duplicates(inv).collect()}
    assert out["V1", "fee"].is_fuzzy_duplicate_group
    assert not out["V2", "fee"].is_fuzzy_duplicate_group
    assert out["V3", "fee"].amount_spread_pct is None
    merged = duplicates.fuzzy_duplicates(inv, normalize=True).where("vendor_id = 'V4'").first()
    assert (merged.count_in_bucket, merged.is_fuzzy_duplicate_group) == (2, True)


def test_single_zero_and_empty(make):
    inv = make(dict(vendor_id="one", amount=10.0), dict(vendor_id="zero", amount=0.0),
               dict(vendor_id="zero", amount=0.0))
    rows = {r.vendor_id: r for r in vendor.enrich_vendor(inv).collect()}
    assert rows["one"].bank_account_changed is False and rows["one"].vendor_stddev_amount == 0.0
    assert rows["zero"].deviation_percentage == 0.0 and rows["zero"].amount_vs_avg_ratio is None
    nothing = inv.where("false")
    out = scoring.build(nothing)
    assert all(out[name].isEmpty() for name in ("autonomous_decisions", "vendor_stats"))
    assert reports.decision_counts(out["autonomous_decisions"]).first().total == 0
    assert reports.kpi_cards(out["autonomous_decisions"]).first().automation_rate == 0.0
    week = reports.risk_trend_7d(out["autonomous_decisions"], dt.date(2024, 1, 7)).collect()
    assert len(week) == 7 and all(r.low_risk + r.medium_risk + r.high_risk == 0 for r in week)


def test_missing_values(make):
    inv = make(dict(description=None), dict(description=None), dict(payment_method=None),
               dict(ts=None), dict(tax=None), dict(bank_account=None))
    scored = scoring.score(inv)
    assert scored.count() == 6
    # NULL descriptions equal each other; the other rows share amount and description
    assert scored.where("is_duplicate").count() == 6
    assert scored.where("invoice_id = 'I0'").first().duplicate_count == 2
    assert explain.explain_audit(scored).where("risk_explanation IS NULL").isEmpty()


def test_wide_amounts_stay_exact(make):
    big = 90_000_000_000_000.0
    inv = make(dict(amount=big), dict(amount=big))
    row = vendor.vendor_stats(inv).first()
    assert row.total_amount == 2 * big and row.avg_amount == big
    assert row.stddev_amount == pytest.approx(0.0, abs=big * 1e-7)
    far = vendor.vendor_stats(make(dict(amount=4e7), dict(amount=8e7))).first()
    assert far.stddev_amount == pytest.approx(2e7)


def test_composite_equals_self_join(invoices):
    """One projection gives what joining the four component tables would."""
    rows = vendor.enrich_vendor(invoices)
    info = duplicates.exact_duplicates(invoices)
    w = scoring.DEFAULTS.composite_weights
    joined = (
        risk.amount_risk(rows).join(risk.vendor_risk(rows), "invoice_id")
        .join(risk.temporal_risk(rows), "invoice_id")
        .join(risk.pattern_risk(rows, info), "invoice_id")
        .selectExpr("invoice_id", f"round(amount_risk_score * {w['amount']}D + vendor_risk_score "
                    f"* {w['vendor']}D + temporal_risk_score * {w['temporal']!r}D + "
                    f"pattern_risk_score * {w['pattern']}D, 9) AS s"))
    once = risk.composite_risk(rows, info).selectExpr("invoice_id", "round(risk_score, 9) AS s")
    assert same(once, joined)


def test_reports_read_either_scale(spark):
    rows = [("2024-01-03 10:00:00", s) for s in (0.3, 0.31, 0.7, 0.71, 1.0)]
    df = spark.createDataFrame(rows, "t string, risk_score double").selectExpr(
        "CAST(t AS TIMESTAMP) AS ts", "risk_score")
    hundred = df.selectExpr("ts", "risk_score * 100 AS risk_score")
    for frame in (df, hundred):
        row = reports.risk_trend_7d(frame, dt.date(2024, 1, 3)).where("day = '2024-01-03'").first()
        assert (row.low_risk, row.medium_risk, row.high_risk) == (1, 2, 2)
        assert row.label == "Wed"


def test_prompt_defaults(spark):
    df = spark.createDataFrame([("I", 1234.5)], "invoice_id string, amount double")
    text = explain.explain_prompt(df).first().prompt
    assert "- Amount: $1,234.50\n- Description: N/A" in text
    assert "- Risk Score: 0.00 (UNKNOWN)" in text and "vs Average: 1.0x" in text


def test_run_batch_writes_six_outputs(spark, invoices, tmp_path):
    paths = scoring.run_batch(invoices, str(tmp_path))
    assert sorted(paths) == sorted(scoring.sinks.OUTPUT_NAMES)
    assert spark.read.json(paths["autonomous_decisions"]).count() == invoices.count()
    alerts = spark.read.json(paths["high_risk_alerts"])
    assert alerts.where("risk_score < 0.6").isEmpty() and not alerts.isEmpty()
