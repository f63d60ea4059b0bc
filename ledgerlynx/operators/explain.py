"""Texts that explain a score. All of them are column expressions."""

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlynx.config import DEFAULTS, Thresholds
from ledgerlynx.functions.columns import col_or
from ledgerlynx.functions.text import fixed, float_text, grouped
from ledgerlynx.operators.risk import similarity_of

# Fixed texts: readers and downstream reports match on them.
RULE_HIGH_OPENING = (
    "This invoice has been flagged as HIGH RISK due to multiple suspicious indicators. ")
RULE_HIGH_REASON = {
    "amount": "The invoice amount is significantly unusual compared to historical patterns. ",
    "vendor": "The vendor exhibits suspicious behavior patterns or limited history. ",
    "pattern": "The invoice matches known fraud patterns or duplicates. ",
}
RULE_HIGH_CLOSING = "Immediate manual review is recommended."
RULE_MEDIUM = (
    "This invoice shows MEDIUM RISK indicators. "
    "While not immediately suspicious, it warrants closer inspection during routine review.")
RULE_LOW = (
    "This invoice appears to be LOW RISK with normal patterns consistent with vendor history.")
RULE_FACTORS = {
    "amount": "Unusual amount, Deviation from vendor average",
    "vendor": "New or suspicious vendor, Limited transaction history",
    "pattern": "Pattern matching, Potential duplicate",
}
RULE_ADVICE = {
    "HIGH": "1. Verify vendor legitimacy, 2. Contact vendor directly, "
            "3. Review supporting documentation, 4. Hold payment pending investigation",
    "MEDIUM": "1. Verify invoice details, 2. Confirm with requesting department, "
              "3. Review vendor history",
    "LOW": "1. Process normally, 2. Periodic audit recommended",
}
MODEL_FACTORS = "LLM-generated analysis"
MODEL_ADVICE = "See explanation for details"

AUDIT_SEVERITY = {
    "high": "This invoice presents significant fraud indicators",
    "medium": "This invoice exhibits moderate risk factors",
    "low": "This invoice shows minimal risk indicators",
}
AUDIT_ACTION = {
    "high": "immediate manual review and payment hold",
    "medium": "verification of invoice details and vendor confirmation",
    "low": "standard processing with routine audit",
}
AUDIT_NONE = "All key fraud indicators are within acceptable ranges. "
AUDIT_ONE = ("The primary concern is ",
             ". This pattern warrants attention as it deviates from normal transaction behavior. ")
AUDIT_TWO = ("Multiple fraud indicators were detected: ",
             ". The combination of these factors elevates the risk profile substantially. ")
AUDIT_MANY = ("Multiple critical fraud indicators were identified: ",
              ". The convergence of these anomalies requires immediate attention "
              "to prevent potential financial loss. ")

# (text before the value, column or None, how to write it, default)
PROMPT_LINES = [
    ("You are a financial fraud detection expert. Analyze the following invoice and explain "
     "why it was flagged as potentially fraudulent.\n\nInvoice Details:\n- Invoice ID: ",
     "invoice_id", "text", "N/A"),
    ("\n- Vendor ID: ", "vendor_id", "text", "N/A"),
    ("\n- Amount: $", "amount", "grouped2", 0.0),
    ("\n- Description: ", "description", "text", "N/A"),
    ("\n- Category: ", "category", "text", "N/A"),
    ("\n- Payment Method: ", "payment_method", "text", "N/A"),
    ("\n\nRisk Assessment:\n- Risk Score: ", "risk_score", "fixed2", 0.0),
    (" (", "risk_level", "text", "UNKNOWN"),
    (")\n- Amount Risk: ", "amount_risk", "fixed2", 0.0),
    ("\n- Vendor Risk: ", "vendor_risk", "fixed2", 0.0),
    ("\n- Pattern Risk: ", "pattern_risk", "fixed2", 0.0),
    ("\n\nVendor Historical Context:\n- Total Previous Invoices: ",
     "vendor_total_invoices", "text", 0),
    ("\n- Average Amount: $", "vendor_avg_amount", "grouped2", 0.0),
    ("\n- This Invoice vs Average: ", "amount_vs_avg_ratio", "fixed1", 1.0),
    ("x\n\nProvide a concise explanation (2-3 sentences) covering:\n"
     "1. The primary fraud indicators\n2. Why these patterns are suspicious\n"
     "3. Recommended next steps\n\n"
     "Keep the explanation clear and actionable for financial reviewers.",
     None, None, None),
]


def _by_key(key: Column, texts: dict[str, str]) -> Column:
    """Text of a key; the last entry covers every other key."""
    *cases, last = texts.items()
    out = F
    for k, text in cases:
        out = out.when(key == k, F.lit(text))
    return out.otherwise(F.lit(last[1]))


def primary_factor(scored: DataFrame) -> Column:
    """The strictly greatest of amount, vendor and pattern risk; ties go to pattern,
    between amount and vendor to vendor."""
    amount, vendor, pattern = (col_or(scored, f"{n}_risk", 0.0) for n in ("amount", "vendor", "pattern"))
    return (F.when((amount > vendor) & (amount > pattern), "amount")
            .when((amount <= vendor) & (vendor > pattern), "vendor")
            .otherwise("pattern"))


def rule_texts(scored: DataFrame) -> list[Column]:
    """Explanation, key factors and recommendations from the level and main factor."""
    factor, level = primary_factor(scored), col_or(scored, "risk_level", "LOW")
    high = F.concat(F.lit(RULE_HIGH_OPENING), _by_key(factor, RULE_HIGH_REASON),
                    F.lit(RULE_HIGH_CLOSING))
    return [F.when(level == "HIGH", high).when(level == "MEDIUM", F.lit(RULE_MEDIUM))
            .otherwise(F.lit(RULE_LOW)).alias("explanation"),
            _by_key(factor, RULE_FACTORS).alias("key_factors"),
            _by_key(level, RULE_ADVICE).alias("recommendations")]


def explain_rule(scored: DataFrame) -> DataFrame:
    """Every invoice with the texts of ``rule_texts``."""
    return scored.select("invoice_id", "vendor_id", "risk_score", "risk_level", *rule_texts(scored))


def prompt_text(scored: DataFrame) -> Column:
    """The prompt for a text model; missing columns take their default."""
    writers = {
        "text": lambda c: c.cast("string"),
        "grouped2": lambda c: grouped(c.cast("double"), 2),
        "fixed2": lambda c: fixed(c.cast("double"), 2),
        "fixed1": lambda c: fixed(c.cast("double"), 1),
    }
    pieces = []
    for lead, name, style, default in PROMPT_LINES:
        pieces.append(F.lit(lead))
        if name is not None:
            value = F.coalesce(col_or(scored, name, default), F.lit(default))
            pieces.append(writers[style](value))
    return F.concat(*pieces).alias("prompt")


def explain_prompt(scored: DataFrame) -> DataFrame:
    """A prompt for a text model per invoice."""
    return scored.select("invoice_id", prompt_text(scored))


def answers(model: Callable[[list[str]], Sequence[str]], prompts: list[str]) -> list[str | None]:
    """One text per prompt. A call that fails, or that does not give a text for each prompt, is
    repeated with either half of its prompts, until a bad one is alone and gets None."""
    if not prompts:
        return []
    try:
        texts = list(model(prompts))
    except Exception:  # whatever a model raises concerns its prompts only
        texts = []
    if len(texts) == len(prompts) and all(isinstance(t, str) for t in texts):
        return texts
    if len(prompts) == 1:
        return [None]
    half = len(prompts) // 2
    return answers(model, prompts[:half]) + answers(model, prompts[half:])


def explain_model(
    scored: DataFrame,
    load: Callable[[], Callable[[list[str]], list[str]]] | None = None,
) -> DataFrame:
    """Explanations by a text model; by rule where no model is given or it fails.

    ``load`` runs once per Python worker and returns a function from a list of
    prompts to a list of texts. Each distinct prompt of a batch is sent once; a prompt for which
    the model has no answer gets the rule's text, and others are not affected.
    """
    if load is None:
        return explain_rule(scored)

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for prompts in batches:
            distinct = prompts.unique().tolist()
            yield prompts.map(dict(zip(distinct, answers(model, distinct))))

    told = scored.select("invoice_id", prompt_text(scored), *rule_texts(scored)).withColumn("__answer", answer("prompt"))
    text = F.col("__answer")
    return told.select(
        "invoice_id", F.coalesce(text, F.col("explanation")).alias("explanation"),
        F.when(text.isNull(), F.col("key_factors")).otherwise(F.lit(MODEL_FACTORS)).alias("key_factors"),
        F.when(text.isNull(), F.col("recommendations")).otherwise(F.lit(MODEL_ADVICE)).alias("recommendations"))


def audit_text(
    points: Column, deviation_pct: Column, bank_changed: Column,
    similarity: Column, tax_mismatch: Column, t: Thresholds = DEFAULTS,
) -> Column:
    """Three- to four-sentence explanation from the facts of a row (points 0-100)."""
    distance = F.abs(deviation_pct)
    factors = F.array_compact(F.array(
        F.when(distance > F.lit(t.deviation_pct), F.concat(
            F.lit("amount deviation of "), fixed(distance, 1),
            F.lit("% from vendor's historical average"))),
        F.when(bank_changed, F.lit("recent bank account change")),
        F.when(similarity > F.lit(t.similarity), F.concat(
            F.lit("high similarity ("), fixed(similarity, 2),
            F.lit(") to existing invoices"))),
        F.when(tax_mismatch, F.lit("tax calculation inconsistency")),
    ))
    n = F.size(factors)
    band = (F.when(points >= F.lit(t.audit_high), "high")
            .when(points >= F.lit(t.audit_medium), "medium").otherwise("low"))
    listed = F.concat(
        F.array_join(F.slice(factors, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "),
        F.lit(", and "), F.try_element_at(factors, F.lit(-1)))

    def around(frame: tuple[str, str], middle: Column) -> Column:
        return F.concat(F.lit(frame[0]), middle, F.lit(frame[1]))

    middle = (
        F.when(n == 0, F.lit(AUDIT_NONE))
        .when(n == 1, around(AUDIT_ONE, F.try_element_at(factors, F.lit(1))))
        .when(n == 2, around(AUDIT_TWO, F.array_join(factors, " and ")))
        .otherwise(around(AUDIT_MANY, listed)))
    return F.concat(
        _by_key(band, AUDIT_SEVERITY), F.lit(" with a risk score of "), fixed(points, 0),
        F.lit("/100. "), middle, F.lit("Recommended action: "), _by_key(band, AUDIT_ACTION),
        F.lit("."))


def explain_audit(scored: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Every column plus ``risk_explanation``.

    Points come from ``risk_points``, or from ``risk_score`` where a frame has
    only that one (then on the 0-100 scale).
    """
    points = F.col("risk_points" if "risk_points" in scored.columns else "risk_score")
    tax = col_or(scored, "tax_mismatch", col_or(scored, "tax_mismatch_triggered", False))
    return scored.withColumn("risk_explanation", audit_text(
        points.cast("double"), F.col("deviation_percentage"), F.col("bank_account_changed"),
        F.expr(similarity_of(scored)), tax, t))


def format_alert_text(explanations: DataFrame) -> DataFrame:
    """Multi-line summary of an explanation for display."""
    score = float_text(F.col("risk_score").cast("double"))
    return explanations.select(
        "invoice_id", "vendor_id", "risk_level", score.alias("risk_score"),
        F.concat(
            F.lit("🚨 "), F.col("risk_level"), F.lit(" RISK ALERT\n\nInvoice: "),
            F.col("invoice_id"), F.lit("\nVendor: "), F.col("vendor_id"),
            F.lit("\nRisk Score: "), score, F.lit("\n\nExplanation:\n"), F.col("explanation"),
            F.lit("\n\nKey Factors: "), F.col("key_factors"),
            F.lit("\n\nRecommendations:\n"), F.col("recommendations")).alias("summary"))
