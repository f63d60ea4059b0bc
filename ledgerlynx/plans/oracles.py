"""The catalog's queries in plain SQL, for an independent engine.

Shared steps are common table expressions; ``sql(text, *names)`` prefixes the
ones a query needs, in order of dependence.
"""

from __future__ import annotations

from ledgerlynx.config import DEFAULTS
from ledgerlynx.operators import explain as ex

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def sql(body: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for n in CTES[name][0]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case(key: str, texts: dict[str, str]) -> str:
    *cases, last = texts.items()
    whens = " ".join(f"WHEN {key} = '{k}' THEN {text(v)}" for k, v in cases)
    return f"CASE {whens} ELSE {text(last[1])} END"


def rounded(expr: str, decimals: int, name: str) -> str:
    return f"round({expr}, {decimals}) + 0.0e0 AS {name}"


# ------------------------------------------------------------------ invoices

cte("base0", """
  SELECT o_orderkey AS k, o_custkey AS v,
         CAST(floor(o_totalprice*100+0.5) AS BIGINT) % 10000000 AS c0,
         o_orderdate, o_orderpriority, c_mktsegment
  FROM orders JOIN customer ON o_custkey = c_custkey""")
cte("base1", """
  SELECT *, CASE WHEN k % 17 = 0 THEN c0 - c0 % 100000
                 WHEN k % 19 = 0 THEN c0 - c0 % 10000 ELSE c0 END AS cents FROM base0""", "base0")
cte("variants", """
  SELECT concat('INV-', k) AS invoice_id, * FROM base1
  UNION ALL SELECT concat('INV-', k, '-D'), * FROM base1 WHERE k % 23 = 0
  UNION ALL SELECT concat('INV-', k, '-F'), k, v, c0, o_orderdate, o_orderpriority,
                   c_mktsegment, cents + CAST(floor(cents/400.0e0) AS BIGINT)
            FROM base1 WHERE k % 29 = 0
  UNION ALL SELECT concat('INV-', k, '-Z'), k, v, c0, o_orderdate, o_orderpriority,
                   c_mktsegment, 100000000 + c0 FROM base1 WHERE k % 101 = 0""", "base1")
cte("inv", """
  SELECT invoice_id, concat('VND-', v) AS vendor_id, cents AS amount_cents,
    cents/100.0e0 AS amount,
    CAST(floor(cents*(300 + (k*7919) % 900)/10000.0e0) AS BIGINT)/100.0e0 AS tax,
    CASE WHEN k % 31 = 0 THEN concat('ACC-9', v)
         WHEN v % 37 = 0 AND o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'
           THEN concat('ACC-5', v)
         ELSE concat('ACC-1', v) END AS bank_account,
    CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 MINUTE * (k % 1440) AS ts,
    o_orderpriority AS description, c_mktsegment AS category,
    CASE k % 4 WHEN 0 THEN 'Wire Transfer' WHEN 1 THEN 'Check'
               WHEN 2 THEN 'Credit Card' ELSE 'ACH' END AS payment_method
  FROM variants""", "variants")

# -------------------------------------------------------------------- vendor


def stats_columns(bank: str, window: str = "") -> str:
    o = f" OVER ({window})" if window else ""
    n, s = f"count(*){o}", f"sum(amount_cents){o}"
    ss = f"sum(CAST(amount_cents AS HUGEINT) * amount_cents){o}"
    return f"""
      {n} AS total_invoices,
      CAST({s} AS DOUBLE) / 100.0e0 AS total_amount,
      CAST({s} AS DOUBLE) / 100.0e0 / {n} AS avg_amount,
      max(amount){o} AS max_amount, min(amount){o} AS min_amount,
      max(ts){o} AS last_invoice_time, {bank}{o} AS last_bank_account,
      sqrt(CAST({n} * {ss} - {s} * {s} AS DOUBLE)) / {n} / 100.0e0 AS stddev_amount"""


cte("vs", f"SELECT vendor_id, {stats_columns('max(bank_account)')} FROM inv GROUP BY vendor_id",
    "inv")
cte("vs_latest", "SELECT vendor_id, "
    + stats_columns("max_by(bank_account, (ts, invoice_id))")
    + " FROM inv GROUP BY vendor_id", "inv")
DEVIATION = ("CASE WHEN avg_amount > 0 THEN (amount - avg_amount) / avg_amount * 100.0e0 "
             "ELSE 0.0e0 END")
cte("enr", f"""
  SELECT inv.*, avg_amount AS vendor_avg_amount, total_invoices AS vendor_total_invoices,
    total_amount AS vendor_total_amount, max_amount AS vendor_max_amount,
    min_amount AS vendor_min_amount, stddev_amount AS vendor_stddev_amount,
    last_bank_account AS vendor_last_bank_account,
    {DEVIATION} AS deviation_percentage,
    CASE WHEN avg_amount <> 0 THEN amount / avg_amount END AS amount_vs_avg_ratio,
    CASE WHEN max_amount <> 0 THEN amount / max_amount END AS amount_vs_max_ratio,
    total_invoices > 1 AND bank_account <> last_bank_account AS bank_account_changed
  FROM inv JOIN vs USING (vendor_id)""", "inv", "vs")
ENRICHED = """invoice_id, vendor_id, amount, tax, bank_account, ts, description, category,
  payment_method, vendor_avg_amount, vendor_total_invoices, vendor_total_amount,
  vendor_max_amount, vendor_min_amount, round(vendor_stddev_amount, 6) AS vendor_stddev_amount,
  vendor_last_bank_account, deviation_percentage, amount_vs_avg_ratio, amount_vs_max_ratio,
  bank_account_changed"""

# --------------------------------------------------------------------- risk

AMOUNT_RISK = """(CASE WHEN amount > 50000 THEN 0.8e0 WHEN amount > 25000 THEN 0.5e0
    WHEN amount > 10000 THEN 0.3e0 ELSE 0.1e0 END) * 0.25e0
  + (CASE WHEN amount >= 9500 AND amount < 10000 THEN 0.9e0
    WHEN amount >= 9000 AND amount < 9500 THEN 0.6e0 ELSE 0.0e0 END) * 0.35e0
  + (CASE WHEN abs(deviation_percentage) > 100 THEN 0.9e0
    WHEN abs(deviation_percentage) > 50 THEN 0.6e0
    WHEN abs(deviation_percentage) > 25 THEN 0.3e0 ELSE 0.0e0 END) * 0.35e0
  + (CASE WHEN floor(amount) <> amount THEN 0.0e0
    WHEN CAST(floor(amount) AS BIGINT) % 1000 = 0 THEN 0.4e0
    WHEN CAST(floor(amount) AS BIGINT) % 100 = 0 THEN 0.2e0 ELSE 0.0e0 END) * 0.05e0"""
VENDOR_RISK = """(CASE WHEN vendor_total_invoices <= 1 THEN 0.8e0
    WHEN vendor_total_invoices <= 3 THEN 0.6e0
    WHEN vendor_total_invoices <= 5 THEN 0.3e0 ELSE 0.0e0 END) * 0.3e0
  + (CASE WHEN vendor_stddev_amount > vendor_avg_amount THEN 0.7e0
    WHEN vendor_stddev_amount > vendor_avg_amount * 0.5e0 THEN 0.4e0 ELSE 0.1e0 END) * 0.2e0
  + (CASE WHEN bank_account_changed THEN 0.95e0 ELSE 0.0e0 END) * 0.5e0"""
PAYMENT = """(CASE payment_method WHEN 'Wire Transfer' THEN 0.6e0 WHEN 'Check' THEN 0.3e0
    ELSE 0.1e0 END)"""
PATTERN_DUP = f"{PAYMENT} * 0.4e0 + (CASE WHEN is_duplicate THEN 0.9e0 ELSE 0.0e0 END) * 0.6e0"
TEMPORAL_WEIGHT = repr(DEFAULTS.weight_temporal) if "e" in repr(DEFAULTS.weight_temporal) \
    else repr(DEFAULTS.weight_temporal) + "e0"


def composite(table: str, pattern: str) -> str:
    return f"""
  SELECT *, CASE WHEN composite_score >= 0.7e0 THEN 'HIGH'
                 WHEN composite_score >= 0.3e0 THEN 'MEDIUM' ELSE 'LOW' END AS weighted_level
  FROM (SELECT *, amount_risk * 0.35e0 + vendor_risk * 0.3e0
          + 0.1e0 * {TEMPORAL_WEIGHT} + pattern_risk * 0.35e0 AS composite_score
        FROM (SELECT *, {AMOUNT_RISK} AS amount_risk, {VENDOR_RISK} AS vendor_risk,
                     0.1e0 AS temporal_risk, {pattern} AS pattern_risk FROM {table}))"""


DUP_KEY = "PARTITION BY vendor_id, amount, description"
cte("enr_dup", f"SELECT *, count(*) OVER ({DUP_KEY}) > 1 AS is_duplicate FROM enr", "enr")
cte("weighted", composite("enr", PAYMENT), "enr")
cte("weighted_dup", composite("enr_dup", PATTERN_DUP), "enr_dup")


def points(table: str, sim: str) -> str:
    return f"""
  SELECT *, CASE WHEN risk_points > 70 THEN 'High' WHEN risk_points > 30 THEN 'Medium'
                 ELSE 'Low' END AS points_level,
    CASE WHEN risk_points > 70 THEN 'Reject' WHEN risk_points > 30 THEN 'Review'
         ELSE 'Approve' END AS points_decision,
    risk_points / 100.0e0 AS risk_score
  FROM (SELECT *, least(100, p1 + p2 + p3 + p4) AS risk_points,
          concat('Deviation:', p1, ' BankChange:', p2, ' Duplicate:', p3,
                 ' TaxMismatch:', p4) AS risk_breakdown,
          p1 > 0 AS deviation_triggered, p2 > 0 AS bank_change_triggered,
          p3 > 0 AS duplicate_triggered, p4 > 0 AS tax_mismatch_triggered
        FROM (SELECT *, {sim} AS sim,
                CASE WHEN abs(deviation_percentage) > 30 THEN 30 ELSE 0 END AS p1,
                CASE WHEN bank_account_changed THEN 40 ELSE 0 END AS p2,
                CASE WHEN {sim} > 0.85e0 THEN 50 ELSE 0 END AS p3,
                CASE WHEN tax < amount * 0.05e0 OR tax > amount * 0.1e0
                     THEN 20 ELSE 0 END AS p4
              FROM {table}))"""


cte("rt", points("enr", "0.0e0"), "enr")
# the wide scored row: points score over exact duplicates
cte("scored", "SELECT *, upper(points_level) AS risk_level FROM ("
    + points("weighted_dup", "0.0e0") + ")", "weighted_dup")


def decide(score: str) -> str:
    return (f"CASE WHEN {score} < 0.3e0 THEN 'AUTO_APPROVE' "
            f"WHEN {score} >= 0.7e0 THEN 'AUTO_REJECT' ELSE 'REVIEW_REQUIRED' END")


cte("decided", f"SELECT *, {decide('risk_score')} AS decision FROM scored", "scored")
cte("reg", """
  SELECT *, CASE WHEN risk_score >= 0.65e0 THEN 'HIGH' WHEN risk_score >= 0.35e0 THEN 'MEDIUM'
                 ELSE 'LOW' END AS risk_level,
    CASE WHEN risk_score >= 0.65e0 THEN 'AUTO_REJECT'
         WHEN risk_score >= 0.35e0 THEN 'REVIEW_REQUIRED' ELSE 'AUTO_APPROVE' END AS decision,
    risk_score >= 0.6e0 AS is_alert
  FROM (SELECT inv.*, coalesce(acc, '') AS registered_account, least(round(
          CASE WHEN amount > 80000 THEN 0.4e0 WHEN amount > 40000 THEN 0.2e0
               WHEN amount > 9000 AND amount < 10000 THEN 0.3e0 ELSE 0.0e0 END
          + CASE WHEN amount_cents % 100000 = 0 THEN 0.1e0 ELSE 0.0e0 END
          + CASE WHEN bank_account <> coalesce(acc, '') THEN 0.45e0 ELSE 0.0e0 END
          + CASE WHEN hour(ts) < 5 THEN 0.2e0 ELSE 0.0e0 END, 4), 1.0e0) AS risk_score
        FROM inv LEFT JOIN (SELECT concat('VND-', c_custkey) AS vid,
                                   concat('ACC-1', c_custkey) AS acc FROM customer)
          ON vendor_id = vid)""", "inv")

# ---------------------------------------------------------------- similarity

HASH8 = ("list_transform(range(0,8), lambda i: "
         "CAST(('0x'||substr(md5(lower({t})),1+2*i,2)) AS INT)/255.0e0)")
PIPE = "concat_ws(' | ', vendor_id, description, category, CAST(amount AS VARCHAR))"
LABELLED = ("concat('Vendor: ', vendor_id, '. Description: ', description, '. Category: ', "
            "category, '. Amount: $', CAST(amount AS VARCHAR))")
cte("emb_pipe", f"SELECT *, {HASH8.format(t=PIPE)} AS e FROM inv", "inv")
cte("emb_lab", f"SELECT *, {HASH8.format(t=LABELLED)} AS e, {LABELLED} AS txt FROM inv", "inv")
COS = "round(list_cosine_similarity({a}, {b}), 6)"


def vendor_pairs(name: str, source: str) -> None:
    cte(name, f"""
      SELECT a.invoice_id AS id_a, b.invoice_id AS id_b, a.vendor_id AS vendor_id,
        a.description AS description_a, b.description AS description_b,
        a.amount AS amount_a, b.amount AS amount_b, a.ts AS ts_a, b.ts AS ts_b,
        {COS.format(a='a.e', b='b.e')} AS sim
      FROM {source} a JOIN {source} b
        ON a.vendor_id = b.vendor_id AND a.invoice_id <> b.invoice_id""", source)


vendor_pairs("pairs_pipe", "emb_pipe")
vendor_pairs("pairs_lab", "emb_lab")
cte("vecs", "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings")
cte("vec_pairs", f"""
  SELECT a.vec_id AS id_a, b.vec_id AS id_b, a.label AS block,
    {COS.format(a='a.e', b='b.e')} AS similarity
  FROM vecs a JOIN vecs b ON a.label = b.label AND a.vec_id <> b.vec_id""", "vecs")


def best_text(threshold: str) -> str:
    return f"""
  SELECT g.*,
    g.copies > 1 OR o.other IS NOT NULL AS has_semantic_duplicate,
    CASE WHEN g.copies > 1 THEN 1.0e0 ELSE coalesce(o.sim, 0.0e0) END
      AS semantic_similarity_score,
    CASE WHEN g.copies > 1 AND g.invoice_id = g.first_id THEN g.last_id
         WHEN g.copies > 1 THEN g.first_id
         ELSE coalesce(o.other, '') END AS duplicate_invoice_id
  FROM (SELECT *, count(*) OVER w AS copies, min(invoice_id) OVER w AS first_id,
               max(invoice_id) OVER w AS last_id
        FROM emb_lab WINDOW w AS (PARTITION BY vendor_id, txt)) g
  LEFT JOIN (SELECT id_a, sim, id_b AS other FROM pairs_lab WHERE sim >= {threshold}
             QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY sim DESC, id_b) = 1) o
    ON g.invoice_id = o.id_a"""


cte("sem97", best_text("0.97e0"), "emb_lab", "pairs_lab")
cte("sem90", best_text("0.9e0"), "emb_lab", "pairs_lab")
cte("sem85", best_text("0.85e0"), "emb_lab", "pairs_lab")
SEM = "semantic_similarity_score, has_semantic_duplicate, duplicate_invoice_id"
cte("enr90", f"SELECT enr.*, {SEM} FROM enr JOIN (SELECT invoice_id, {SEM} FROM sem90) "
    "USING (invoice_id)", "enr", "sem90")
cte("enr85", f"SELECT enr.*, {SEM}, has_semantic_duplicate AS is_duplicate FROM enr "
    f"JOIN (SELECT invoice_id, {SEM} FROM sem85) USING (invoice_id)", "enr", "sem85")
cte("scored85", "SELECT *, upper(points_level) AS risk_level FROM ("
    + points("enr85", "semantic_similarity_score") + ")", "enr85")

# --------------------------------------------------------------------- texts

FACTOR = """CASE WHEN amount_risk > vendor_risk AND amount_risk > pattern_risk THEN 'amount'
  WHEN amount_risk <= vendor_risk AND vendor_risk > pattern_risk THEN 'vendor'
  ELSE 'pattern' END"""


def rule_columns(level: str) -> str:
    high = (f"concat({text(ex.RULE_HIGH_OPENING)}, {case('factor', ex.RULE_HIGH_REASON)}, "
            f"{text(ex.RULE_HIGH_CLOSING)})")
    return f"""CASE WHEN {level} = 'HIGH' THEN {high}
      WHEN {level} = 'MEDIUM' THEN {text(ex.RULE_MEDIUM)} ELSE {text(ex.RULE_LOW)} END
      AS explanation,
    {case('factor', ex.RULE_FACTORS)} AS key_factors,
    {case(level, ex.RULE_ADVICE)} AS recommendations"""


def prompt() -> str:
    style = {"text": "CAST({c} AS VARCHAR)", "grouped2": "format('{{:,.2f}}', {c})",
             "fixed2": "format('{{:.2f}}', {c})", "fixed1": "format('{{:.1f}}', {c})"}
    parts = []
    for lead, name, how, default in ex.PROMPT_LINES:
        parts.append(text(lead))
        if name is not None:
            d = text(default) if isinstance(default, str) else (
                f"{default}e0" if isinstance(default, float) else str(default))
            parts.append(style[how].format(c=f"coalesce({name}, {d})"))
    return "concat(" + ", ".join(parts) + ")"


def audit(sim: str) -> str:
    band = ("CASE WHEN risk_points >= 61 THEN 'high' WHEN risk_points >= 31 THEN 'medium' "
            "ELSE 'low' END")
    factors = f"""list_filter([
        CASE WHEN abs(deviation_percentage) > 30 THEN concat('amount deviation of ',
          format('{{:.1f}}', abs(deviation_percentage)),
          '% from vendor''s historical average') END,
        CASE WHEN bank_account_changed THEN 'recent bank account change' END,
        CASE WHEN {sim} > 0.85e0 THEN concat('high similarity (', format('{{:.2f}}', {sim}),
          ') to existing invoices') END,
        CASE WHEN tax_mismatch_triggered THEN 'tax calculation inconsistency' END],
      lambda x: x IS NOT NULL)"""
    return f"""SELECT *, concat(severity, ' with a risk score of ', risk_points, '/100. ',
      CASE WHEN n = 0 THEN {text(ex.AUDIT_NONE)}
           WHEN n = 1 THEN concat({text(ex.AUDIT_ONE[0])}, f[1], {text(ex.AUDIT_ONE[1])})
           WHEN n = 2 THEN concat({text(ex.AUDIT_TWO[0])}, f[1], ' and ', f[2],
                                  {text(ex.AUDIT_TWO[1])})
           ELSE concat({text(ex.AUDIT_MANY[0])}, array_to_string(f[1:n-1], ', '), ', and ',
                       f[n], {text(ex.AUDIT_MANY[1])}) END,
      'Recommended action: ', action, '.') AS risk_explanation
    FROM (SELECT *, len(f) AS n, {case('band', ex.AUDIT_SEVERITY)} AS severity,
            {case('band', ex.AUDIT_ACTION)} AS action
          FROM (SELECT *, {band} AS band, {factors} AS f FROM """


# ------------------------------------------------------------------- queries

ORACLES: dict[str, str] = {}
INV9 = ("invoice_id, vendor_id, amount, tax, bank_account, ts, description, category, "
        "payment_method")
ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"


def oracle(name: str, body: str, *needs: str) -> None:
    ORACLES[name] = sql(body, *needs)


oracle("invoices", "SELECT * FROM inv", "inv")
oracle("read_invoices", f"SELECT {INV9}, {ISO} AS timestamp FROM inv", "inv")
oracle("read_jsonl_latest",
       "SELECT invoice_id, vendor_id, amount, ts, risk_score, decision FROM reg", "reg")
REASON = """CASE WHEN risk_score < 0.3e0 THEN 'Low risk score - invoice meets all safety criteria'
  WHEN risk_score >= 0.7e0 THEN 'High fraud probability - multiple risk factors detected'
  ELSE 'Moderate risk - requires manual verification' END"""
CONFIDENCE = """CASE WHEN risk_score < 0.3e0 THEN (1.0e0 - risk_score) * 100.0e0
  WHEN risk_score >= 0.7e0 THEN risk_score * 100.0e0 ELSE 50.0e0 END"""



def digest(name: str, key: str, amount: str, source: str) -> str:
    return (f"SELECT '{name}' AS output, count(*) AS n_rows, count(DISTINCT {key}) AS n_keys, "
            f"coalesce(round(CAST(sum(CAST({amount} AS DECIMAL(28,6))) AS DOUBLE), 2), 0.0e0) AS amount FROM {source}")


DIGESTS = " UNION ALL ".join([
    digest("high_risk_alerts", "invoice_id", "risk_score", "scored WHERE risk_score >= 0.6e0"),
    digest("explanations", "invoice_id", "length(explanation)", f"""(SELECT *, {rule_columns('risk_level')}
      FROM (SELECT *, {FACTOR} AS factor FROM scored) WHERE risk_score >= 0.6e0)"""),
    digest("vendor_stats", "vendor_id", "total_amount", "vs"),
    digest("autonomous_decisions", "invoice_id", "risk_score", "decided"),
    digest("all_invoices_explained", "invoice_id", "length(risk_explanation)",
           "(SELECT * FROM (" + audit("0.0e0") + "scored))))"),
    digest("realtime_risk_scores", "invoice_id", "risk_score", "scored"),
])
oracle("write_jsonl", DIGESTS, "decided", "vs")
oracle("stream_outputs", DIGESTS, "decided", "vs")
oracle("stream_alerts", "SELECT invoice_id, risk_score, risk_level FROM scored WHERE risk_score >= 0.6e0", "scored")
oracle("stream_explanations", f"""SELECT invoice_id, explanation FROM (SELECT *, {rule_columns('risk_level')}
  FROM (SELECT *, {FACTOR} AS factor FROM scored) WHERE risk_score >= 0.6e0)""", "scored")
oracle("append_decisions", """SELECT 'all' AS log, invoice_id, risk_score, decision FROM reg
UNION ALL SELECT 'alerts', invoice_id, risk_score, decision FROM reg WHERE risk_score >= 0.6e0""", "reg")
ALERT = """SELECT invoice_id, vendor_id, amount, risk_score, risk_level,
  concat('HIGH RISK: Invoice ', invoice_id, ' from vendor ', vendor_id,
         ' flagged with risk score ', CAST(risk_score AS VARCHAR)) AS alert_message,
  true AS requires_review,
  CASE WHEN risk_score >= 0.8e0 THEN 'CRITICAL' ELSE 'HIGH' END AS priority
FROM scored WHERE risk_level = 'HIGH'"""
oracle("export_csv", ALERT, "scored")
oracle("bounded_buffer", """SELECT invoice_id, vendor_id, amount, ts FROM inv
ORDER BY ts DESC, invoice_id DESC LIMIT 500""", "inv")

oracle("select_extend", """SELECT * REPLACE (lower(category) AS category),
  amount - tax AS net_amount FROM inv""", "inv")
oracle("select_project", """SELECT invoice_id AS id, vendor_id AS vendor,
  CASE WHEN amount <> 0 THEN tax / amount END AS tax_share FROM inv""", "inv")
oracle("filter_high_risk",
       "SELECT invoice_id, risk_score, risk_level FROM scored WHERE risk_score >= 0.6e0", "scored")
oracle("filter_bool", """SELECT invoice_id, vendor_id, deviation_percentage FROM enr
WHERE abs(deviation_percentage) > 50""", "enr")
PAIR25 = "SELECT * FROM vec_pairs WHERE similarity >= 0.25e0"
oracle("filter_pair", "SELECT * FROM vec_pairs WHERE similarity >= 0.3e0", "vec_pairs")
oracle("drop_null_ts", f"""SELECT invoice_id, {ISO} AS timestamp, ts FROM inv
WHERE payment_method <> 'Check'""", "inv")
oracle("select_rename_display", """SELECT invoice_id AS "INVOICE", vendor_id AS "VENDOR",
  amount AS "AMOUNT" FROM inv""", "inv")

oracle("join_vendor_stats", """SELECT invoice_id, vendor_id, amount, tax, bank_account, ts,
  total_invoices AS vendor_total_invoices, total_amount AS vendor_total_amount,
  avg_amount AS vendor_avg_amount, max_amount AS vendor_max_amount,
  min_amount AS vendor_min_amount, round(stddev_amount, 6) AS vendor_stddev_amount,
  last_invoice_time AS vendor_last_invoice_time,
  last_bank_account AS vendor_last_bank_account
FROM inv JOIN vs USING (vendor_id)""", "inv", "vs")
PATTERNS = """SELECT vendor_id, category, count, avg_amount,
  count / CAST(sum(count) OVER (PARTITION BY vendor_id) AS DOUBLE) AS frequency
FROM (SELECT vendor_id, category, count(*) AS count,
        CAST(sum(amount_cents) AS DOUBLE) / 100.0e0 / count(*) AS avg_amount
      FROM inv GROUP BY vendor_id, category)"""
oracle("category_patterns", PATTERNS, "inv")
oracle("join_category_totals",
       f"SELECT vendor_id, category, count, frequency FROM ({PATTERNS})", "inv")
oracle("join_dup_counts", """SELECT invoice_id, count(*) OVER w > 1 AS is_duplicate,
  count(*) OVER w AS duplicate_count, min(invoice_id) OVER w AS first_invoice_id
FROM inv WINDOW w AS (PARTITION BY vendor_id, description, category)""", "inv")
oracle("join_vendor_selfpairs", PAIR25, "vec_pairs")
oracle("join_left_dup_flag", """SELECT invoice_id,
  invoice_id IN (SELECT id_a FROM pairs_lab WHERE sim >= 0.97e0) AS is_duplicate
FROM inv""", "inv", "pairs_lab")
oracle("join_left_semantic", """SELECT vec_id, label, id_a IS NOT NULL AS has_match,
  coalesce(similarity, 0.0e0) AS similarity, coalesce(id_b, -1) AS match_id
FROM vecs LEFT JOIN (SELECT * FROM vec_pairs WHERE similarity >= 0.25e0
  QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY similarity DESC, id_b) = 1)
  ON vec_id = id_a""", "vecs", "vec_pairs")
oracle("join_registry", "SELECT invoice_id, bank_account, registered_account FROM reg", "reg")

STATS = """SELECT vendor_id, total_invoices, total_amount, avg_amount, max_amount, min_amount,
  last_invoice_time, last_bank_account, round(stddev_amount, 6) AS stddev_amount FROM """
oracle("vendor_stats", STATS + "vs", "vs")
oracle("vendor_stats_latest", STATS + "vs_latest", "vs_latest")
oracle("stream_vendor_stats", STATS + "vs", "vs")
oracle("dup_key_counts", """SELECT vendor_id, amount, description, count(*) AS duplicate_count,
  min(invoice_id) AS first_invoice_id, CAST(sum(amount_cents) AS DOUBLE) / 100.0e0 AS group_total
FROM inv GROUP BY vendor_id, amount, description""", "inv")
TOTAL = "CAST(sum(amount_cents) AS DOUBLE) / 100.0e0 AS total_amount"
oracle("risk_summary", f"""SELECT risk_level, count(*) AS count,
  {rounded('avg(risk_score)', 6, 'avg_risk_score')}, {TOTAL}
FROM scored GROUP BY risk_level""", "scored")
oracle("alert_summary_amount", f"""SELECT risk_level, count(*) AS count, {TOTAL}
FROM scored GROUP BY risk_level""", "scored")
oracle("alert_summary_score", f"""SELECT risk_level, count(*) AS count,
  {rounded('avg(risk_score)', 6, 'avg_score')}
FROM scored WHERE risk_score >= 0.6e0 GROUP BY risk_level""", "scored")
VENDOR_RISKS = f"""SELECT vendor_id, count(*) AS total_invoices,
  count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk_count,
  {rounded('avg(risk_score)', 6, 'avg_risk_score')}, {TOTAL}
FROM scored GROUP BY vendor_id"""
oracle("vendor_risk_summary", VENDOR_RISKS, "scored")
oracle("monitoring_tables", f"""
SELECT 'alert_summary' AS view, risk_level AS key, {rounded('avg(risk_score)', 6, 'value')}
  FROM scored WHERE risk_score >= 0.6e0 GROUP BY risk_level
UNION ALL SELECT 'vendor_risk_summary', vendor_id, round(avg(risk_score), 6) + 0.0e0 FROM scored GROUP BY vendor_id
UNION ALL SELECT 'vendor_stats', vendor_id, round(avg_amount, 6) + 0.0e0 FROM vs
UNION ALL SELECT 'all_risk_scores', invoice_id, round(risk_score, 6) + 0.0e0 FROM scored
UNION ALL SELECT 'high_risk_alerts', invoice_id, round(risk_score, 6) + 0.0e0 FROM scored WHERE risk_score >= 0.6e0""",
       "scored", "vs")
REPORT = f"""SELECT count(*) AS total_flagged,
  count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk_count,
  count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium_risk_count,
  {rounded('avg(risk_score)', 6, 'avg_risk_score')} FROM scored"""
oracle("batch_report", REPORT, "scored")
oracle("batch_report_window", REPORT + """ WHERE ts >= TIMESTAMP '1997-01-01 00:00:00'
  AND ts < TIMESTAMP '1998-01-01 00:00:00'""", "scored")
oracle("decision_counts", """SELECT
  count(*) FILTER (WHERE decision = 'AUTO_APPROVE') AS approved,
  count(*) FILTER (WHERE decision = 'REVIEW_REQUIRED') AS under_review,
  count(*) FILTER (WHERE decision = 'AUTO_REJECT') AS rejected, count(*) AS total
FROM decided""", "decided")
oracle("kpi_cards", """SELECT count(*) AS total_invoices,
  count(*) FILTER (WHERE risk_score >= 0.6e0) AS high_risk,
  round(CAST(count(*) FILTER (WHERE decision IN ('AUTO_APPROVE', 'AUTO_REJECT')) AS DOUBLE)
    / count(*) * 100.0e0, 6) AS automation_rate FROM decided""", "decided")
oracle("kpi_monthly", """SELECT CAST(month AS VARCHAR) AS month, invoices, coalesce(prev, 0) AS prev_invoices,
  CASE WHEN coalesce(prev, 0) > 0
    THEN round(CAST(invoices - prev AS DOUBLE) / prev * 100.0e0, 6) + 0.0e0
    ELSE 0.0e0 END AS change_pct
FROM (SELECT month, invoices, CASE WHEN lag(month) OVER (ORDER BY month)
          = CAST(month - INTERVAL 1 MONTH AS DATE) THEN lag(invoices) OVER (ORDER BY month) END AS prev
      FROM (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS invoices
            FROM inv GROUP BY 1))""", "inv")
cte("bucketed", """SELECT CAST(ts AS DATE) AS day,
  CASE WHEN risk_score * scale <= 30 THEN 1 WHEN risk_score * scale <= 70 THEN 2 ELSE 3 END AS b
FROM scored, (SELECT CASE WHEN max(risk_score) <= 1 THEN 100.0e0 ELSE 1.0e0 END AS scale
              FROM scored)""", "scored")
oracle("group_size_pivot", """SELECT CAST(day AS VARCHAR) AS day, count(*) FILTER (WHERE b = 1) AS "Low Risk",
  count(*) FILTER (WHERE b = 2) AS "Medium Risk", count(*) FILTER (WHERE b = 3) AS "High Risk"
FROM bucketed GROUP BY day""", "bucketed")
oracle("risk_trend_7d", """SELECT CAST(c.day AS VARCHAR) AS day, strftime(c.day, '%a') AS label,
  count(*) FILTER (WHERE b = 1) AS low_risk, count(*) FILTER (WHERE b = 2) AS medium_risk,
  count(*) FILTER (WHERE b = 3) AS high_risk
FROM (SELECT CAST(unnest(generate_series(DATE '1998-06-24', DATE '1998-06-30',
        INTERVAL 1 DAY)) AS DATE) AS day) c
LEFT JOIN bucketed USING (day) GROUP BY c.day""", "bucketed")

oracle("top_alerts", """SELECT invoice_id, vendor_id, risk_score FROM scored
WHERE risk_score >= 0.6e0 ORDER BY risk_score DESC, invoice_id LIMIT 3""", "scored")
oracle("recent_transactions", """SELECT invoice_id, ts, amount, decision FROM reg
ORDER BY ts DESC, invoice_id DESC LIMIT 15""", "reg")
oracle("similarity_sort", PAIR25 + " ORDER BY similarity DESC, id_a, id_b", "vec_pairs")

oracle("exact_duplicates", f"""SELECT invoice_id, count(*) OVER w > 1 AS is_duplicate,
  count(*) OVER w AS duplicate_count,
  CAST(sum(amount_cents) OVER w AS DOUBLE) / 100.0e0 AS duplicate_group_total,
  min(invoice_id) OVER w AS first_invoice_id FROM inv WINDOW w AS ({DUP_KEY})""", "inv")
oracle("fuzzy_duplicates", """SELECT vendor_id, desc_normalized, amount_bucket,
  count_in_bucket, min_amount, max_amount,
  CASE WHEN max_amount <> 0 THEN (max_amount - min_amount) / max_amount * 100.0e0 END
    AS amount_spread_pct,
  count_in_bucket > 1 AND coalesce(CASE WHEN max_amount <> 0
    THEN (max_amount - min_amount) / max_amount END <= 0.01e0, false)
    AS is_fuzzy_duplicate_group
FROM (SELECT vendor_id, description AS desc_normalized,
        CAST(floor(amount / 100.0e0) AS BIGINT) * 100 AS amount_bucket,
        count(*) AS count_in_bucket, min(amount) AS min_amount, max(amount) AS max_amount
      FROM inv GROUP BY 1, 2, 3)""", "inv")
oracle("embed_text_pipe", f"SELECT invoice_id, {PIPE} AS text FROM inv", "inv")
oracle("embed_text_labelled", f"SELECT invoice_id, {LABELLED} AS semantic_text FROM inv", "inv")
ELEMENTS = ", ".join(f"e[{i + 1}] AS e{i}" for i in range(8))
oracle("embed_hash", f"""SELECT doc_id, {ELEMENTS}
FROM (SELECT doc_id, {HASH8.format(t='text')} AS e FROM documents)""")
oracle("embed_model", f"""SELECT doc_id, {ELEMENTS}
FROM (SELECT doc_id, list_transform(range(8,16), lambda i:
        CAST(('0x'||substr(md5(text),1+2*i,2)) AS INT)/255.0e0) AS e FROM documents)""")
oracle("embed_distinct", f"""SELECT md5(text) AS text_md5, n_rows, {ELEMENTS}
FROM (SELECT text, count(*) AS n_rows, {HASH8.format(t='text')} AS e
      FROM documents GROUP BY text)""")
oracle("cosine", f"""SELECT vec_id,
  {COS.format(a='e', b='list_reverse(e)')} + 0.0e0 AS similarity FROM vecs""", "vecs")
DETECT = """SELECT id_a AS invoice_id_1, id_b AS invoice_id_2, amount_a AS amount_1,
  amount_b AS amount_2, ts_a AS ts_1, ts_b AS ts_2, sim AS similarity
FROM pairs_pipe WHERE sim >= 0.85e0"""
WEEK = " AND abs(epoch(ts_a) - epoch(ts_b)) <= 604800"
oracle("detect_duplicates", DETECT, "pairs_pipe")
oracle("detect_duplicates_window", DETECT + WEEK, "pairs_pipe")
oracle("stream_duplicates", DETECT + WEEK, "pairs_pipe")
oracle("semantic_duplicates", """SELECT id_a AS invoice_id, id_b AS duplicate_of, vendor_id,
  description_a AS description, description_b AS duplicate_description, amount_a AS amount,
  amount_b AS duplicate_amount, sim AS semantic_similarity, true AS is_semantic_duplicate,
  'SEMANTIC' AS duplicate_type FROM pairs_lab WHERE sim >= 0.85e0""", "pairs_lab")
oracle("enrich_semantic", f"SELECT invoice_id, {SEM} FROM sem97", "sem97")
oracle("find_similar", f"""SELECT a.vec_id AS vec_id, b.vec_id AS match_id,
  {COS.format(a='a.e', b='b.e')} AS similarity FROM vecs a, vecs b
WHERE {COS.format(a='a.e', b='b.e')} >= 0.4e0""", "vecs")
for name, same_as in (("find_similar_stored", "find_similar"), ("vendor_selfpairs_metric", "join_vendor_selfpairs"),
                      ("semantic_duplicates_metric", "semantic_duplicates")):
    ORACLES[name] = ORACLES[same_as]

EVENT_WINDOWS = """SELECT vendor_id, count(*) AS invoice_count,
  CAST(sum(cents) AS DOUBLE) / 100.0e0 AS total_amount, w AS window_start,
  w + INTERVAL {length} MINUTE AS window_end
FROM (SELECT CAST(user_id AS VARCHAR) AS vendor_id,
        CAST(round(value * 100) AS BIGINT) AS cents,
        time_bucket(INTERVAL {hop} MINUTE, ts) - k * INTERVAL {hop} MINUTE AS w, ts
      FROM events, (SELECT unnest(range(0, {count})) AS k))
WHERE ts < w + INTERVAL {length} MINUTE GROUP BY vendor_id, w"""
oracle("velocity", EVENT_WINDOWS.format(length=60, hop=5, count=12))
oracle("stream_velocity", EVENT_WINDOWS.format(length=60, hop=5, count=12))
for name in ("stream_panes_velocity", "stream_late_reconciled"):
    ORACLES[name] = ORACLES["velocity"]
oracle("stream_windows", f"""SELECT * FROM ({EVENT_WINDOWS.format(length=60, hop=5, count=12)})
WHERE window_end <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)""")
oracle("stream_late_rows", """WITH e AS (SELECT *, event_id % 4 AS q FROM events),
  newest AS (SELECT q, max(ts) AS t FROM e GROUP BY q)
SELECT CAST(event_id AS VARCHAR) AS invoice_id, CAST(user_id AS VARCHAR) AS vendor_id, value AS amount, ts,
  CAST(q AS BIGINT) AS _batch
FROM e WHERE ts < (SELECT max(t) - INTERVAL 1 DAY FROM newest WHERE newest.q < e.q)""")
oracle("velocity_uneven_hop", EVENT_WINDOWS.format(length=45, hop=30, count=2))
PRIOR = ("PARTITION BY vendor_id ORDER BY ts, invoice_id "
         "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
UP_TO = PRIOR.replace("1 PRECEDING", "CURRENT ROW")
ANOMALY = """SELECT invoice_id, avg_amount AS vendor_avg,
  round(stddev_amount, 6) AS vendor_stddev, max_amount AS vendor_max,
  total_invoices AS vendor_total_invoices, round(z, 6) + 0.0e0 AS amount_z_score,
  abs(z) > 3 AS is_amount_anomaly, total_invoices <= 3 AS is_new_vendor,
  coalesce(amount > max_amount * 1.5e0, false) AS exceeds_historical_max
FROM (SELECT *, CASE WHEN stddev_amount > 0 THEN (amount - avg_amount) / stddev_amount
                     ELSE 0.0e0 END AS z FROM {source})"""
oracle("anomalies", ANOMALY.format(source="inv JOIN vs USING (vendor_id)"), "inv", "vs")
cte("prior", "SELECT invoice_id, vendor_id, amount, bank_account, "
    + stats_columns("max(bank_account)", PRIOR).replace("/ count(*) OVER", "/ nullif_count OVER")
    + " FROM inv", "inv")
CTES["prior"] = (("inv",), CTES["prior"][1].replace(
    f"nullif_count OVER ({PRIOR})", f"nullif(count(*) OVER ({PRIOR}), 0)"))
oracle("anomalies_prior", ANOMALY.format(source="prior"), "prior")
BANK = """SELECT invoice_id, inv.vendor_id, bank_account AS current_bank_account,
  last_bank_account AS previous_bank_account, total_invoices AS vendor_total_invoices,
  total_invoices > 1 AND bank_account <> last_bank_account AS bank_account_changed
FROM inv JOIN {stats} USING (vendor_id)"""
oracle("bank_changes", BANK.format(stats="vs").replace("inv.vendor_id", "vendor_id"), "inv", "vs")
oracle("bank_changes_latest",
       BANK.format(stats="vs_latest").replace("inv.vendor_id", "vendor_id"), "inv", "vs_latest")
oracle("bank_changes_previous", """SELECT invoice_id, vendor_id,
  bank_account AS current_bank_account, prev AS previous_bank_account,
  rn - 1 AS vendor_total_invoices, coalesce(bank_account <> prev, false) AS bank_account_changed
FROM (SELECT *, lag(bank_account) OVER w AS prev, row_number() OVER w AS rn FROM inv
      WINDOW w AS (PARTITION BY vendor_id ORDER BY ts, invoice_id))""", "inv")
oracle("deviation", """SELECT invoice_id, vendor_id, amount, vendor_avg_amount,
  vendor_total_invoices, deviation_percentage,
  abs(deviation_percentage) AS abs_deviation_percentage,
  abs(deviation_percentage) > 50 AS is_high_deviation FROM enr""", "enr")
oracle("enrich_vendor", f"SELECT {ENRICHED} FROM enr", "enr")
oracle("live_enrichment", f"SELECT {ENRICHED} FROM enr", "enr")
ARRIVAL = f"""SELECT invoice_id, vendor_id, total_invoices AS vendor_total_invoices,
  total_amount AS vendor_total_amount, avg_amount AS vendor_avg_amount,
  max_amount AS vendor_max_amount, min_amount AS vendor_min_amount,
  round(stddev_amount, 6) AS vendor_stddev_amount,
  last_bank_account AS vendor_last_bank_account
FROM (SELECT invoice_id, vendor_id, {stats_columns('max(bank_account)', UP_TO)} FROM inv)"""
oracle("arrival_history", ARRIVAL, "inv")
oracle("stream_arrival", ARRIVAL, "inv")

oracle("amount_risk", f"SELECT invoice_id, {rounded(AMOUNT_RISK, 6, 'amount_risk_score')} "
       "FROM enr", "enr")
oracle("vendor_risk", f"SELECT invoice_id, {rounded(VENDOR_RISK, 6, 'vendor_risk_score')} "
       "FROM enr", "enr")
oracle("temporal_risk", "SELECT invoice_id, 0.1e0 AS temporal_risk_score FROM inv", "inv")
oracle("temporal_risk_calendar", """SELECT invoice_id,
  CASE WHEN dayofweek(ts) IN (0, 6) OR hour(ts) < 8 OR hour(ts) >= 18 THEN 0.5e0
       ELSE 0.1e0 END AS temporal_risk_score FROM inv""", "inv")
oracle("pattern_risk", f"SELECT invoice_id, {rounded(PATTERN_DUP, 6, 'pattern_risk_score')} "
       "FROM enr_dup", "enr_dup")
oracle("pattern_risk_plain",
       f"SELECT invoice_id, {PAYMENT} AS pattern_risk_score FROM inv", "inv")
oracle("composite_risk", """SELECT invoice_id, vendor_id, amount, tax, bank_account, ts,
  description, round(amount_risk, 6) AS amount_risk, round(vendor_risk, 6) AS vendor_risk,
  temporal_risk, round(pattern_risk, 6) AS pattern_risk,
  round(composite_score, 6) AS risk_score, weighted_level AS risk_level,
  CASE WHEN vendor_total_invoices > 10 THEN 0.9e0 WHEN vendor_total_invoices > 5 THEN 0.7e0
       ELSE 0.5e0 END AS confidence FROM weighted_dup""", "weighted_dup")
oracle("composite_factors", """SELECT invoice_id, concat_ws(',', CAST(amount_risk AS VARCHAR),
  CAST(vendor_risk AS VARCHAR), CAST(temporal_risk AS VARCHAR),
  CAST(pattern_risk AS VARCHAR)) AS risk_factors FROM weighted""", "weighted")
REALTIME = """SELECT invoice_id, vendor_id, amount, tax, risk_points AS risk_score,
  points_level AS risk_level, points_decision AS decision, deviation_triggered,
  bank_change_triggered, duplicate_triggered, tax_mismatch_triggered, risk_breakdown
FROM """
oracle("realtime_risk", REALTIME + "rt", "rt")
oracle("realtime_risk_semantic",
       REALTIME + f"({points('enr90', 'semantic_similarity_score')})", "enr90")
oracle("registry_risk",
       "SELECT invoice_id, risk_score, risk_level, decision, is_alert FROM reg", "reg")

oracle("decisions", f"""SELECT invoice_id, risk_points, risk_score, risk_level, decision,
  {rounded(CONFIDENCE, 6, 'decision_confidence')},
  decision = 'REVIEW_REQUIRED' AS requires_action, decision = 'AUTO_APPROVE' AS auto_approved,
  decision = 'AUTO_REJECT' AS auto_rejected, {REASON} AS decision_reason
FROM decided""", "decided")
oracle("risk_alerts", ALERT, "scored")
oracle("explain_rule", f"""SELECT invoice_id, vendor_id,
  round(composite_score, 6) AS risk_score, weighted_level AS risk_level,
  {rule_columns('weighted_level')} FROM (SELECT *, {FACTOR} AS factor FROM weighted)""",
       "weighted")
oracle("explain_prompt", f"SELECT invoice_id, {prompt()} AS prompt FROM scored", "scored")
oracle("explain_model", f"""SELECT invoice_id, concat('digest ', md5({prompt()})) AS explanation,
  {text(ex.MODEL_FACTORS)} AS key_factors, {text(ex.MODEL_ADVICE)} AS recommendations
FROM scored WHERE risk_score >= 0.6e0""", "scored")
oracle("explain_model_failing", f"""SELECT invoice_id,
  CASE WHEN m LIKE '0%' THEN explanation ELSE concat('digest ', m) END AS explanation,
  CASE WHEN m LIKE '0%' THEN key_factors ELSE {text(ex.MODEL_FACTORS)} END AS key_factors,
  CASE WHEN m LIKE '0%' THEN recommendations ELSE {text(ex.MODEL_ADVICE)} END AS recommendations
FROM (SELECT *, {rule_columns('risk_level')}, md5({prompt()}) AS m FROM (SELECT *, {FACTOR} AS factor FROM scored))""", "scored")
oracle("explain_audit", "SELECT invoice_id, risk_explanation FROM ("
       + audit("0.0e0") + "scored)))", "scored")
oracle("format_alert_text", f"""SELECT invoice_id, vendor_id, risk_level,
  CAST(risk_score AS VARCHAR) AS risk_score,
  concat(chr(128680), ' ', risk_level, ' RISK ALERT', chr(10), chr(10), 'Invoice: ',
    invoice_id, chr(10), 'Vendor: ', vendor_id, chr(10), 'Risk Score: ',
    CAST(risk_score AS VARCHAR), chr(10), chr(10), 'Explanation:', chr(10), explanation,
    chr(10), chr(10), 'Key Factors: ', key_factors, chr(10), chr(10), 'Recommendations:',
    chr(10), recommendations) AS summary
FROM (SELECT *, {rule_columns('risk_level')} FROM (SELECT *, {FACTOR} AS factor FROM scored)
      WHERE risk_score >= 0.6e0)""", "scored")
oracle("scored_invoices", """SELECT invoice_id, risk_points, risk_score, risk_level,
  is_duplicate, risk_explanation FROM (""" + audit("semantic_similarity_score")
       + "scored85)))", "scored85")
oracle("scored_invoices_weighted", f"""SELECT invoice_id,
  round(composite_score, 6) AS risk_score, weighted_level AS risk_level,
  {decide('composite_score')} AS decision, is_duplicate FROM weighted_dup""", "weighted_dup")
oracle("transactions_view", """SELECT invoice_id AS "INVOICE", vendor_id AS "VENDOR",
  concat('₹', format('{:,.0f}', amount)) AS "AMOUNT", risk_score AS "RISK SCORE",
  CASE decision WHEN 'AUTO_APPROVE' THEN 'Approved' WHEN 'AUTO_REJECT' THEN 'Rejected'
    WHEN 'REVIEW_REQUIRED' THEN 'Pending' END AS "STATUS",
  strftime(ts, '%H:%M') AS "TIME" FROM reg""", "reg")

oracle("vendor_stats_fine_amounts", STATS + """(SELECT vendor_id, count(*) AS total_invoices,
    CAST(sum(amount_cents) AS DOUBLE) / 100000.0e0 AS total_amount,
    CAST(sum(amount_cents) AS DOUBLE) / 100000.0e0 / count(*) AS avg_amount,
    max(amount_cents / 100000.0e0) AS max_amount, min(amount_cents / 100000.0e0) AS min_amount,
    max(ts) AS last_invoice_time, max(bank_account) AS last_bank_account,
    sqrt(CAST(count(*) * sum(CAST(amount_cents AS HUGEINT) * amount_cents)
      - sum(amount_cents) * sum(amount_cents) AS DOUBLE)) / count(*) / 100000.0e0 AS stddev_amount
  FROM inv GROUP BY vendor_id)""", "inv")
# the shared steps over invoices of which some have no vendor
cte("nv_inv", """SELECT * REPLACE (CASE WHEN CAST(substr(vendor_id, 5) AS BIGINT) % 7 = 0 THEN NULL
  ELSE vendor_id END AS vendor_id) FROM inv""", "inv")
cte("nv_vs", f"SELECT vendor_id, {stats_columns('max(bank_account)')} FROM nv_inv GROUP BY vendor_id", "nv_inv")
cte("nv_enr", f"""SELECT nv_inv.*, avg_amount AS vendor_avg_amount, total_invoices AS vendor_total_invoices,
    {DEVIATION} AS deviation_percentage,
    coalesce(total_invoices > 1 AND bank_account <> last_bank_account, false) AS bank_account_changed
  FROM nv_inv JOIN nv_vs ON nv_inv.vendor_id IS NOT DISTINCT FROM nv_vs.vendor_id""", "nv_inv", "nv_vs")
cte("nv_points", points("nv_enr", "0.0e0"), "nv_enr")
oracle("decisions_null_vendor", f"""SELECT invoice_id, vendor_id, risk_points, {decide('risk_score')} AS decision
FROM nv_points""", "nv_points")
ORACLES["stream_null_vendor"] = ORACLES["decisions_null_vendor"]
# and over invoices of which some have a huge amount
cte("hv_inv", """SELECT * REPLACE (CASE WHEN amount_cents % 97 = 0 THEN 40000000000000000 ELSE amount_cents END AS amount_cents,
  CASE WHEN amount_cents % 97 = 0 THEN 4.0e14 ELSE amount END AS amount) FROM inv""", "inv")
cte("hv_vs", f"SELECT vendor_id, {stats_columns('max(bank_account)')} FROM hv_inv GROUP BY vendor_id", "hv_inv")
cte("hv_enr", f"""SELECT hv_inv.*, avg_amount AS vendor_avg_amount, total_amount AS vendor_total_amount,
    total_invoices AS vendor_total_invoices, {DEVIATION} AS deviation_percentage,
    coalesce(total_invoices > 1 AND bank_account <> last_bank_account, false) AS bank_account_changed
  FROM hv_inv JOIN hv_vs USING (vendor_id)""", "hv_inv", "hv_vs")
cte("hv_points", points("hv_enr", "0.0e0"), "hv_enr")
oracle("decisions_huge_amount", f"""SELECT invoice_id, risk_points, {decide('risk_score')} AS decision,
  CAST(floor(vendor_total_amount / 1000) AS BIGINT) AS total_thousands FROM hv_points""", "hv_points")
ORACLES["stream_snapshots"] = ORACLES["stream_outputs"]
ORACLES["arrival_history_by_rows"] = ORACLES["arrival_history"]
ORACLES["embed_stored"] = ORACLES["embed_model"]

oracle("similar_approx", f"""SELECT label, count(*) AS n_exact, CAST(0 AS BIGINT) AS n_wrong,
  true AS recall_reached FROM (SELECT block AS label FROM ({PAIR25})) GROUP BY label""", "vec_pairs")
oracle("embed_lexical", r"""SELECT doc_id, CASE WHEN regexp_matches(text, '\w') THEN 1.0e0 ELSE 0.0e0 END AS length
FROM documents""")
