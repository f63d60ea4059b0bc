"""Named queries over the data folder; ``oracles.py`` has their SQL.

Every query reads whole tables. A query may round a column whose last digits
depend on the engine (averages of doubles, square roots); nothing else is
changed on the way out.
"""

import datetime as dt
import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlynx.functions import vectors
from ledgerlynx.operators import (
    decisions as dec, duplicates, embedding, explain, metric, relational, reports, risk, similarity, vendor)
from ledgerlynx.plans import scoring
from ledgerlynx.session import DISK_STATE, ROCKSDB_STATE, scratch_path, settings_of
from ledgerlynx.sources import invoices as src
from ledgerlynx.sources import jsonl, sinks
from ledgerlynx.streaming import live, outputs, pairs, tables
from ledgerlynx.streaming.panes import PaneLog, stream_panes, stream_windows as windows_on_stream
from ledgerlynx.streaming.snapshots import SnapshotLog
from ledgerlynx.streaming import vendor as stream_vendor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TREND_END = dt.date(1998, 6, 30)
PAIR_THRESHOLD = 0.25
CROSS_THRESHOLD = 0.4
# key and one value of each output
OUTPUT_FIELDS = {
    "high_risk_alerts": "invoice_id string, risk_score double",
    "explanations": "invoice_id string, explanation string",
    "vendor_stats": "vendor_id string, total_amount double",
    "autonomous_decisions": "invoice_id string, risk_score double",
    "all_invoices_explained": "invoice_id string, risk_explanation string",
    "realtime_risk_scores": "invoice_id string, risk_score double",
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, decimals: int, *columns: str) -> DataFrame:
    # + 0.0 turns a negative zero into zero
    return df.withColumns({c: F.round(c, decimals) + F.lit(0.0) for c in columns})


def as_text(df: DataFrame, column: str) -> DataFrame:
    """Dates as ISO text: clients disagree on the type they load a DATE into."""
    return df.withColumn(column, F.col(column).cast("string"))


table = src.read_table


def enriched(spark, d) -> DataFrame:
    return vendor.enrich_vendor(src.load_invoices(spark, d))


def scored(spark, d) -> DataFrame:
    return scoring.score(src.load_invoices(spark, d))


def weighted(spark, d) -> DataFrame:
    """The wide row under the weighted score, without the duplicate join."""
    return risk.add_composite(enriched(spark, d))


def registry_scored(spark, d) -> DataFrame:
    return risk.registry_risk(src.load_invoices(spark, d), src.load_registry(spark, d))


# -------------------------------------------------------- sources and sinks

@query
def invoices(spark, d):
    return src.load_invoices(spark, d)


@query
def read_invoices(spark, d):
    path = scratch_path(spark, "feed")
    src.load_invoices(spark, d).withColumn(
        "timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    ).select([f.name for f in src.INVOICE_FEED.fields]).write.parquet(path)
    return src.read_invoices(spark, path)


@query
def read_jsonl_latest(spark, d):
    path = scratch_path(spark, "log")
    final = registry_scored(spark, d).withColumn(
        "timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    pending = final.withColumn("decision", F.lit("PENDING"))
    for version, rows in ((1, final), (0, pending)):
        rows.select([f.name for f in jsonl.DECISION_LOG.fields]) \
            .withColumn("_version", F.lit(version)).write.mode("append").json(path)
    schema = jsonl.T.StructType(
        jsonl.DECISION_LOG.fields + [jsonl.T.StructField("_version", jsonl.T.LongType())])
    return jsonl.read_jsonl_latest(spark, path, schema, version="_version").select(
        "invoice_id", "vendor_id", "amount", "ts", "risk_score", "decision")


@query
def write_jsonl(spark, d):
    paths = scoring.run_batch(src.load_invoices(spark, d), scratch_path(spark, "out"))
    return digests(spark, paths)


def digests(spark, paths, latest=False):
    """Every output read back: its rows, distinct ids and a few of its values, added up."""
    tables_ = {}
    for name, path in paths.items():
        fields = OUTPUT_FIELDS[name]
        schema = jsonl.T.StructType.fromDDL(fields)
        tables_[name] = jsonl.read_jsonl_latest(spark, path, schema, key=fields.split()[0]) if latest \
            else spark.read.schema(schema).json(path)
    return digests_of(tables_)


def digests_of(outputs_):
    found = []
    for name, rows in sorted(outputs_.items()):
        fields = OUTPUT_FIELDS[name]
        key, value = fields.split()[0], fields.split(",")[1].split()[0]
        size = F.col(value) if "double" in fields.split(",")[1] else F.length(value).cast("double")
        found.append(rows.agg(
            F.lit(name).alias("output"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"),
            F.coalesce(F.round(F.sum(size.cast("decimal(28,6)")).cast("double"), 2), F.lit(0.0)).alias("amount")))
    return reduce(DataFrame.unionByName, found)


@query
def append_decisions(spark, d):
    out = scratch_path(spark, "decisions")
    sinks.append_decisions(
        registry_scored(spark, d).drop("is_alert"), f"{out}/all", f"{out}/alerts", batch_id=0)
    fields = "invoice_id string, risk_score double, decision string"
    logs = [spark.read.schema(fields).json(f"{out}/{log}").select(
        F.lit(log).alias("log"), "invoice_id", "risk_score", "decision") for log in ("all", "alerts")]
    return logs[0].unionByName(logs[1])


@query
def export_csv(spark, d):
    out = scratch_path(spark, "csv")
    sinks.export_csv(dec.risk_alerts(scored(spark, d)), out)
    return spark.read.option("header", True).schema(
        "invoice_id string, vendor_id string, amount double, risk_score double, "
        "risk_level string, alert_message string, requires_review boolean, priority string"
    ).csv(out)


@query
def bounded_buffer(spark, d):
    return reports.bounded_buffer(src.load_invoices(spark, d)).select(
        "invoice_id", "vendor_id", "amount", "ts")


# ---------------------------------------------------- projection and filter

@query
def select_extend(spark, d):
    return relational.select_extend(
        src.load_invoices(spark, d),
        net_amount=F.col("amount") - F.col("tax"), category=F.lower("category"))


@query
def select_project(spark, d):
    return relational.select_project(
        src.load_invoices(spark, d), id="invoice_id", vendor="vendor_id",
        tax_share=F.try_divide("tax", "amount"))


@query
def filter_high_risk(spark, d):
    return relational.filter_high_risk(scored(spark, d)).select(
        "invoice_id", "risk_score", "risk_level")


@query
def filter_bool(spark, d):
    return relational.filter_flag(
        vendor.deviation(src.load_invoices(spark, d)), "is_high_deviation"
    ).select("invoice_id", "vendor_id", "deviation_percentage")


@query
def filter_pair(spark, d):
    return relational.filter_pair(
        join_vendor_selfpairs(spark, d), "id_a", "id_b", "similarity", 0.3)


@query
def drop_null_ts(spark, d):
    text = F.when(F.col("payment_method") == "Check", F.lit("no date")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    rows = src.load_invoices(spark, d).withColumn("timestamp", text).drop("ts")
    return relational.drop_null_ts(rows).select("invoice_id", "timestamp", "ts")


@query
def select_rename_display(spark, d):
    return relational.select_rename_display(src.load_invoices(spark, d), reports.DISPLAY_NAMES)


# -------------------------------------------------------------------- joins

@query
def join_vendor_stats(spark, d):
    inv = src.load_invoices(spark, d)
    return rounded(
        vendor.join_vendor_stats(inv, vendor.vendor_stats(inv)), 6, "vendor_stddev_amount"
    ).drop("amount_cents", "category", "description", "payment_method")


@query
def join_category_totals(spark, d):
    return vendor.category_patterns(src.load_invoices(spark, d)).select(
        "vendor_id", "category", "count", "frequency")


@query
def join_dup_counts(spark, d):
    return duplicates.exact_duplicates(
        src.load_invoices(spark, d), ["vendor_id", "description", "category"]
    ).select("invoice_id", "is_duplicate", "duplicate_count", "first_invoice_id")


@query
def join_vendor_selfpairs(spark, d):
    return similarity.similar_pairs(
        table(spark, d, "embeddings"), "vec_id", "embedding", PAIR_THRESHOLD, "label")


@query
def join_left_dup_flag(spark, d):
    inv = src.load_invoices(spark, d)
    found = similarity.enrich_semantic(inv, 0.97).where("has_semantic_duplicate").select("invoice_id")
    return risk.join_left_dup_flag(inv, found).select("invoice_id", "is_duplicate")


@query
def join_left_semantic(spark, d):
    rows = table(spark, d, "embeddings")
    best = similarity.best_matches(rows, "vec_id", "embedding", PAIR_THRESHOLD, "label")
    return rows.join(best, F.col("vec_id") == F.col("id"), "left").select(
        "vec_id", "label", F.col("id").isNotNull().alias("has_match"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.coalesce("other_id", F.lit(-1)).alias("match_id"))


@query
def join_registry(spark, d):
    return risk.join_registry(src.load_invoices(spark, d), src.load_registry(spark, d)).select(
        "invoice_id", "bank_account", "registered_account")


# ------------------------------------------------------------- aggregations

def _stats(spark, d, rule):
    return rounded(
        vendor.vendor_stats(src.load_invoices(spark, d), rule), 6, "stddev_amount")


@query
def vendor_stats(spark, d):
    return _stats(spark, d, "max")


@query
def vendor_stats_latest(spark, d):
    return _stats(spark, d, "latest")


@query
def category_patterns(spark, d):
    return vendor.category_patterns(src.load_invoices(spark, d))


@query
def dup_key_counts(spark, d):
    return duplicates.dup_key_counts(src.load_invoices(spark, d))


@query
def risk_summary(spark, d):
    return rounded(reports.risk_summary(scored(spark, d)), 6, "avg_risk_score")


@query
def alert_summary_amount(spark, d):
    return reports.alert_summary_amount(scored(spark, d))


@query
def alert_summary_score(spark, d):
    alerts = relational.filter_high_risk(scored(spark, d))
    return rounded(reports.alert_summary_score(alerts), 6, "avg_score")


@query
def vendor_risk_summary(spark, d):
    return rounded(reports.vendor_risk_summary(scored(spark, d)), 6, "avg_risk_score")


@query
def batch_report(spark, d):
    return rounded(reports.batch_report(scored(spark, d)), 6, "avg_risk_score")


@query
def batch_report_window(spark, d):
    return rounded(reports.batch_report(
        scored(spark, d), since="1997-01-01 00:00:00", until="1998-01-01 00:00:00"),
        6, "avg_risk_score")


@query
def decision_counts(spark, d):
    return reports.decision_counts(dec.decisions(scored(spark, d)))


@query
def kpi_cards(spark, d):
    return rounded(reports.kpi_cards(dec.decisions(scored(spark, d))), 6, "automation_rate")


@query
def kpi_monthly(spark, d):
    return as_text(rounded(
        reports.kpi_monthly(src.load_invoices(spark, d)), 6, "change_pct"), "month")


@query
def group_size_pivot(spark, d):
    return as_text(reports.group_size_pivot(scored(spark, d)), "day")


# ----------------------------------------------------------- sort and limit

@query
def top_alerts(spark, d):
    return reports.top_alerts(relational.filter_high_risk(scored(spark, d))).select(
        "invoice_id", "vendor_id", "risk_score")


@query
def recent_transactions(spark, d):
    return reports.recent_transactions(registry_scored(spark, d)).select(
        "invoice_id", "ts", "amount", "decision")


@query
def similarity_sort(spark, d):
    return reports.similarity_sort(
        join_vendor_selfpairs(spark, d), "similarity", "id_a", "id_b")


# ------------------------------------------------- duplicates and similarity

@query
def exact_duplicates(spark, d):
    return duplicates.exact_duplicates(src.load_invoices(spark, d)).select(
        "invoice_id", "is_duplicate", "duplicate_count", "duplicate_group_total",
        "first_invoice_id")


@query
def fuzzy_duplicates(spark, d):
    return duplicates.fuzzy_duplicates(src.load_invoices(spark, d))


@query
def embed_text_pipe(spark, d):
    return embedding.embed_text_pipe(src.load_invoices(spark, d)).select("invoice_id", "text")


@query
def embed_text_labelled(spark, d):
    return embedding.embed_text_labelled(src.load_invoices(spark, d)).select(
        "invoice_id", "semantic_text")


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Vector elements as columns e0, e1, ..."""
    return df.select(*keys, *[F.col("embedding")[i].alias(f"e{i}") for i in range(8)])


@query
def embed_hash(spark, d):
    return _spread(embedding.hash_embedder(table(spark, d, "documents"), "text"), "doc_id")


def digest_model():
    """A stand-in for a sentence model: vectors from the bytes of a digest."""

    def encode(texts: list[str]) -> list[list[float]]:
        return [[b / 255.0 for b in hashlib.md5(t.encode()).digest()[8:]] for t in texts]

    return encode


@query
def embed_model(spark, d):
    embed = embedding.model_embedder(digest_model)
    return _spread(embed(table(spark, d, "documents"), "text", "embedding"), "doc_id")


@query
def embed_distinct(spark, d):
    out = embedding.embed_distinct(table(spark, d, "documents"), "text")
    return _spread(out.withColumn("text_md5", F.md5("text")), "text_md5", "n_rows")


@query
def embed_stored(spark, d):
    """A store that has seen the odd documents embeds the others and gives all vectors."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    store = embedding.EmbeddingCache(scratch_path(spark, "vectors"), embedding.model_embedder(digest_model))
    store.store(docs.where("doc_id % 2 = 1"), "text")
    return _spread(store(docs, "text"), "doc_id")


@query
def embed_lexical(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = embedding.lexical_embedder()(docs, "text", "embedding")
    # unit vectors, zeros for a text without words
    return out.select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length"))


@query
def cosine(spark, d):
    """Each vector against itself read backwards."""
    rows = table(spark, d, "embeddings")
    return rounded(rows.select(
        "vec_id", vectors.cosine(F.col("embedding"), F.reverse("embedding")).alias("similarity")),
        6, "similarity")


@query
def detect_duplicates(spark, d):
    return similarity.detect_duplicates(src.load_invoices(spark, d))


@query
def detect_duplicates_window(spark, d):
    return similarity.detect_duplicates(
        src.load_invoices(spark, d), time_window_hours=24 * 7)


@query
def semantic_duplicates(spark, d):
    return similarity.semantic_duplicates(src.load_invoices(spark, d))


@query
def enrich_semantic(spark, d):
    return similarity.enrich_semantic(src.load_invoices(spark, d), 0.97).select(
        "invoice_id", "has_semantic_duplicate", "semantic_similarity_score",
        "duplicate_invoice_id")


@query
def find_similar(spark, d):
    rows = table(spark, d, "embeddings")
    return similarity.find_similar(
        rows, rows, "vec_id", "vec_id", threshold=CROSS_THRESHOLD)


@query
def find_similar_stored(spark, d):
    """A stored index, searched by the even and then by the odd vectors."""
    rows = table(spark, d, "embeddings")
    index = metric.PivotIndex.build(rows, "vec_id", "embedding", scratch_path(spark, "index"), part_rows=64)
    halves = [similarity.find_similar(
        rows.where(F.col("vec_id") % 2 == half), rows, "vec_id", "vec_id", threshold=CROSS_THRESHOLD, part_rows=64,
        ordered=False, index=index) for half in (0, 1)]
    return halves[0].unionByName(halves[1])


@query
def vendor_selfpairs_metric(spark, d):
    """Blocks of a label cut into small parts, so each is split by pivots."""
    return similarity.similar_pairs(
        table(spark, d, "embeddings"), "vec_id", "embedding", PAIR_THRESHOLD, "label", part_rows=16)


@query
def semantic_duplicates_metric(spark, d):
    return similarity.semantic_duplicates(src.load_invoices(spark, d), part_rows=8)


@query
def similar_approx(spark, d):
    """By label: exact pairs, approximate pairs that are none of them, and whether the recall is 0.6 or more
    (over all labels)."""
    exact = join_vendor_selfpairs(spark, d).select("id_a", "id_b", F.col("block").alias("label"), F.lit(1).alias("exact"))
    approx = similarity.similar_approx(
        table(spark, d, "embeddings"), "vec_id", "embedding", PAIR_THRESHOLD, "label") \
        .select("id_a", "id_b", F.col("block").alias("label"), F.lit(1).alias("approx"))
    both = exact.join(approx, ["id_a", "id_b", "label"], "full")
    per_label = both.groupBy("label").agg(
        F.count("exact").alias("n_exact"), F.count_if(F.col("exact").isNull()).alias("n_wrong"),
        F.count_if(F.col("exact").isNotNull() & F.col("approx").isNotNull()).alias("n_found"))
    recall = per_label.select(F.sum("n_found") / F.sum("n_exact")).scalar()
    return per_label.select("label", "n_exact", "n_wrong", (recall >= F.lit(0.6)).alias("recall_reached"))


# --------------------------------------------------------- vendor behaviour

@query
def velocity(spark, d):
    return vendor.velocity(src.events_as_invoices(table(spark, d, "events")))


@query
def velocity_uneven_hop(spark, d):
    return vendor.velocity(src.events_as_invoices(table(spark, d, "events")), 45, 30)


def _anomalies(spark, d, history):
    return rounded(
        vendor.anomalies(src.load_invoices(spark, d), history=history),
        6, "vendor_stddev", "amount_z_score",
    ).select("invoice_id", "vendor_avg", "vendor_stddev", "vendor_max", "vendor_total_invoices",
             "amount_z_score", "is_amount_anomaly", "is_new_vendor", "exceeds_historical_max")


@query
def anomalies(spark, d):
    return _anomalies(spark, d, "final")


@query
def anomalies_prior(spark, d):
    return _anomalies(spark, d, "prior")


@query
def bank_changes(spark, d):
    return vendor.bank_changes(src.load_invoices(spark, d))


@query
def bank_changes_latest(spark, d):
    return vendor.bank_changes(src.load_invoices(spark, d), rule="latest")


@query
def bank_changes_previous(spark, d):
    return vendor.bank_changes(src.load_invoices(spark, d), rule="previous")


@query
def deviation(spark, d):
    return vendor.deviation(src.load_invoices(spark, d))


@query
def enrich_vendor(spark, d):
    return rounded(enriched(spark, d), 6, "vendor_stddev_amount").drop("amount_cents")


@query
def arrival_history(spark, d):
    return rounded(
        vendor.running_history(src.load_invoices(spark, d)), 6, "vendor_stddev_amount"
    ).select("invoice_id", "vendor_id", "vendor_total_invoices", "vendor_total_amount",
             "vendor_avg_amount", "vendor_max_amount", "vendor_min_amount",
             "vendor_stddev_amount", "vendor_last_bank_account")


@query
def arrival_history_by_rows(spark, d):
    """The same from chunks of 1,000 rows, however the invoices lie in time."""
    return rounded(
        vendor.running_history(src.load_invoices(spark, d), chunk_rows=1000), 6, "vendor_stddev_amount"
    ).select("invoice_id", "vendor_id", "vendor_total_invoices", "vendor_total_amount",
             "vendor_avg_amount", "vendor_max_amount", "vendor_min_amount",
             "vendor_stddev_amount", "vendor_last_bank_account")


# ------------------------------------------------------------- risk scoring

@query
def amount_risk(spark, d):
    return rounded(risk.amount_risk(enriched(spark, d)), 6, "amount_risk_score")


@query
def vendor_risk(spark, d):
    return rounded(risk.vendor_risk(enriched(spark, d)), 6, "vendor_risk_score")


@query
def temporal_risk(spark, d):
    return risk.temporal_risk(src.load_invoices(spark, d))


@query
def temporal_risk_calendar(spark, d):
    return risk.temporal_risk(src.load_invoices(spark, d), use_calendar=True)


@query
def pattern_risk(spark, d):
    marked = duplicates.exact_duplicates(src.load_invoices(spark, d))
    return rounded(risk.pattern_risk(marked), 6, "pattern_risk_score")


@query
def pattern_risk_plain(spark, d):
    return risk.pattern_risk(src.load_invoices(spark, d))


@query
def composite_risk(spark, d):
    inv = src.load_invoices(spark, d)
    marked = duplicates.exact_duplicates(inv)
    return rounded(
        risk.composite_risk(vendor.enrich_vendor(marked, vendor.vendor_stats(inv))),
        6, "amount_risk", "vendor_risk", "pattern_risk", "risk_score").drop("risk_factors")


@query
def composite_factors(spark, d):
    return risk.composite_risk(enriched(spark, d)).select("invoice_id", "risk_factors")


@query
def realtime_risk(spark, d):
    return risk.realtime_risk(enriched(spark, d))


@query
def realtime_risk_semantic(spark, d):
    inv = src.load_invoices(spark, d)
    marked = similarity.enrich_semantic(inv, 0.9)
    return risk.realtime_risk(vendor.enrich_vendor(marked, vendor.vendor_stats(inv)))


@query
def registry_risk(spark, d):
    return registry_scored(spark, d).select(
        "invoice_id", "risk_score", "risk_level", "decision", "is_alert")


# ------------------------------------- decisions, alerts and explanations

@query
def decisions(spark, d):
    return rounded(dec.decisions(scored(spark, d)), 6, "decision_confidence").select(
        "invoice_id", "risk_points", "risk_score", "risk_level", "decision",
        "decision_confidence", "requires_action", "auto_approved", "auto_rejected",
        "decision_reason")


@query
def risk_alerts(spark, d):
    return dec.risk_alerts(scored(spark, d))


@query
def explain_rule(spark, d):
    return rounded(explain.explain_rule(weighted(spark, d)), 6, "risk_score")


@query
def explain_prompt(spark, d):
    return explain.explain_prompt(scored(spark, d))


def digest_writer():
    """A stand-in for a text model: answers with the digest of the prompt."""

    def answer(prompts: list[str]) -> list[str]:
        return ["digest " + hashlib.md5(p.encode()).hexdigest() for p in prompts]

    return answer


@query
def explain_model(spark, d):
    return explain.explain_model(
        relational.filter_high_risk(scored(spark, d)), digest_writer)


def failing_writer():
    """``digest_writer`` that fails for prompts whose digest begins with a 0."""
    answer = digest_writer()

    def failing(prompts: list[str]) -> list[str]:
        texts = answer(prompts)
        if any(t.startswith("digest 0") for t in texts):
            raise ValueError("a prompt the model does not take")
        return texts

    return failing


@query
def explain_model_failing(spark, d):
    """Every sixteenth prompt has no answer and gets the rule's text."""
    return explain.explain_model(scored(spark, d), failing_writer)


@query
def explain_audit(spark, d):
    return explain.explain_audit(scored(spark, d)).select("invoice_id", "risk_explanation")


@query
def format_alert_text(spark, d):
    alerts = relational.filter_high_risk(scored(spark, d))
    return explain.format_alert_text(explain.explain_rule(alerts))


@query
def monitoring_tables(spark, d):
    views = scoring.monitoring_tables(scoring.build(src.load_invoices(spark, d)))
    key = {"alert_summary": "risk_level", "vendor_risk_summary": "vendor_id", "vendor_stats": "vendor_id",
           "all_risk_scores": "invoice_id", "high_risk_alerts": "invoice_id"}
    value = {"alert_summary": "avg_score", "vendor_risk_summary": "avg_risk_score", "vendor_stats": "avg_amount",
             "all_risk_scores": "risk_score", "high_risk_alerts": "risk_score"}
    rows = [v.select(F.lit(name).alias("view"), F.col(key[name]).alias("key"), F.col(value[name]).alias("value"))
            for name, v in views.items()]
    return rounded(reduce(DataFrame.unionByName, rows), 6, "value")


@query
def scored_invoices(spark, d):
    """The whole chain with semantic duplicates and the points score."""
    out = scoring.build(
        src.load_invoices(spark, d), scoring.ScoringConfig(semantic=True))
    return out["all_invoices_explained"].select(
        "invoice_id", "risk_points", "risk_score", "risk_level", "is_duplicate",
        "risk_explanation")


@query
def scored_invoices_weighted(spark, d):
    """The whole chain with exact duplicates and the weighted score."""
    out = scoring.build(src.load_invoices(spark, d), scoring.ScoringConfig(points=False))
    return rounded(out["autonomous_decisions"], 6, "risk_score").select(
        "invoice_id", "risk_score", "risk_level", "decision", "is_duplicate")


# ------------------------------------------------------------------ reports

@query
def risk_trend_7d(spark, d):
    return as_text(reports.risk_trend_7d(scored(spark, d), TREND_END), "day")


@query
def transactions_view(spark, d):
    return reports.transactions_view(registry_scored(spark, d), n=None)


# ---------------------------------------------------------------- streaming

def _stream(spark, d, name):
    return spark.readStream.schema(src.TABLES[name]) \
        .option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _stream_invoices(spark, d):
    return src.orders_as_invoices(_stream(spark, d, "orders"), table(spark, d, "customer"))


@query
def stream_velocity(spark, d):
    stream = stream_vendor.stream_velocity(
        src.events_as_invoices(_stream(spark, d, "events")), watermark=None)
    out = scratch_path(spark, "velocity")
    with settings_of(spark, DISK_STATE):
        tables.run_to_versions(stream, f"{out}/rows", f"{out}/checkpoint")
    return tables.current_rows(
        spark, f"{out}/rows", ["vendor_id", "window_start"], stream.schema)


@query
def stream_panes_velocity(spark, d):
    """The same windows from panes kept by the state store, put together when read."""
    stream = stream_panes(src.events_as_invoices(_stream(spark, d, "events")), watermark=None)
    out = scratch_path(spark, "panes")
    tables.run_to_versions(stream, f"{out}/rows", f"{out}/checkpoint")
    panes = tables.current_rows(spark, f"{out}/rows", ["vendor_id", "pane"], stream.schema)
    return vendor.windows_of_panes(panes)


@query
def stream_windows(spark, d):
    """Windows that the watermark (a day behind the newest event) has passed, each emitted once."""
    stream = windows_on_stream(src.events_as_invoices(_stream(spark, d, "events")))
    out = scratch_path(spark, "windows")
    tables.run_to_versions(stream, f"{out}/rows", f"{out}/checkpoint", mode="append")
    return tables.read_versions(spark, f"{out}/rows", stream.schema).drop(tables.VERSION)


def _pane_log(spark, d):
    """Events in four batches by id, so that most of the later ones are behind the watermark."""
    out = scratch_path(spark, "late")
    events = src.events_as_invoices(table(spark, d, "events"))
    for q in range(4):
        events.where(F.expr(f"CAST(invoice_id AS BIGINT) % 4 = {q}")).write.mode("append").parquet(f"{out}/feed/{q}")
    log = PaneLog(spark, f"{out}/log", most_folders=2)
    for q in range(4):  # a stream a batch: the order of files does not decide which row is late
        log(spark.read.schema(events.schema).parquet(f"{out}/feed/{q}"), q)
    return log


@query
def stream_late_rows(spark, d):
    """Rows behind the watermark, with the batch they came in."""
    return _pane_log(spark, d).rows_behind().select("invoice_id", "vendor_id", "amount", "ts", "_batch")


@query
def stream_late_reconciled(spark, d):
    """The windows after late rows were added: those of all events."""
    log = _pane_log(spark, d)
    log.reconcile()
    return log.velocity()


@query
def stream_vendor_stats(spark, d):
    stream = stream_vendor.stream_vendor_stats(_stream_invoices(spark, d))
    out = scratch_path(spark, "stats")
    tables.run_to_versions(stream, f"{out}/rows", f"{out}/checkpoint")
    return rounded(
        tables.current_rows(spark, f"{out}/rows", ["vendor_id"], stream.schema),
        6, "stddev_amount")


@query
def live_enrichment(spark, d):
    stream = _stream_invoices(spark, d)
    out = scratch_path(spark, "live")
    live.run_live_enrichment(
        stream, f"{out}/log", f"{out}/rows", f"{out}/checkpoint", vendor.enrich_vendor)
    rows = tables.current_rows(
        spark, f"{out}/rows", ["invoice_id"], vendor.enrich_vendor(
            src.load_invoices(spark, d)).schema)
    return rounded(rows, 6, "vendor_stddev_amount").drop("amount_cents")


@query
def stream_outputs(spark, d):
    """All six outputs kept up to date on a stream of several batches, read back."""
    return digests(spark, _streamed(spark, d), latest=True)


@query
def stream_snapshots(spark, d):
    """The same outputs behind a manifest, folded after every second batch."""
    log = SnapshotLog(spark, scratch_path(spark, "snapshots"),
                      {n: f.split()[0] for n, f in OUTPUT_FIELDS.items()}, most_folders=2)
    _streamed(spark, d, snapshots=log)
    state = log.live()
    return digests_of({name: log.read(name, state, jsonl.T.StructType.fromDDL(OUTPUT_FIELDS[name]).names)
                       for name in sinks.OUTPUT_NAMES})


def _streamed(spark, d, invoices=None, snapshots=None):
    """The invoices in four batches by time: later ones withdraw alerts of earlier ones."""
    out = scratch_path(spark, "stream")
    invoices = src.load_invoices(spark, d) if invoices is None else invoices
    for q in range(4):  # a batch is what is new since the run before, written by as many tasks as it takes
        invoices.where(F.expr(f"CASE WHEN ts < '1996-01-01' THEN 0 WHEN ts < '1998-01-01' THEN 1 "
                              f"WHEN ts < '2000-01-01' THEN 2 ELSE 3 END = {q}")) \
            .write.mode("append").parquet(f"{out}/feed")
        feed = spark.readStream.schema(invoices.schema).parquet(f"{out}/feed")
        outputs.run_stream(feed, f"{out}/out", f"{out}/state", snapshots=snapshots)
    return {name: f"{out}/out/{name}.jsonl" for name in sinks.OUTPUT_NAMES}


def _latest(spark, d, name, fields):
    return jsonl.read_jsonl_latest(spark, _streamed(spark, d)[name], jsonl.T.StructType.fromDDL(fields))


@query
def stream_alerts(spark, d):
    return _latest(spark, d, "high_risk_alerts", "invoice_id string, risk_score double, risk_level string")


@query
def stream_explanations(spark, d):
    return _latest(spark, d, "explanations", "invoice_id string, explanation string")


@query
def stream_arrival(spark, d):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB_STATE)
    try:
        out = scratch_path(spark, "arrival")
        tables.run_to_end(
            stream_vendor.stream_arrival_history(_stream_invoices(spark, d))
            .writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows"),
            f"{out}/checkpoint")
    finally:
        spark.conf.set(key, before)
    return rounded(
        spark.read.schema(stream_vendor.ARRIVAL_SCHEMA).parquet(f"{out}/rows"),
        6, "vendor_stddev_amount").drop("amount", "ts", "bank_account")


@query
def stream_duplicates(spark, d):
    out = scratch_path(spark, "pairs")
    stream = pairs.stream_duplicates(
        _stream_invoices(spark, d), time_window_hours=24 * 7, watermark="10000 days")
    with settings_of(spark, DISK_STATE):
        tables.run_to_end(
            stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows"),
            f"{out}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


# -------------------------------------------------- odd amounts and vendors

@query
def vendor_stats_fine_amounts(spark, d):
    """Statistics of amounts with five decimals."""
    fine = src.load_invoices(spark, d).withColumn("amount", F.expr("amount_cents / 100000D")).drop("amount_cents")
    return rounded(vendor.vendor_stats(fine), 6, "stddev_amount")


def _without_some_vendors(spark, d):
    return src.load_invoices(spark, d).withColumn("vendor_id", F.expr(
        "IF(CAST(substring(vendor_id, 5) AS BIGINT) % 7 = 0, NULL, vendor_id)"))


@query
def decisions_null_vendor(spark, d):
    """Invoices of every seventh vendor lack the vendor and still get a decision."""
    return dec.decisions(scoring.score(_without_some_vendors(spark, d))).select(
        "invoice_id", "vendor_id", "risk_points", "decision")


@query
def stream_null_vendor(spark, d):
    """The same on a stream of four batches."""
    path = _streamed(spark, d, _without_some_vendors(spark, d))["autonomous_decisions"]
    return jsonl.read_jsonl_latest(spark, path, jsonl.T.StructType.fromDDL(
        "invoice_id string, vendor_id string, risk_points int, decision string"))


@query
def decisions_huge_amount(spark, d):
    """One invoice in 97 has an amount of 4e14, beyond what has cents in a double."""
    rows = src.load_invoices(spark, d).withColumn("amount", F.expr("IF(amount_cents % 97 = 0, 4e14D, amount)"))
    return dec.decisions(scoring.score(rows)).select(
        "invoice_id", "risk_points", "decision", F.floor(F.col("vendor_total_amount") / 1000).alias("total_thousands"))
