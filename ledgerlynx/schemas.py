"""Declared schemas of the tables that cross a storage boundary."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw feed: the timestamp is ISO-8601 text, as producers write it.
INVOICE_FEED = T.StructType([
    T.StructField("invoice_id", T.StringType()),
    T.StructField("vendor_id", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("tax", T.DoubleType()),
    T.StructField("bank_account", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("payment_method", T.StringType()),
])

# Decision log: the feed plus the registry score. Several versions of one
# invoice may occur; readers keep the last.
DECISION_LOG = T.StructType(INVOICE_FEED.fields + [
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("decision", T.StringType()),
])

INVOICE_COLUMNS = [
    "invoice_id", "vendor_id", "amount", "tax", "bank_account", "ts",
    "description", "category", "payment_method",
]

VENDOR_STATS_COLUMNS = [
    "vendor_id", "total_invoices", "total_amount", "avg_amount", "max_amount",
    "min_amount", "last_invoice_time", "last_bank_account", "stddev_amount",
]

# Tables of a data folder that queries are derived from.
TABLES = {
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"),
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
        "c_mktsegment STRING"),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
        "props STRING"),
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}
