"""Invoice feeds: files of the declared schema, as a table or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlynx.operators.relational import parse_timestamps
from ledgerlynx.schemas import INVOICE_FEED, TABLES


def read_invoices(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType = INVOICE_FEED,
) -> DataFrame:
    """A finite invoice table. The schema is declared, so no file is read to guess it.

    The timestamp text is kept and parsed once into ``ts``.
    """
    return parse_timestamps(spark.read.schema(schema).format(fmt).load(path))


def stream_invoices(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType = INVOICE_FEED,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: str | None = None,
    glob: str | None = None,
) -> DataFrame:
    """The same feed as an unbounded stream of files.

    With ``trigger(availableNow=True)`` it reads what is there and ends.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return parse_timestamps(reader.load(path))


def events_as_invoices(events: DataFrame) -> DataFrame:
    """High-rate event rows in the shape the velocity operator needs."""
    return events.select(
        F.col("event_id").cast("string").alias("invoice_id"),
        F.col("user_id").cast("string").alias("vendor_id"),
        F.col("value").alias("amount"),
        F.col("ts").cast("timestamp").alias("ts"))


# An order table turned into invoices: each order gives one, every 23rd key also an
# exact copy, every 29th a copy 0.25 % dearer, every 101st an outlier.
_ORDER_FACTS = [
    "o_orderkey AS k", "o_custkey AS v",
    "CAST(floor(o_totalprice * 100 + 0.5D) AS BIGINT) % 10000000 AS c0",
    "CAST(o_orderdate AS TIMESTAMP) AS day", "o_orderpriority", "c_mktsegment",
]
_BASE_CENTS = """CASE WHEN k % 17 = 0 THEN c0 - c0 % 100000
                      WHEN k % 19 = 0 THEN c0 - c0 % 10000 ELSE c0 END AS base"""
_VARIANT = "explode(array(0, 1, 2, 3)) AS variant"
_VARIANT_EXISTS = """variant = 0 OR (variant = 1 AND k % 23 = 0) OR (variant = 2 AND k % 29 = 0)
                     OR (variant = 3 AND k % 101 = 0)"""
_VARIANT_FIELDS = [
    "*",
    """concat('INV-', k, CASE variant WHEN 1 THEN '-D' WHEN 2 THEN '-F' WHEN 3 THEN '-Z'
                          ELSE '' END) AS invoice_id""",
    """CASE variant WHEN 2 THEN base + CAST(floor(base / 400D) AS BIGINT)
                    WHEN 3 THEN 100000000 + c0 ELSE base END AS cents""",
]
_INVOICE_FIELDS = [
    "invoice_id",
    "concat('VND-', v) AS vendor_id",
    "cents AS amount_cents",
    "cents / 100D AS amount",
    "CAST(floor(cents * (300 + (k * 7919) % 900) / 10000D) AS BIGINT) / 100D AS tax",
    """CASE WHEN k % 31 = 0 THEN concat('ACC-9', v)
            WHEN v % 37 = 0 AND day >= TIMESTAMP '1998-01-01 00:00:00' THEN concat('ACC-5', v)
            ELSE concat('ACC-1', v) END AS bank_account""",
    "day + make_dt_interval(0, 0, CAST(k % 1440 AS INT)) AS ts",
    "o_orderpriority AS description",
    "c_mktsegment AS category",
    """CASE k % 4 WHEN 0 THEN 'Wire Transfer' WHEN 1 THEN 'Check'
                  WHEN 2 THEN 'Credit Card' ELSE 'ACH' END AS payment_method""",
]


def orders_as_invoices(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Invoices derived from an order table, with copies, near copies and outliers.

    One scan and one join: the variants are made from the joined row. Nothing
    downstream relies on the join's partitioning, so adaptive execution is free
    to split the rows of a crowded customer.
    """
    return (
        orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
        .selectExpr(*_ORDER_FACTS)
        .selectExpr("*", _BASE_CENTS)
        .selectExpr("*", _VARIANT)
        .where(_VARIANT_EXISTS)
        .selectExpr(*_VARIANT_FIELDS)
        .selectExpr(*_INVOICE_FIELDS)
    )


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder; the known ones need no look at the file footers."""
    reader = spark.read
    if name in TABLES:
        reader = reader.schema(TABLES[name])
    return reader.parquet(f"{folder}/{name}.parquet")


def load_invoices(spark: SparkSession, folder: str) -> DataFrame:
    """Invoices derived from the tables of a data folder."""
    return orders_as_invoices(
        read_table(spark, folder, "orders"), read_table(spark, folder, "customer"))


def load_registry(spark: SparkSession, folder: str) -> DataFrame:
    """The account each vendor has registered."""
    return read_table(spark, folder, "customer").selectExpr(
        "concat('VND-', c_custkey) AS vendor_id",
        "concat('ACC-1', c_custkey) AS registered_account")
