"""Helpers that several operators share: written tables, prefix sums, key columns."""

from __future__ import annotations

import ctypes
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlynx.session import drop_path, scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, read back: any executor can be lost
    afterwards, and later steps see one and the same result."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete ``written`` tables that no result reads any more."""
    for t in tables:
        drop_path(t.sparkSession, t.scratch)


def give_back_memory() -> None:
    """At the end of a task of large arrays: a reused Python worker returns the memory it no longer
    uses to the machine, so that later stages find it free."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % n


def as_rows(docs: DataFrame, **more: Column) -> DataFrame:
    """``doc`` holds the whole input row, so no column of it can clash with ours."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")) \
        .select("doc", *[c.alias(n) for n, c in more.items()])


def doc_field(name: str) -> Column:
    return F.col("doc").getField(name)


def numbered(docs: DataFrame, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A written copy of the input rows with a ``row`` number that stays the same
    for all later readers, even where ids are null or repeat."""
    rows = as_rows(docs.select(*[f"`{c}`" for c in columns]) if columns else docs)
    return written(rows.withColumn("row", F.monotonically_increasing_id()), name)


def prefix_sum(
    df: DataFrame, keys: Sequence[str], levels: Sequence[str], order: Sequence[str],
    value: str, out: str, inclusive: bool = False,
) -> DataFrame:
    """Running sum of ``value`` within ``keys`` in the order of ``levels``, then ``order``.

    ``levels`` are ever finer bucket numbers. Sums of buckets are summed along
    each level first, so no window holds more than the buckets of one coarser
    bucket, or the rows of a finest one, however many rows a key has.
    """
    keys, levels = list(keys), list(levels)
    start = None
    for depth in range(1, len(levels) + 1):
        upto, above = keys + levels[:depth], keys + levels[:depth - 1]
        sums = df.groupBy(*upto).agg(F.sum(value).alias("__sum"))
        ahead = Window.partitionBy(*above).orderBy(levels[depth - 1]) \
            .rowsBetween(Window.unboundedPreceding, -1)
        part = sums.select(*upto, F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__start"))
        if start is not None:
            part = part.join(start.withColumnRenamed("__start", "__above"), above) \
                .select(*upto, (F.col("__start") + F.col("__above")).alias("__start"))
        start = part
    group = keys + levels
    last = 0 if inclusive else -1
    inner = Window.partitionBy(*group).orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, last)
    rows = df.withColumn("__own", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(start, group).withColumn(out, F.col("__own") + F.col("__start")) \
        .drop("__own", "__start")
