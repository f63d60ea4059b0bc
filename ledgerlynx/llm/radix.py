"""Exact duplicates by distributed radix partitioning, most significant byte first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlynx.llm.common import doc_field, lower_ascii, written

#: Bytes that the first round looks at, the growth from round to round, and the most of one round.
FIRST_BYTES, GROWTH, MOST_BYTES = 64, 16, 1 << 20


def radix_groups(rows: DataFrame, first: int = FIRST_BYTES, growth: int = GROWTH,
                 most: int = MOST_BYTES) -> DataFrame:
    """``carry`` and ``grp`` for each row of ``rows(carry, key)``, ``key`` being bytes.

    Rows have the same ``grp`` exactly when their keys are equal; ``grp`` is null
    for a key that occurs once. The byte string that is split is the key behind
    its length. Each round splits every open group by its next bytes: groups of
    one row are done, groups whose keys have ended are done, the others go on
    with the rest of their bytes. Bytes are compared as they are, no digest
    decides. A round only counts groups (with partial sums in each task) and
    joins the numbers of the groups back, so a group that holds a third of all
    rows is never in one task; adaptive execution splits that join.
    """
    open_, done, width = rows.select("carry", F.lit(0).cast("long").alias("grp"),
                                     F.coalesce("key", F.lit(b"")).alias("rest")), [], first
    while True:
        rest = F.col("rest")
        at = open_.select("carry", "grp", "rest", rest.substr(1, width).alias("digit"),
                          F.octet_length(rest).cast("long").alias("len"))
        split = ["grp", "len", "digit"]
        groups = written(
            at.groupBy(*split).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            .select(*split, F.monotonically_increasing_id().alias("next")), "radix-groups")
        # always the same kind of join, so that cost follows the input evenly
        placed = at.join(groups.hint("merge"), split, "left")
        more = F.col("next").isNotNull() & (F.col("len") > width)
        after = written(placed.select(
            "carry", F.col("next").alias("grp"), more.alias("open"),
            F.when(more, rest.substr(F.lit(width + 1), F.lit(2**31 - 1))).alias("rest")), "radix-rows")
        # numbers of different rounds must differ
        done.append(after.where("NOT open").select("carry", F.when(
            F.col("grp").isNotNull(), F.struct(F.lit(len(done)).alias("round"), F.col("grp").alias("number"))
        ).alias("grp")))
        open_ = after.where("open").select("carry", "grp", "rest")
        if open_.isEmpty():
            break
        width = min(width * growth, most)
    return reduce(DataFrame.unionByName, done)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: ``doc`` (the whole row), ``keep_id``, ``group_size``, ``kept``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the row with the largest id stays (a null id is below all
    others); of repeated rows with that id any one stays. ``carry`` replaces the
    columns of ``doc``. An empty table gives no rows.
    """
    rows = docs.select(
        (F.struct(*[docs[f"`{c}`"] for c in docs.columns]) if carry is None
         else F.struct(docs[f"`{id_col}`"], *[c.alias(n) for n, c in carry.items()])).alias("carry"),
        lower_ascii(docs[f"`{text_col}`"]).cast("binary").alias("key"))
    grouped = radix_groups(rows).withColumnRenamed("carry", "doc")
    own = doc_field(id_col)
    single = grouped.where("grp IS NULL").select(
        "doc", own.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    copies = grouped.where("grp IS NOT NULL").withColumn("__id", own)
    best = written(copies.groupBy("grp").agg(
        F.max("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "radix-best")
    nth = F.row_number().over(Window.partitionBy("grp", "__id").orderBy(F.lit(0)))
    return single.unionByName(
        copies.withColumn("__nth", nth).join(best, "grp").select(
            "doc", "keep_id", "group_size",
            (F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__nth") == 1)).alias("kept")))


def text_sha256(text: Column) -> Column:
    return F.sha2(lower_ascii(text).cast("binary"), 256)
