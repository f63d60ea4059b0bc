"""Mixing sources to target weights by a low-discrepancy schedule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlynx.llm.common import WORD, doc_field, numbered, prefix_sum, written

#: Words of one block, points of the schedule's unit interval, and the odd step
#: near POINTS / golden ratio whose multiples fall evenly into it.
BLOCK_WORDS, POINTS, STEP = 256, 1 << 31, 1327217885
#: Rows that share a finest bucket on average, and buckets of a coarser one.
BUCKET_ROWS, FANOUT = 64, 1024
WEIGHTS, SHARE, MOST_TIMES = (3, 1, 2), 1.5, 2.0


@dataclass
class Mix:
    """``taken``: row, size, source_size, target, taken, first_slot of every document.
    ``schedule``: slot, source_key, block, row, start, words, the pieces in mixing order."""

    rows: DataFrame
    taken: DataFrame
    schedule: DataFrame


def shuffle_key(doc_id: Column) -> Column:
    """40 bits of a hash of the id, the place of a document in its source's shuffled order."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":mix")).cast("binary"))
    return F.conv(F.substring(digest, 1, 10), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   most_times: float = MOST_TIMES) -> DataFrame:
    """Target words of each ``source`` of ``sizes(source, source_size)``.

    Sources in the order of their code points, null last, have the weights in
    turn and share ``share`` of all words; a target stops at ``most_times`` its
    source's size and the excess is shared again by weight among the others
    until none is above. The rounds are sums over one row per source.
    """
    # one row per source, however many documents it has
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    state = written(sizes.select("source", "source_size", weight.alias("weight"),
                                 (F.col("source_size") * most_times).alias("most"),
                                 F.lit(False).alias("full")), "mix-sources")
    total = state.agg(F.sum("source_size")).first()[0] or 0
    while True:
        free = state.agg(F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)),
                         F.sum(F.when(~F.col("full"), F.col("weight")))).first()
        unit = (share * total - (free[0] or 0.0)) / free[1] if free[1] else 0.0
        above = ~F.col("full") & (F.col("weight") * unit > F.col("most"))
        if state.where(above).isEmpty():
            target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * unit)
            return state.select("source", "source_size", target.alias("target"))
        state = written(state.withColumn("full", F.col("full") | above), "mix-sources")


def golden_schedule(quota: DataFrame, slots: int) -> DataFrame:
    """``slot, source_key, block``: which block of which source comes when.

    ``quota(source_key, low, high, blocks)``: each source owns the points from
    ``low`` to ``high``. Slot i takes the source that owns the i-th multiple of the
    golden-ratio step; its rank among the slots of the source is the block.
    Sources are found by a grid over the points, an equality join: a cell holds
    few sources, and a source its share of cells. Slots beyond a source's blocks
    are left out, and blocks beyond its slots (few: the discrepancy grows with
    the logarithm of the slots) follow at the end.
    """
    spark = quota.sparkSession
    n_sources = quota.count()
    grid = 1 << max(12, min(30, n_sources.bit_length() + 2))
    cell_size = POINTS // grid
    cells = quota.where("high > low").withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") / cell_size), F.floor((F.col("high") - 1) / cell_size))))
    point = F.pmod(F.pmod(F.col("id"), F.lit(POINTS)) * F.lit(STEP), F.lit(POINTS))
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point")) \
        .withColumn("cell", F.floor(F.col("point") / cell_size))
    owned = points.join(cells, "cell").where("point >= low AND point < high") \
        .select("slot", "source_key", "blocks", F.lit(1).cast("long").alias("one"),
                F.floor(F.col("slot") / BUCKET_ROWS).alias("fine"),
                F.floor(F.col("slot") / (BUCKET_ROWS * FANOUT)).alias("coarse"))
    ranked = written(prefix_sum(owned, ["source_key"], ["coarse", "fine"], ["slot"], "one", "block")
                     .select("slot", "source_key", "block", "blocks"), "mix-slots")
    got = ranked.groupBy("source_key").agg(F.count(F.lit(1)).alias("got"))
    missing = quota.join(got, "source_key", "left") \
        .withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).where("got < blocks") \
        .select("source_key", F.explode(F.sequence("got", F.col("blocks") - 1)).alias("block"))
    last = missing.select((F.col("block") * n_sources + F.col("source_key") + slots).alias("slot"),
                          "source_key", "block")
    return ranked.where("block < blocks").select("slot", "source_key", "block").unionByName(last)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", columns: list[str] | None = None,
                block_words: int = BLOCK_WORDS, size: Column | None = None,
                weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                most_times: float = MOST_TIMES) -> Mix:
    """A mix in which each source has its target of words.

    The documents of a source, shuffled by a hash of their id, stand one behind
    the other and again from the start; the stream is cut into blocks of
    ``block_words`` words, the last one where the source's rounded target ends.
    The schedule places the blocks. Null and empty texts have size 0 and are
    never taken; a null source is a source of its own, the last; rows with
    repeated ids are documents of their own; an empty table gives an empty mix.
    """
    size = F.regexp_count(docs[f"`{text_col}`"], F.lit(WORD)) if size is None else size
    docs = docs.withColumn("__size", F.coalesce(size, F.lit(0)).cast("long"))
    rows = numbered(docs, "mix-docs", [*(columns or [c for c in docs.columns if c != "__size"]), "__size"])
    words = rows.select("row", doc_field(source_col).alias("source"), doc_field("__size").alias("size"),
                        shuffle_key(doc_field(id_col)).alias("hash"),
                        doc_field(id_col).alias("id"))
    sizes = words.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = written(source_targets(sizes, weights, share, most_times)
                      .withColumn("source_key", F.monotonically_increasing_id())
                      .withColumn("words", F.round("target").cast("long")), "mix-targets")
    # source_key is made dense: the table is one row per source
    sources = written(sources.withColumn("source_key", F.row_number().over(
        Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))).cast("long") - 1), "mix-targets")
    n_rows, total = rows.count(), sources.agg(F.sum("words")).first()[0] or 0
    n_fine = max(1, n_rows // BUCKET_ROWS)
    # rows of a source in the order of their hash: buckets of it, then the hash itself
    placed = F.floor(F.col("hash") / (float(1 << 40) / n_fine)).cast("long")
    keyed = words.join(sources, words["source"].eqNullSafe(sources["source"])) \
        .select("row", "size", "id", "hash", "source_key", "source_size", "target", "words", placed.alias("fine")) \
        .withColumn("coarse", F.floor(F.col("fine") / FANOUT))
    order = ["hash", "id", "size", "row"]
    stream = written(prefix_sum(keyed, ["source_key"], ["coarse", "fine"], order, "size", "start")
                     .select("row", "size", "source_key", "source_size", "target", "words", "start"), "mix-stream")

    # every time a document comes in the stream before the target, cut at the blocks it touches
    again = F.explode(F.sequence(F.lit(0), F.lit(int(-(-most_times // 1)) - 1))).alias("time")
    pieces = stream.where("size > 0").select("row", "source_key", "size", "source_size", "words", "start", again) \
        .withColumn("from", F.col("start") + F.col("time") * F.col("source_size")) \
        .withColumn("to", F.least(F.col("from") + F.col("size"), F.col("words"))).where("from < to") \
        .withColumn("block", F.explode(F.sequence(
            F.floor(F.col("from") / block_words), F.floor((F.col("to") - 1) / block_words)))) \
        .withColumn("piece_from", F.greatest("from", F.col("block") * block_words)) \
        .withColumn("piece_to", F.least("to", (F.col("block") + 1) * block_words)) \
        .select("row", "source_key", "block", (F.col("piece_from") - F.col("from")).alias("start"),
                (F.col("piece_to") - F.col("piece_from")).alias("words"), "time")
    whole = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.floor(F.sum("words").over(whole) * (float(POINTS) / max(1, total))).cast("long")
    quota = sources.select("source_key", F.ceil(F.col("words") / block_words).alias("blocks"), upto.alias("high"))
    quota = written(quota.withColumn("low", F.coalesce(
        F.lag("high").over(Window.orderBy("source_key")), F.lit(0).cast("long"))), "mix-quota")
    slots = quota.agg(F.sum("blocks")).first()[0] or 0
    slotted = golden_schedule(quota, slots)
    schedule = written(pieces.join(slotted, ["source_key", "block"]), "mix-schedule")
    took = schedule.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    taken = stream.join(took, "row", "left").select(
        "row", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_slot")
    return Mix(rows, taken, schedule)
