"""Cosine similarity joins.

Pairs are compared inside a *block* (one vendor, one label). A block is cut
into parts of about ``part_rows`` rows, and each pair of parts is one unit of
work: two small matrices that are multiplied, of which only the entries at or
above the threshold leave the task. No unit grows with the size of its block,
no candidate pairs are materialised, and nothing is left out: every pair of
rows of a block meets in exactly one unit. Small blocks share tasks.

A block of more than one part is first split by the metric partition of
``metric.py``: its rows meet only where the triangle inequality admits a pair at
the threshold, which still loses none. How much that saves depends on the data: the work
on clustered vectors grows with the size of the clusters, that on vectors all
within the threshold's distance stays quadratic, as their pairs are. A time
window removes most of it where it applies; ``similar_approx`` trades recall for speed.
"""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlynx.config import DEFAULTS
from ledgerlynx.functions.skew import attach_by_key
from ledgerlynx.functions.vectors import norm
from ledgerlynx.operators import metric
from ledgerlynx.operators.embedding import (
    Embedder, compute_embeddings, embed_once, embed_text_labelled, embedder_named)
from ledgerlynx.session import scratch_path

PART_ROWS = 1024
SMALL_UNIT = 4096  # pairs
# A block of more than MOST_PARTS parts gets larger parts, of up to PART_ROWS rows: every part more is one
# more copy of all its rows. A task takes units of TASK_ROWS rows in all, however small they are.
MOST_PARTS = 8
TASK_ROWS = 8 * PART_ROWS
# Where only pairs are asked for, parts may grow to LARGE_ROWS rows; a product takes PRODUCT pairs at a time.
LARGE_ROWS, PRODUCT = 4 * PART_ROWS, 1 << 20
DECIMALS = metric.DECIMALS

_UNIT = ["__block", "__slot", "__kind", "__i", "__j"]
_IN_SLOT, _NEXT_SLOT = 0, 1


# ------------------------------------------------------------ units of work

def _cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All cosines of two sets of unit vectors. The sum of each pair is taken as for
    single pairs (``ij,ij->i``), so a score does not depend on the size of its unit."""
    return np.round(np.einsum("ik,jk->ij", left, right, optimize=False), DECIMALS)


def _unit_slices(pdf: pd.DataFrame):
    """Row numbers of the two sides of every unit in a task."""
    side = pdf["__side"].to_numpy()
    for rows in pdf.groupby(_UNIT, sort=False, dropna=False).indices.values():
        first = rows[0]
        left = rows[side[rows] == 0]
        if pdf["__kind"].iat[first] == _IN_SLOT and pdf["__i"].iat[first] == pdf["__j"].iat[first]:
            yield left, None
        else:
            yield left, rows[side[rows] == 1]


def _small_pairs(units, start, n_left, right, n_right, triangle):
    """Row numbers of all pairs of the given units, without a loop over them."""
    total = n_left[units] * n_right[units]
    u = np.repeat(units, total)
    place = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    i, j = np.divmod(place, n_right[u])
    once = ~triangle[u] | (i < j)
    return (start[u] + i)[once], (right[u] + j)[once]


def _scored_pairs(pdf: pd.DataFrame, unit: np.ndarray, threshold: float):
    """Pairs at the threshold in a task whose rows are sorted by unit and side.

    Small units are paired together in chunks, large ones multiplied one by one.
    """
    code, side = pdf["__unit"].to_numpy(), pdf["__side"].to_numpy()
    start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    size = np.diff(np.r_[start, len(code)])
    n_left = np.add.reduceat((side == 0).astype(np.int64), start)
    triangle = ((pdf["__kind"].to_numpy() == _IN_SLOT)
                & (pdf["__i"].to_numpy() == pdf["__j"].to_numpy()))[start]
    right = np.where(triangle, start, start + n_left)
    n_right = np.where(triangle, n_left, size - n_left)
    work = np.where(triangle & (n_left < 2), 0, n_left * n_right)

    small = np.flatnonzero((work > 0) & (work <= SMALL_UNIT))
    step = np.cumsum(work[small]) // max(SMALL_UNIT, 2_000_000 // unit.shape[1])
    for units in np.split(small, np.flatnonzero(np.diff(step)) + 1):
        a, b = _small_pairs(units, start, n_left, right, n_right, triangle)
        scores = np.round(np.einsum("ij,ij->i", unit[a], unit[b]), DECIMALS)
        keep = scores >= threshold
        yield a[keep], b[keep], scores[keep]
    for u in np.flatnonzero(work > SMALL_UNIT):
        a0, b0, b1 = start[u], right[u], right[u] + n_right[u]
        step = max(1, PRODUCT // int(n_right[u]))
        for p in range(a0, a0 + n_left[u], step):
            q = min(p + step, a0 + n_left[u])
            first = p if triangle[u] else b0  # a pair of rows of one part is taken once
            scores = _cosines(unit[p:q], unit[first:b1])
            keep = scores >= threshold
            if triangle[u]:
                keep = np.triu(keep, 1)
            a, b = np.nonzero(keep)
            yield p + a, first + b, scores[a, b]


def _part_count(n: Column, part_rows: int, most_rows: int = PART_ROWS) -> Column:
    """Into how many parts ``n`` rows are cut."""
    rows = F.least(F.greatest(F.lit(part_rows), F.ceil(n / F.lit(MOST_PARTS))), F.lit(max(part_rows, most_rows)))
    return F.ceil(n / rows).cast("int")


def _tasks(rows_of_units: Column, sizes: DataFrame, part_rows: int) -> Column:
    """How many tasks the units of all blocks (or regions) of ``sizes`` share."""
    return F.greatest(F.lit(1), F.ceil(
        sizes.select(F.sum(rows_of_units)).scalar() / F.lit(max(TASK_ROWS, 8 * part_rows)))).cast("bigint")


def _entry(slot_at: Column, kind: int, i: Column, j: Column, side: Column) -> Column:
    return F.struct(
        slot_at.alias("slot"), F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"),
        side.cast("int").alias("side"))


def _units(
    rows: DataFrame,
    id_col: str,
    vector_col: str,
    block: Column,
    payload: Sequence[str],
    part_rows: int,
    ts_col: str | None,
    window_seconds: int | None,
    partition: metric.Partition | None = None,
    most_rows: int = PART_ROWS,
) -> DataFrame:
    """Copy every row to the units it takes part in and name the task of each."""
    timed = window_seconds is not None
    base = rows.select(
        block.alias("__block"),
        F.col(id_col).alias("__id"),
        F.col(vector_col).alias("__vec"),
        (F.unix_micros(ts_col) if timed else F.lit(0).cast("bigint")).alias("__us"),
        *[F.col(c).alias(f"__p_{c}") for c in payload],
    )
    slot = (F.floor(F.col("__us") / F.lit(window_seconds * 1_000_000)) if timed
            else F.lit(0)).cast("bigint")
    base = base.withColumn("__slot", slot)

    sizes = base.groupBy("__block", "__slot").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("__block").agg(F.sum("n").alias("__n"), F.max("n").alias("__most")) \
        .withColumn("__parts", _part_count(F.col("__most"), part_rows, most_rows))
    bins = _tasks(F.col("__n") * F.col("__parts") * (3 if timed else 1), sizes, part_rows)

    # rows without a block (an invoice without a vendor) form one block
    sized = attach_by_key(base, sizes, ["__block"], "__n", "__id", null_safe=True)
    if partition is not None:
        return _metric_units(sized, part_rows, partition, most_rows)
    part = F.pmod(F.xxhash64("__id"), F.col("__parts")).cast("int")
    other = F.sequence(F.lit(0), F.col("__parts") - 1)

    places = F.transform(other, lambda j: _entry(
        F.col("__slot"), _IN_SLOT, F.least(part, j), F.greatest(part, j), part > j))
    if timed:
        places = F.concat(
            places,
            F.transform(other, lambda j: _entry(
                F.col("__slot"), _NEXT_SLOT, part, j, F.lit(0))),
            F.transform(other, lambda j: _entry(
                F.col("__slot") - 1, _NEXT_SLOT, j, part, F.lit(1))),
        )
    placed = sized.withColumn("__at", F.explode(places)).select(
        "__block", F.col("__at.slot").alias("__slot"), F.col("__at.kind").alias("__kind"),
        F.col("__at.i").alias("__i"), F.col("__at.j").alias("__j"),
        F.col("__at.side").alias("__side"), "__parts",
        "__id", "__vec", "__us", *[f"__p_{c}" for c in payload])
    return placed.withColumn("__task", F.pmod(F.xxhash64(*_UNIT), bins)).drop("__parts")


def _in_regions(sized: DataFrame, part_rows: int, partition: metric.Partition,
                most_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """Rows at their own region and at those they visit, and the sizes of regions that have rows of
    their own. A block of one part is one region."""
    regions = F.when(F.col("__parts") == 1, F.array(F.lit(0))) \
        .otherwise(partition.regions_column(F.col("__vec")))
    at = sized.select(*sized.drop("__parts", "__n", "__most", "__slot").columns,
                      F.posexplode(regions).alias("__visit", "__slot"))
    sizes = at.groupBy("__block", "__slot").agg(
        F.count_if(F.col("__visit") == 0).alias("__own"), F.count_if(F.col("__visit") > 0).alias("__guests"),
        F.count(F.lit(1)).alias("__all")).where("__own > 0")
    return at, sizes.withColumns({n: _part_count(F.col(c), part_rows, most_rows)
                                  for n, c in (("__parts", "__own"), ("__guest_parts", "__guests"))})


def _metric_units(sized: DataFrame, part_rows: int, partition: metric.Partition, most_rows: int) -> DataFrame:
    """Units of a metric partition: parts of a region's own rows with each other, and with parts of
    the rows that visit it. Visitors are not compared with each other."""
    at, sizes = _in_regions(sized, part_rows, partition, most_rows)
    bins = _tasks(F.col("__own") * (F.col("__parts") + F.col("__guest_parts")) + F.col("__guests") * F.col("__parts"),
                  sizes, part_rows)
    placed = attach_by_key(at, sizes, ["__block", "__slot"], "__all", "__id", null_safe=True)
    slot, guest_parts = F.col("__slot").cast("bigint"), F.col("__guest_parts")
    own = F.pmod(F.xxhash64("__id"), F.col("__parts")).cast("int")
    guest = F.pmod(F.xxhash64("__id"), F.greatest(guest_parts, F.lit(1))).cast("int")
    owns = F.sequence(F.lit(0), F.col("__parts") - 1)
    guests = F.when(guest_parts > 0, F.sequence(F.lit(0), F.greatest(guest_parts, F.lit(1)) - 1)) \
        .otherwise(F.array().cast("array<int>"))
    places = F.when(F.col("__visit") == 0, F.concat(
        F.transform(owns, lambda j: _entry(slot, _IN_SLOT, F.least(own, j), F.greatest(own, j), own > j)),
        F.transform(guests, lambda j: _entry(slot, _NEXT_SLOT, own, j, F.lit(0))),
    )).otherwise(F.transform(owns, lambda j: _entry(slot, _NEXT_SLOT, j, guest, F.lit(1))))
    kept = [c for c in at.columns if c not in ("__visit", "__slot")]
    units = placed.select(*kept, F.inline(places).alias("__slot", "__kind", "__i", "__j", "__side"))
    return units.withColumn("__task", F.pmod(F.xxhash64(*_UNIT), bins))


def _partitioned(rows: DataFrame, id_col: str, vector_col: str, block: Column, threshold: float, part_rows: int,
                 pivots: int, sizes_of: DataFrame | None = None) -> tuple[DataFrame, metric.Partition | None]:
    """Rows and the partition for them, if a block is larger than a part; the vectors are then
    written, so a model upstream runs once. ``sizes_of``: cheaper rows with at least as many a block."""
    if not pivots or metric.reach_of(threshold) is None:
        return rows, None
    per_block = (rows if sizes_of is None else sizes_of).groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    largest = per_block.agg(F.max("n")).first()[0] or 0
    if largest <= part_rows:
        return rows, None
    rows = metric.stored(rows, "vectors")
    large = per_block.where(F.col("n") > part_rows).select(F.col("block").alias("__large"))
    from_large = rows.join(large, block.eqNullSafe(F.col("__large")), "left_semi")
    return rows, metric.partition_for(from_large, id_col, vector_col, threshold, part_rows, largest, pivots)


def comparisons(
    rows: DataFrame, id_col: str, vector_col: str, threshold: float, block: str,
    part_rows: int = PART_ROWS, pivots: int = metric.PIVOTS,
) -> DataFrame:
    """Per block its rows, all their pairs, and the pairs that ``similar_pairs`` compares."""
    rows, partition = _partitioned(rows, id_col, vector_col, F.col(block), threshold, part_rows, pivots)
    n = rows.groupBy(F.col(block).alias("block")).agg(F.count(F.lit(1)).alias("n_rows"))
    every = F.expr("n_rows * (n_rows - 1) div 2")
    if partition is None:
        return n.select("block", "n_rows", every.alias("n_pairs"), every.alias("n_compared"))
    sized = rows.select(F.col(block).alias("__block"), F.col(id_col).alias("__id"), F.col(vector_col).alias("__vec")) \
        .join(n.select(F.col("block").alias("__of"), F.ceil(F.col("n_rows") / part_rows).alias("__parts")),
              F.col("__block").eqNullSafe(F.col("__of"))).drop("__of")
    _, sizes = _in_regions(sized, part_rows, partition)
    compared = sizes.groupBy("__block").agg(
        F.expr("sum(__own * (__own - 1) div 2 + __own * __guests)").alias("n_compared"))
    return n.join(compared, F.col("block").eqNullSafe(F.col("__block"))).select(
        "block", "n_rows", every.alias("n_pairs"), "n_compared")


def similar_pairs(
    rows: DataFrame,
    id_col: str,
    vector_col: str,
    threshold: float,
    block: str | Column | None = None,
    payload: Sequence[str] = (),
    ts_col: str | None = None,
    window_seconds: int | None = None,
    part_rows: int = PART_ROWS,
    both_directions: bool = True,
    pivots: int = metric.PIVOTS,
    carried: Sequence[str] = (),
    chosen: Callable[[pd.DataFrame, np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Pairs of different ids of one block with cosine >= threshold.

    Returns ``id_a``, ``id_b``, ``block``, ``similarity`` (6 decimals, the
    threshold applies to the rounded value) and each payload column with
    suffixes ``_a`` and ``_b``. ``window_seconds`` keeps only pairs whose
    ``ts_col`` lie at most that far apart. Without a window, blocks larger than a part are
    split by at most ``pivots`` pivots (0: never); the sizes of the blocks are
    counted when this is called. Of the pairs of row numbers ``a``, ``b`` of a table with the columns ``carried``,
    ``chosen`` tells which stay.
    """
    block_col = F.lit(0) if block is None else F.col(block) if isinstance(block, str) else block
    if window_seconds is not None:
        rows, partition = rows.where(F.col(ts_col).isNotNull()), None
    else:
        rows, partition = _partitioned(rows, id_col, vector_col, block_col, threshold, part_rows, pivots)
    units = _units(rows, id_col, vector_col, block_col, [*payload, *carried], part_rows,
                   ts_col, window_seconds, partition, LARGE_ROWS)
    fields = {f.name: f.dataType for f in units.schema.fields}
    schema = T.StructType([
        T.StructField("id_a", fields["__id"]), T.StructField("id_b", fields["__id"]),
        T.StructField("block", fields["__block"]), T.StructField("similarity", T.DoubleType()),
        *[T.StructField(f"{c}_{s}", fields[f"__p_{c}"]) for s in "ab" for c in payload],
    ])
    payload = list(payload)
    reach = None if window_seconds is None else window_seconds * 1_000_000

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True)
        pdf["__unit"] = pdf.groupby(_UNIT, sort=False, dropna=False).ngroup()
        pdf = pdf.sort_values(["__unit", "__side"], kind="stable").reset_index(drop=True)
        ids, us = pdf["__id"].to_numpy(), pdf["__us"].to_numpy()
        more = pd.DataFrame({c: pdf[f"__p_{c}"] for c in carried})

        def found(pairs) -> pd.DataFrame:
            a, b, sims = (np.concatenate(column) for column in zip(*pairs))
            if both_directions:
                a, b, sims = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([sims, sims])
            else:
                swap = ids[a] > ids[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
            out = {"id_a": ids[a], "id_b": ids[b], "block": pdf["__block"].to_numpy()[a],
                   "similarity": sims}
            for s, at in (("a", a), ("b", b)):
                for c in payload:
                    out[f"{c}_{s}"] = pdf[f"__p_{c}"].iloc[at].array
            return pd.DataFrame(out)

        held, n = [], 0
        for a, b, sims in _scored_pairs(pdf, metric.unit_vectors(pdf["__vec"]), threshold):
            ok = ids[a] != ids[b]
            if reach is not None:
                ok &= np.abs(us[a] - us[b]) <= reach
            if chosen is not None:
                ok &= chosen(more, a, b)
            held.append((a[ok], b[ok], sims[ok]))
            n += len(held[-1][0])
            if n >= PRODUCT:  # a task's pairs leave it in pieces
                yield found(held)
                held, n = [], 0
        if n:
            yield found(held)

    return units.groupBy("__task").applyInPandas(match, schema)


def best_matches(
    rows: DataFrame,
    id_col: str,
    vector_col: str,
    threshold: float,
    block: str,
    part_rows: int = PART_ROWS,
    all_ids: bool = False,
    pivots: int = metric.PIVOTS,
    sizes_of: DataFrame | None = None,
) -> DataFrame:
    """For each id its most similar other id of the block, if at the threshold.

    Equal similarities go to the smaller id. Each unit reports one candidate
    per row, so the output stays linear in the input. ``all_ids`` also lists ids
    without a match and adds ``nonzero``: whether the id's vector is not zero. ``pivots`` as for
    ``similar_pairs``; ``sizes_of`` are cheaper rows to count blocks by, at least as many.
    """
    rows, partition = _partitioned(
        rows.select(id_col, vector_col, block), id_col, vector_col, F.col(block), threshold, part_rows, pivots, sizes_of)
    units = _units(rows, id_col, vector_col, F.col(block), (), part_rows, None, None, partition)
    fields = {f.name: f.dataType for f in units.schema.fields}
    schema = T.StructType([
        T.StructField("id", fields["__id"]), T.StructField("similarity", T.DoubleType()),
        T.StructField("other_id", fields["__id"]), T.StructField("nonzero", T.BooleanType()),
    ])

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        # by id, so that the first of several equal maxima has the smallest id
        pdf = pdf.sort_values("__id", kind="stable").reset_index(drop=True)
        unit, ids = metric.unit_vectors(pdf["__vec"]), pdf["__id"].to_numpy()
        found = [(ids[:0], np.zeros(0), ids[:0])]
        alone = [(ids[:0], np.zeros(0, bool))]

        def report(scores: np.ndarray, here: np.ndarray, there: np.ndarray) -> None:
            best = scores.argmax(axis=1)
            value = scores[np.arange(len(here)), best]
            ok = value >= threshold
            found.append((ids[here[ok]], value[ok], ids[there[best[ok]]]))

        for left, right in _unit_slices(pdf):
            if right is None:
                scores = _cosines(unit[left], unit[left])
                if all_ids:
                    alone.append((ids[left], unit[left].any(axis=1)))
                scores[ids[left][:, None] == ids[left][None, :]] = -np.inf
                report(scores, left, left)
            elif len(left) and len(right):
                scores = _cosines(unit[left], unit[right])
                report(scores, left, right)
                report(scores.T, right, left)
        here, similarity, there = (np.concatenate(column) for column in zip(*found))
        matches = pd.DataFrame({"id": here, "similarity": similarity, "other_id": there, "nonzero": None})
        if not all_ids:
            return matches
        own, nonzero = (np.concatenate(column) for column in zip(*alone))
        return pd.concat([matches, pd.DataFrame(
            {"id": own, "similarity": None, "other_id": None, "nonzero": nonzero})])

    candidates = units.groupBy("__task").applyInPandas(match, schema)
    match_of = F.when(F.col("similarity").isNotNull(), F.struct((-F.col("similarity")).alias("rank"), "other_id"))
    best = candidates.groupBy("id").agg(F.min(match_of).alias("best"), F.max("nonzero").alias("nonzero")).select(
        "id", (-F.col("best.rank")).alias("similarity"), F.col("best.other_id").alias("other_id"), "nonzero")
    return best if all_ids else best.drop("nonzero")


# ---------------------------------------------------------------- operators

def detect_duplicates(
    invoices: DataFrame,
    similarity_threshold: float = DEFAULTS.similarity,
    time_window_hours: int | None = None,
    embedder: str | Embedder = "hash",
    with_embeddings: bool = False,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Ordered pairs of similar invoices of one vendor.

    ``time_window_hours`` keeps the pairs at most that far apart in time.
    """
    embedded = compute_embeddings(invoices, embedder)
    payload = ["amount", "ts"] + (["embedding"] if with_embeddings else [])
    pairs = similar_pairs(
        embedded, "invoice_id", "embedding", similarity_threshold, "vendor_id", payload,
        ts_col="ts", part_rows=part_rows,
        window_seconds=None if time_window_hours is None else time_window_hours * 3600)
    return pairs.select(
        F.col("id_a").alias("invoice_id_1"), F.col("id_b").alias("invoice_id_2"),
        *[F.col(f"{c}_{s}").alias(f"{c}_{k}") for c in payload for s, k in (("a", 1), ("b", 2))],
        "similarity")


def semantic_duplicates(
    invoices: DataFrame,
    similarity_threshold: float = DEFAULTS.similarity,
    embedder: str | Embedder = "hash",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Ordered pairs of invoices of one vendor whose labelled texts are similar."""
    embedded = embed_once(embed_text_labelled(invoices), "semantic_text", embedder)
    pairs = similar_pairs(
        embedded, "invoice_id", "embedding", similarity_threshold, "vendor_id",
        ["description", "amount"], part_rows=part_rows)
    return pairs.select(
        F.col("id_a").alias("invoice_id"), F.col("id_b").alias("duplicate_of"),
        F.col("block").alias("vendor_id"),
        F.col("description_a").alias("description"),
        F.col("description_b").alias("duplicate_description"),
        F.col("amount_a").alias("amount"), F.col("amount_b").alias("duplicate_amount"),
        F.col("similarity").alias("semantic_similarity"),
        F.lit(True).alias("is_semantic_duplicate"),
        F.lit("SEMANTIC").alias("duplicate_type"))


def enrich_semantic(
    invoices: DataFrame,
    similarity_threshold: float = DEFAULTS.similarity,
    embedder: str | Embedder = "hash",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Each invoice with its best semantic duplicate, if it has one.

    Equal texts of a vendor are embedded and compared once. A copy's best match
    is another copy: the one with the smallest id, and for that one the one
    with the greatest id. Otherwise the most similar other text counts, and of
    its invoices the smallest id. Pairs of copies are never listed, so a text
    shared by a third of all rows costs no more than its rows.
    """
    texts = embed_text_labelled(invoices)
    groups = texts.groupBy("vendor_id", "semantic_text").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("invoice_id").alias("first_id"), F.max("invoice_id").alias("last_id"))
    vectors = embedder_named(embedder)(groups, "semantic_text", "embedding")
    # the vectors stay inside the comparison, so that each text meets the embedder once
    others = best_matches(
        vectors, "first_id", "embedding", similarity_threshold, "vendor_id", part_rows, all_ids=True,
        sizes_of=invoices)
    self_similar = F.col("nonzero") & F.lit(similarity_threshold <= 1.0)
    matched = groups.join(others.withColumnRenamed("id", "first_id"), "first_id", "left").select(
        "vendor_id", "semantic_text", "copies", "first_id", "last_id",
        ((F.col("copies") > 1) & self_similar).alias("__copied"),
        F.col("similarity").alias("__similarity"), F.col("other_id").alias("__other"),
    ).where(F.col("__copied") | F.col("__other").isNotNull())
    joined = attach_by_key(
        texts, matched, ["vendor_id", "semantic_text"], "copies", "invoice_id", how="left",
        sizes=groups.select("vendor_id", "semantic_text", "copies"), null_safe=True)
    copied = F.coalesce("__copied", F.lit(False))
    copy = F.when(F.col("invoice_id") == F.col("first_id"), F.col("last_id")) \
        .otherwise(F.col("first_id"))
    return joined.select(
        *invoices.columns,
        (copied | F.col("__other").isNotNull()).alias("has_semantic_duplicate"),
        F.when(copied, F.lit(1.0)).otherwise(F.coalesce("__similarity", F.lit(0.0)))
        .alias("semantic_similarity_score"),
        F.when(copied, copy).otherwise(F.coalesce("__other", F.lit("")))
        .alias("duplicate_invoice_id"),
    )


def find_similar(
    queries: DataFrame,
    corpus: DataFrame,
    query_id: str,
    corpus_id: str,
    vector_col: str = "embedding",
    threshold: float = DEFAULTS.similarity,
    part_rows: int = PART_ROWS,
    ordered: bool = True,
    index: metric.PivotIndex | None = None,
) -> DataFrame:
    """All corpus items at or above the threshold for each query, best first.

    Searches ``index``, or one that is built for this call: a query meets only the
    cells of the corpus that can hold a match, and cells are cut into parts, so neither
    side has to fit anywhere as a whole. With an ``index`` the corpus is not read.
    """
    if index is None:
        index = metric.PivotIndex.build(
            corpus, corpus_id, vector_col, scratch_path(corpus.sparkSession, "pivot-index"), part_rows=part_rows)
    found = index.search(queries, query_id, vector_col, threshold, part_rows)
    return found.orderBy(query_id, F.desc("similarity"), "match_id") if ordered else found


def similar_approx(
    rows: DataFrame,
    id_col: str,
    vector_col: str,
    threshold: float,
    block: str,
    bucket_length: float = 0.5,
    tables: int = 8,
    seed: int = 17,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """A subset of ``similar_pairs`` found by locality-sensitive hashing.

    Unit vectors are hashed by random projections; only rows that share a block
    and a bucket are compared, by their exact similarity. A crowded bucket is
    cut into parts like any other block, not by pivots: its rows, of which there is one for each
    table, lie near each other already. A pair counts in the first table that shows it.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    length = norm(F.col(vector_col))
    unit = rows.where(length > 0).select(
        id_col, block, vector_col, F.transform(
            vector_col, lambda x: F.coalesce(F.try_divide(x.cast("double"), length), F.lit(0.0)))
        .alias("__unit"))
    features = unit.withColumn("__features", array_to_vector("__unit")).drop("__unit")
    lsh = BucketedRandomProjectionLSH(
        inputCol="__features", outputCol="__hashes", bucketLength=bucket_length,
        numHashTables=tables, seed=seed)
    every = F.array(*[vector_to_array(F.col("__hashes")[t])[0].cast("bigint") for t in range(tables)])
    hashed = lsh.fit(features).transform(features).select(id_col, block, vector_col, every.alias("__every")) \
        .select("*", F.posexplode("__every").alias("__table", "__hash"))
    bucket = F.struct(F.col(block).alias("block"), F.col("__table").alias("t"), F.col("__hash").alias("h"))

    def in_first_table(rows: pd.DataFrame, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        hashes = np.stack(rows["__every"])
        return (hashes[a] == hashes[b]).argmax(axis=1) == rows["__table"].to_numpy()[a]

    pairs = similar_pairs(
        hashed.withColumn("__bucket", F.to_json(bucket)), id_col, vector_col, threshold,
        "__bucket", payload=[block], part_rows=part_rows, both_directions=False, pivots=0,
        carried=["__every", "__table"], chosen=in_first_table)
    once = pairs.groupBy("id_a", "id_b").agg(
        F.max("similarity").alias("similarity"), F.first(f"{block}_a").alias("block"))
    return once.select(F.explode(F.array(
        F.struct("id_a", "id_b", "block", "similarity"),
        F.struct(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"),
                 "block", "similarity"))).alias("p")).select("p.*")
