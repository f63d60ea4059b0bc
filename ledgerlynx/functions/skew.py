"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is heavy when it holds both more than 1/HEAVY_SHARE of all rows and at
# least HEAVY_ROWS rows. Fewer than HEAVY_SHARE keys can be heavy whatever the
# data looks like, so the list of heavy keys (two numbers per key) is below
# 2 MB and safe to broadcast.
HEAVY_SHARE = 100_000
HEAVY_ROWS = 1_000_000

def _quoted(names: Sequence[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def heavy_keys(
    sizes: DataFrame,
    keys: Sequence[str],
    size_col: str,
    heavy_rows: int = HEAVY_ROWS,
    heavy_share: int = HEAVY_SHARE,
) -> DataFrame:
    """``__key_hash`` and number of ``__splits`` of each heavy key.

    ``sizes`` has one row per key. The total is a scalar subquery, so the
    decision is part of the plan and nothing is collected. A table without
    heavy keys gives an empty list, and the engine then drops the joins with it.
    """
    size = F.col(size_col)
    total = sizes.select(F.sum(size_col)).scalar()
    heavy = sizes.where(size >= F.lit(heavy_rows)).where(size * F.lit(heavy_share) > total)
    return heavy.groupBy(
        F.expr(f"xxhash64({', '.join(_quoted(keys))}) AS __key_hash")
    ).agg(F.expr(f"CAST(ceil(sum(`{size_col}`) / {heavy_rows}) AS INT) AS __splits"))


def attach_by_key(
    facts: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    size_col: str,
    spread_on: str | Sequence[str],
    how: str = "inner",
    sizes: DataFrame | None = None,
    heavy_rows: int = HEAVY_ROWS,
    heavy_share: int = HEAVY_SHARE,
    null_safe: bool = False,
) -> DataFrame:
    """Give each fact row the one ``per_key`` row of its key.

    Rows of a heavy key are spread over several join partitions by a hash of
    ``spread_on`` (a unique column), and its single ``per_key`` row is copied to
    each of them. Other keys join as usual. The engine still turns the join
    into a broadcast one by itself when ``per_key`` proves small at run time.

    ``size_col`` of ``per_key`` (or of ``sizes``) holds the rows per key.
    """
    keys = list(keys)
    spread = [spread_on] if isinstance(spread_on, str) else list(spread_on)
    heavy = F.broadcast(heavy_keys(
        per_key if sizes is None else sizes, keys, size_col, heavy_rows, heavy_share))
    key_hash = f"xxhash64({', '.join(_quoted(keys))}) AS __key_hash"
    split_of_row = (f"CAST(pmod(xxhash64({', '.join(_quoted(spread))}), coalesce(__splits, 1)) "
                    "AS INT) AS __split")
    every_split = "explode(sequence(0, coalesce(__splits, 1) - 1)) AS __split"

    left = facts.selectExpr("*", key_hash).join(heavy, "__key_hash", "left") \
        .selectExpr(*_quoted(facts.columns), split_of_row)
    right = per_key.selectExpr("*", key_hash).join(heavy, "__key_hash", "left") \
        .selectExpr(*_quoted(per_key.columns), every_split)
    if not null_safe:
        return left.join(right, [*keys, "__split"], how).drop("__split")

    on = [*keys, "__split"]
    right = right.withColumnsRenamed({k: f"__right_{k}" for k in on})
    match = F.expr(" AND ".join(f"`{k}` <=> `__right_{k}`" for k in on))
    return left.join(right, match, how).drop("__split", *[f"__right_{k}" for k in on])
