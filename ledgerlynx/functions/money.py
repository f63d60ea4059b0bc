"""Exact money arithmetic.

A distributed sum of doubles depends on the order in which partitions are
merged, and a score next to a threshold may then flip from run to run. So each
amount is taken as the decimal number it is written as, with up to ten
decimals, and all sums are decimal and exact: in any order, for any currency
or unit price, in one way for every size. Each result is turned into DOUBLE
once, at the end.

An amount is cut into its whole part a and its fraction b (0 <= b < 1), and its
square into a*a + 2*a*b + b*b, so that squares fit 38 digits: amounts below 1e14
in up to 1e10 rows of a group. Amounts from 1e14 to 1e28 have no cents in a double
any more and are summed beside them as whole numbers, exactly too; only their squares are a sum
of doubles, so the deviation of a group with such an amount may differ in its last digits.
A group with an amount beyond that (or one that is no number) has NULL statistics, never a
guess, and what reads them takes NULL as unknown, not as harmless.
NULL amounts add nothing to a sum but count as rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL, WHOLE = "DECIMAL(24,10)", "DECIMAL(28,0)"
#: Running sums of a history; ``big`` and ``bq`` are the sum and the squares of amounts from 1e14 on.
MOMENTS = ("sa", "sb", "aa", "ab", "bb", "big", "bq")


def exact_sql(amount: str = "amount") -> str:
    """The amount as a decimal; NULL if it is NULL, no number, or has more than 14 whole digits."""
    return f"try_cast({amount} AS {DECIMAL})"


def _big(amount: str) -> str:
    return f"IF({exact_sql(amount)} IS NULL, try_cast({amount} AS {WHOLE}), NULL)"


def _lost(amount: str) -> str:
    return f"{amount} IS NOT NULL AND {exact_sql(amount)} IS NULL AND try_cast({amount} AS {WHOLE}) IS NULL"


def moment_columns(amount: str = "amount") -> dict[str, Column]:
    """Per row the decimal parts that are summed; NULL where the amount has none."""
    d = exact_sql(amount)
    a = f"CAST(floor({d}) AS DECIMAL(15,0))"
    b = f"CAST({d} - floor({d}) AS DECIMAL(11,10))"
    return {
        "sa": F.expr(a), "sb": F.expr(b), "aa": F.expr(f"CAST({a} * {a} AS DECIMAL(29,0))"),
        "ab": F.expr(f"CAST({a} * {b} AS DECIMAL(26,10))"),
        "bb": F.expr(f"CAST({b} * {b} AS DECIMAL(21,20))"), "big": F.expr(_big(amount)),
        "bq": F.expr(f"CAST({_big(amount)} AS DOUBLE) * CAST({_big(amount)} AS DOUBLE)"),
        "lost": F.expr(f"IF({_lost(amount)}, 1L, 0L)"),
    }


def total(name: str, amount: str = "amount") -> Column:
    """Exact sum of the amounts of a group."""
    return total_of_parts(name, exact_sql(amount), _big(amount), _lost(amount))


def parts(amount: str = "amount") -> dict[str, Column]:
    """What ``total`` sums of a row, for groups that share rows."""
    return {"small": F.expr(exact_sql(amount)), "big": F.expr(_big(amount)), "lost": F.expr(_lost(amount))}


def total_of_parts(name: str, small: str, big: str, lost: str) -> Column:
    small, big = f"CAST(try_sum({small}) AS DOUBLE)", f"CAST(sum({big}) AS DOUBLE)"
    return F.expr(f"CASE WHEN count_if({lost}) > 0 THEN NULL "
                  f"ELSE coalesce({small} + {big}, {small}, {big}) END AS {name}")


def moment_sums(amount: str = "amount") -> list[Column]:
    """Aggregates from which sum, mean and deviation follow."""
    parts = moment_columns(amount)
    return [F.count(F.lit(1)).alias("n"), F.sum(parts["lost"]).alias("lost"),
            *[F.try_sum(parts[m]).alias(m) for m in MOMENTS]]


def merged_moment_sums() -> list[Column]:
    """The same aggregates over groups that already have them."""
    return [F.sum("n").alias("n"), F.sum("lost").alias("lost"), *[F.try_sum(m).alias(m) for m in MOMENTS]]


def total_sums(amount: str = "amount") -> list[Column]:
    """Those of ``moment_sums`` from which count and total follow."""
    parts = moment_columns(amount)
    return [F.count(F.lit(1)).alias("n"), F.sum(parts["lost"]).alias("lost"),
            *[F.try_sum(parts[m]).alias(m) for m in ("sa", "sb", "big", "bq")]]


def merged_total_sums() -> list[Column]:
    """The same aggregates over groups that already have them."""
    return [F.sum("n").alias("n"), F.sum("lost").alias("lost"),
            *[F.try_sum(m).alias(m) for m in ("sa", "sb", "big", "bq")]]


# Results from the moment sums of n rows. Narrow types keep all ten decimals of a product.
_HAS_BIG = "coalesce(bq, 0D) > 0D"
_SMALL = "CAST(try_cast(sa AS DECIMAL(27,0)) + try_cast(sb AS DECIMAL(27,10)) AS DOUBLE)"
TOTAL = f"IF(lost = 0, IF({_HAS_BIG}, coalesce({_SMALL}, 0D) + CAST(big AS DOUBLE), {_SMALL}), NULL)"
MEAN = f"IF(n > 0, {TOTAL} / n, NULL)"
_N = "CAST(n AS DECIMAL(18,0))"
_PIVOT = f"try_cast(floor({TOTAL} / n) AS DECIMAL(15,0))"


def stddev_sql(high: str, low: str) -> str:
    """Population standard deviation of a group with greatest amount ``high`` and least ``low``.

    The squares are taken around a whole number next to the mean, exactly, so
    large amounts close together lose nothing. Equal amounts have exactly 0.
    """
    sa = "try_cast(sa AS DECIMAL(27,0))"
    whole = f"aa - 2BD * {_PIVOT} * {sa} + {_N} * {_PIVOT} * {_PIVOT}"
    mixed = f"try_cast(ab AS DECIMAL(36,10)) - try_cast({_PIVOT} * try_cast(sb AS DECIMAL(22,10)) AS DECIMAL(36,10))"
    around = f"(CAST({whole} AS DOUBLE) + 2D * CAST({mixed} AS DOUBLE) + CAST(bb AS DOUBLE)) / n"
    off = f"(CAST({sa} - {_N} * {_PIVOT} AS DOUBLE) + CAST(sb AS DOUBLE)) / n"
    squares = "coalesce(CAST(aa AS DOUBLE) + 2D * CAST(ab AS DOUBLE) + CAST(bb AS DOUBLE), 0D) + bq"
    return (f"CASE WHEN n > 0 AND lost = 0 AND {high} = {low} THEN 0D "
            f"WHEN n > 0 AND lost = 0 AND {_HAS_BIG} "
            f"THEN sqrt({_no_less_than_zero(f'({squares}) / n - ({TOTAL} / n) * ({TOTAL} / n)')}) "
            f"WHEN n > 0 AND lost = 0 THEN sqrt({_no_less_than_zero(f'{around} - ({off}) * ({off})')}) END")


def _no_less_than_zero(x: str) -> str:
    # greatest() skips NULL, which would turn an unknown deviation into 0
    return f"IF({x} < 0D, 0D, {x})"
