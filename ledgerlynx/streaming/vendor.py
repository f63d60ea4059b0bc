"""Vendor operators on a stream."""

import math
import operator
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlynx.functions import money


def stream_velocity(
    invoices: DataFrame,
    window_minutes: int = 60,
    hop_minutes: int = 5,
    watermark: str | None = "1 day",
) -> DataFrame:
    """Sliding-window counts and amounts per vendor.

    Rows later than ``watermark`` are dropped and their windows' state freed;
    ``None`` keeps all state and accepts any lateness (update mode only); where the hop divides the
    window, one state row then holds all windows that start within one window's length, so a row of the
    input meets two of them and not one for each window, and a batch re-emits all of a state row's windows.
    """
    if watermark is None and window_minutes % hop_minutes == 0:
        return _velocity_by_block(invoices, window_minutes, hop_minutes)
    rows = invoices if watermark is None else invoices.withWatermark("ts", watermark)
    return rows.groupBy(
        "vendor_id", F.window("ts", f"{window_minutes} minutes", f"{hop_minutes} minutes")
        .alias("w"),
    ).agg(
        F.count(F.lit(1)).alias("invoice_count"),
        money.total("total_amount"),
    ).select(
        "vendor_id", "invoice_count", "total_amount",
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"))


def _velocity_by_block(invoices: DataFrame, window_minutes: int, hop_minutes: int) -> DataFrame:
    """The windows of ``stream_velocity`` from groups of the windows that start in one block of ``many`` hops.

    The windows of a block cover the panes of that block and of the next one, so a row counts in its own block
    and in the one before; window i of a block covers the panes i to i + many - 1 from its start.
    """
    many, hop = window_minutes // hop_minutes, hop_minutes * 60_000_000
    pane = F.floor(F.unix_micros("ts") / F.lit(hop))
    first = F.floor(pane / F.lit(many))
    rows = invoices.where("ts IS NOT NULL").select("vendor_id", *[c.alias(n) for n, c in money.parts().items()],
                                                   pane.alias("pane"), F.explode(F.array(first, first - 1)).alias("block")) \
        .withColumn("at", F.expr(f"CAST(pane - block * {many} AS INT)")).where(F.col("at") < 2 * many - 1)
    covers = [f"at BETWEEN {i} AND {i + many - 1}" for i in range(many)]
    sums = [c for i, own in enumerate(covers) for c in (
        F.expr(f"count_if({own}) AS n{i}"),
        money.total_of_parts(f"total{i}", f"IF({own}, small, NULL)", f"IF({own}, big, NULL)", f"{own} AND lost"))]
    windows = ", ".join(f"struct({i} AS i, n{i} AS n, total{i} AS total)" for i in range(many))
    found = rows.groupBy("vendor_id", "block").agg(*sums).selectExpr(
        "vendor_id", "block", f"inline(array({windows}))").where("n > 0")
    start = f"(block * {many} + i) * {hop}"
    return found.selectExpr(
        "vendor_id", "n AS invoice_count", "total AS total_amount", f"timestamp_micros({start}) AS window_start",
        f"timestamp_micros({start} + {window_minutes * 60_000_000}) AS window_end")


def stream_vendor_stats(invoices: DataFrame) -> DataFrame:
    """Vendor statistics kept up to date by the state store (update mode)."""
    return invoices.groupBy("vendor_id").agg(*money.moment_sums(), *map(F.expr, [
        "max(amount) AS max_amount", "min(amount) AS min_amount",
        "max(ts) AS last_invoice_time", "max(bank_account) AS last_bank_account",
    ])).selectExpr(
        "vendor_id", "n AS total_invoices",
        f"{money.TOTAL} AS total_amount", f"{money.MEAN} AS avg_amount",
        "max_amount", "min_amount", "last_invoice_time", "last_bank_account",
        f"{money.stddev_sql('max_amount', 'min_amount')} AS stddev_amount")


ARRIVAL_SCHEMA = T.StructType([
    T.StructField("vendor_id", T.StringType()),
    T.StructField("invoice_id", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("bank_account", T.StringType()),
    T.StructField("vendor_total_invoices", T.LongType()),
    T.StructField("vendor_total_amount", T.DoubleType()),
    T.StructField("vendor_avg_amount", T.DoubleType()),
    T.StructField("vendor_max_amount", T.DoubleType()),
    T.StructField("vendor_min_amount", T.DoubleType()),
    T.StructField("vendor_stddev_amount", T.DoubleType()),
    T.StructField("vendor_last_bank_account", T.StringType()),
])

# sums are whole numbers of any length, kept as text, in the order of money.MOMENTS; the squares
# of amounts from 1e14 on are a double, as in the batch form
_STATE = T.StructType([
    T.StructField("n", T.LongType()),
    T.StructField("sums", T.StringType()),
    T.StructField("squares", T.DoubleType()),
    T.StructField("lost", T.LongType()),
    T.StructField("hi", T.DoubleType()),
    T.StructField("lo", T.DoubleType()),
    T.StructField("bank", T.StringType()),
])
_UNIT = 10**10  # amounts have ten exact decimals, as in the batch form


def _moments(amount: float) -> tuple[int, ...]:
    """The parts of ``money.moment_columns`` in units of their last decimal, and whether
    the amount has none."""
    if abs(amount) >= 1e14:
        if abs(amount) >= 1e28:
            return 0, 0, 0, 0, 0, 0, 0.0, 1
        big = int(Decimal(repr(float(amount))).to_integral_value(ROUND_HALF_UP))
        return 0, 0, 0, 0, 0, big, float(big) * float(big), 0
    a, b = divmod(int((Decimal(repr(float(amount))) * _UNIT).to_integral_value(ROUND_HALF_UP)), _UNIT)
    return a, b, a * a, a * b, b * b, 0, 0.0, 0


def _statistics(n: int, sa: int, sb: int, aa: int, ab: int, bb: int, big: int, bq: float, lost: int, flat: bool):
    """Total, mean and deviation, by the steps of ``money.stddev_sql``."""
    if lost:
        return None, None, None
    total = (sa * _UNIT + sb) / _UNIT + big
    if flat:
        return total, total / n, 0.0
    if bq > 0:
        squares = float(aa) + 2.0 * (ab / _UNIT) + bb / _UNIT**2 + bq
        return total, total / n, math.sqrt(max(0.0, squares / n - (total / n) * (total / n)))
    pivot = math.floor(total / n)
    around = (float(aa - 2 * pivot * sa + n * pivot * pivot) + 2.0 * ((ab - pivot * sb) / _UNIT) + bb / _UNIT**2) / n
    off = (float(sa - n * pivot) + sb / _UNIT) / n
    return total, total / n, math.sqrt(max(0.0, around - off * off))


_OUT = T.StructType([T.StructField("at", T.LongType()) if f.name == "ts" else f for f in ARRIVAL_SCHEMA])
_RESULT = Row(*_OUT.names)


def _known(amount: float | None) -> float | None:
    return None if amount is None or math.isnan(amount) else amount


class ArrivalHistory(StatefulProcessor):
    """Per vendor: count, exact sums, range and greatest account so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._history = handle.getValueState("history", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # rows without a timestamp come first, as in the batch form
        batch = sorted(rows, key=lambda r: (r.at is not None, r.at or 0, r.invoice_id is not None, r.invoice_id or ""))
        known = self._history.get()
        n, sums, squares, lost, hi, lo, bank = known or (0, "0,0,0,0,0,0", 0.0, 0, None, None, None)
        so_far = (*map(int, sums.split(",")), squares, lost)
        for r in batch:
            n, amount = n + 1, _known(r.amount)
            if amount is not None:
                so_far = tuple(map(operator.add, so_far, _moments(amount)))
                hi, lo = (amount, amount) if hi is None else (max(hi, amount), min(lo, amount))
            if bank is None or (r.bank_account is not None and r.bank_account > bank):
                bank = r.bank_account
            total, mean, spread = _statistics(n, *so_far, hi is not None and hi == lo)
            yield _RESULT(key[0], r.invoice_id, amount, r.at, r.bank_account, n, total, mean, hi, lo, spread, bank)
        *exact, squares, lost = so_far
        self._history.update((n, ",".join(map(str, exact)), squares, lost, hi, lo, bank))

    def close(self) -> None:
        pass


def stream_arrival_history(invoices: DataFrame) -> DataFrame:
    """Each invoice with its vendor's statistics up to and including it (append mode).

    Equals ``running_history`` when batches arrive in time order. A vendor's
    rows of one micro-batch are sorted in memory, so bound the batch with
    ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``; a large backlog is a job
    for the batch form. Needs the RocksDB state store. Rows go to Python as they are, not as a table for
    each vendor, and their time as a whole number, which no time zone changes.
    """
    rows = invoices.select("vendor_id", "invoice_id", "amount", F.unix_micros("ts").alias("at"), "bank_account")
    found = rows.groupBy("vendor_id").transformWithState(
        statefulProcessor=ArrivalHistory(), outputStructType=_OUT, outputMode="Append", timeMode="None")
    return found.withColumn("at", F.timestamp_micros("at")).withColumnRenamed("at", "ts")
