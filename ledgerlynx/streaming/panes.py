"""Sliding windows on a stream from panes of one hop, and rows behind the watermark kept aside."""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlynx.functions import money
from ledgerlynx.operators import vendor
from ledgerlynx.sources.jsonl import BATCH
from ledgerlynx.streaming.snapshots import SnapshotLog


def stream_panes(invoices: DataFrame, hop_minutes: int = 5, watermark: str | None = "1 day") -> DataFrame:
    """Counts and sums per vendor and pane (update mode): one state row for a pane, however many windows
    cover it. ``vendor.windows_of_panes`` over the last version of each pane gives the windows."""
    rows = invoices if watermark is None else invoices.withWatermark("ts", watermark)
    return vendor.panes(rows, hop_minutes)


def stream_windows(invoices: DataFrame, window_minutes: int = 60, hop_minutes: int = 5,
                   watermark: str = "1 day") -> DataFrame:
    """The windows of ``velocity``, each once, when the watermark has passed its end (append mode).

    A pane is handed on when the watermark has passed it, so only the windows that are open at
    the watermark have a state row each; rows within the allowed lateness are kept by pane.
    """
    if window_minutes % hop_minutes:
        raise ValueError("the hop must divide the window")
    panes = stream_panes(invoices, hop_minutes, watermark)
    return panes.groupBy(
        "vendor_id", F.window(F.window_time("pane"), f"{window_minutes} minutes", f"{hop_minutes} minutes").alias("w"),
    ).agg(*money.merged_total_sums()).selectExpr(
        "vendor_id", "n AS invoice_count", f"{money.TOTAL} AS total_amount",
        "w.start AS window_start", "w.end AS window_end")


class PaneLog(SnapshotLog):
    """A ``foreachBatch`` function that keeps panes, and rows behind the watermark in a table of their own.

    Each batch adds the pane sums of its rows; sums of the same pane are added up when read and when
    folded, so what is read grows with the panes, not with the batches. Rows more than ``delay_minutes`` older
    than the newest row of all batches before are left out of the panes and kept in ``late``. ``reconcile`` adds
    them to the panes and moves them to ``reconciled``. Batches and reconcilings become visible as a
    whole, and a retried batch changes nothing. Rows without a timestamp are in no pane and never late.
    """

    def __init__(self, spark: SparkSession, folder: str, hop_minutes: int = 5, delay_minutes: int = 24 * 60,
                 most_folders: int = 8) -> None:
        super().__init__(spark, folder, {}, most_folders)
        self.hop_minutes, self.delay_minutes = hop_minutes, delay_minutes

    def _write(self, name: str, rows: DataFrame) -> str:
        path = f"{self.folder}/data/{name}/{self._new_name()}"
        rows.write.parquet(path)
        return path

    def _stored(self, table: dict) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(table["schema"]))
        if not table["folders"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*table["folders"])

    def _folds(self, name: str) -> bool:
        return name in ("panes", "newest")

    def _latest(self, name: str, table: dict) -> DataFrame:
        rows = self._stored(table)
        if name == "newest":
            return rows.groupBy().agg(F.max("micros").alias("micros"), F.max(BATCH).alias(BATCH))
        if name != "panes":
            return rows
        sums = rows.groupBy("vendor_id", "pane").agg(*money.merged_total_sums(), F.max(BATCH).alias(BATCH))
        # a sum of sums would be wider than the stored column
        return sums.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in rows.schema])

    def watermark(self) -> int | None:
        """Rows older than this (microseconds since 1970) are late now."""
        state = self.live()
        newest = self.read("newest", state).agg(F.max("micros")).first()[0] if "newest" in state["tables"] else None
        return None if newest is None else newest - self.delay_minutes * 60_000_000

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        mark = self.watermark()
        at = F.unix_micros("ts")
        late = F.lit(False) if mark is None else F.coalesce(at < F.lit(mark), F.lit(False))
        rows = batch.persist(StorageLevel.MEMORY_AND_DISK)  # three tables from one read of the source
        try:
            self.commit({"panes": vendor.panes(rows.where(~late), self.hop_minutes), "late": rows.where(late),
                         "newest": rows.agg(F.max(at).alias("micros"))}, batch_id)
        finally:
            rows.unpersist()

    def reconcile(self) -> int:
        """Add the late rows to the panes; returns how many there were."""
        now = self.live()
        tables = dict(now["tables"])
        if not tables.get("late", {}).get("folders"):
            return 0
        late = self._stored(tables["late"])
        more = vendor.panes(late, self.hop_minutes).withColumn(BATCH, F.lit(now["batch"]).cast("long"))
        done = tables.get("reconciled", {**tables["late"], "folders": []})
        tables["panes"] = {**tables["panes"], "folders": [*tables["panes"]["folders"], self._write("panes", more)]}
        tables["reconciled"] = {**done, "folders": [*done["folders"], *tables["late"]["folders"]]}
        tables["late"] = {**tables["late"], "folders": []}
        n = late.count()
        self._publish({**now, "number": now["number"] + 1, "tables": tables})
        if len(tables["panes"]["folders"]) > self.most_folders:
            self.compact()
        return n

    def rows_behind(self, reconciled: bool = False) -> DataFrame:
        """Late rows and the batch (``_batch``) they came in: those that still wait, or those added since."""
        tables = self.live()["tables"]
        name = "reconciled" if reconciled and "reconciled" in tables else "late"
        rows = self._stored(tables[name]).withColumnRenamed(BATCH, "_batch")
        return rows.limit(0) if reconciled and name == "late" else rows

    def velocity(self, window_minutes: int = 60) -> DataFrame:
        """The windows of all rows in the panes by now. The sums of a pane that several batches added to
        meet in its windows; they are not added up before."""
        panes = self._stored(self.live()["tables"]["panes"])
        return vendor.windows_of_panes(panes, window_minutes, self.hop_minutes)
