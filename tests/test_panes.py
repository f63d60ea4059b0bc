"""Panes on a stream, and rows behind the watermark."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import same
from ledgerlynx.operators import vendor
from ledgerlynx.streaming import panes, tables

NOON = dt.datetime(2024, 1, 3, 12)


def at(minutes):
    return None if minutes is None else NOON + dt.timedelta(minutes=minutes)


def test_panes_equal_windows_and_refuse_an_uneven_hop(make):
    rows = make(*[{"ts": at(m), "amount": a} for m, a in [(0, 1.5), (4, 2.25), (59, None), (61, 1e14), (61, 3.0)]],
                {"vendor_id": None, "ts": at(3)}, {"ts": None})
    want = vendor.velocity(rows)
    assert same(want, vendor.windows_of_panes(vendor.panes(rows)))
    assert want.where("vendor_id IS NULL").count() == 12
    with pytest.raises(ValueError):
        panes.stream_windows(rows, 45, 30)


def test_late_rows_wait_and_are_added(spark, make, tmp_path):
    log = panes.PaneLog(spark, str(tmp_path / "log"), delay_minutes=60, most_folders=2)
    batches = [
        make({"invoice_id": "a", "ts": at(0)}, {"invoice_id": "b", "ts": at(-500)}, {"invoice_id": "n", "ts": None}),
        # exactly on the watermark is not late, a microsecond before it is
        make({"invoice_id": "c", "ts": at(-60)}, {"invoice_id": "d", "ts": at(-60) - dt.timedelta(microseconds=1)},
             {"invoice_id": "e", "vendor_id": None, "ts": at(-400)}, {"invoice_id": "f", "ts": at(300)}),
        make({"invoice_id": "g", "ts": at(239)}, {"invoice_id": "h", "ts": at(240), "amount": 2e15}),
    ]
    log(batches[0], 0)
    log(batches[0], 0)  # a retry adds nothing
    log(batches[1], 1)
    log(batches[2], 2)
    late = {r["invoice_id"]: r["_batch"] for r in log.rows_behind().collect()}
    assert late == {"d": 1, "e": 1, "g": 2}
    everything = batches[0].unionByName(batches[1]).unionByName(batches[2])
    on_time = everything.where(~F.col("invoice_id").isin("d", "e", "g"))
    assert same(vendor.velocity(on_time), log.velocity())
    assert log.reconcile() == 3
    assert same(vendor.velocity(everything), log.velocity())
    assert log.rows_behind().isEmpty()
    assert {r["invoice_id"] for r in log.rows_behind(reconciled=True).collect()} == set(late)
    assert log.reconcile() == 0


def test_pane_folders_stay_bounded(spark, make, tmp_path):
    log = panes.PaneLog(spark, str(tmp_path / "log"), delay_minutes=10, most_folders=3)
    everything = None
    for i in range(8):
        batch = make({"invoice_id": f"x{i}", "ts": at(i)}, {"invoice_id": f"y{i}", "ts": at(i - 30)})
        everything = batch if everything is None else everything.unionByName(batch)
        log(batch, i)
        assert len(log.live()["tables"]["panes"]["folders"]) <= 3
    assert log.reconcile() == 7  # the first batch has nothing before it
    assert same(vendor.velocity(everything), log.velocity())


def test_empty_log(spark, make, tmp_path):
    log = panes.PaneLog(spark, str(tmp_path / "log"))
    assert log.reconcile() == 0 and log.watermark() is None
    log(make({}).limit(0), 0)
    assert log.watermark() is None and log.velocity().isEmpty()


def test_a_pane_has_one_state_row(spark, make, tmp_path):
    rows = make(*[{"invoice_id": f"I{i}", "vendor_id": f"V{i % 3}", "ts": at(7 * i)} for i in range(30)])
    rows.write.parquet(str(tmp_path / "in"))
    stream = panes.stream_panes(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), watermark=None)
    out = str(tmp_path / "out")
    query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")) \
        .foreachBatch(lambda b, n: tables.write_version(b, out, n) and None).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == vendor.panes(rows).count()
    got = vendor.windows_of_panes(tables.current_rows(spark, out, ["vendor_id", "pane"], stream.schema))
    assert same(vendor.velocity(rows), got)


def test_append_mode_gives_closed_windows_once(spark, make, tmp_path):
    rows = make(*[{"invoice_id": f"I{i}", "ts": at(7 * i)} for i in range(30)])
    rows.write.parquet(str(tmp_path / "in"))
    stream = panes.stream_windows(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")),
                                  watermark="60 minutes")
    tables.run_to_versions(stream, str(tmp_path / "out"), str(tmp_path / "cp"), mode="append")
    got = tables.read_versions(spark, str(tmp_path / "out"), stream.schema).drop(tables.VERSION)
    closed = vendor.velocity(rows).where(F.col("window_end") <= F.lit(at(7 * 29 - 60)))
    assert closed.count() > 0 and same(closed, got)


def test_windows_of_a_log_meet_its_panes_once(spark, make, tmp_path):
    day = dt.datetime(2024, 1, 3)
    batches = [make(*[{"ts": day + dt.timedelta(minutes=7 * i), "amount": a, "vendor_id": v}
                      for i in range(q, 9) for a in (10.25, None, 3e15) for v in ("V1", None)]) for q in range(4)]
    log = panes.PaneLog(spark, str(tmp_path / "log"))
    for q, rows in enumerate(batches):
        log(rows, q)
    got = log.velocity()
    assert len(log.live()["tables"]["panes"]["folders"]) == 4
    # sums of one pane from four batches go to its windows as they are: one shuffle
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    every = batches[0]
    for rows in batches[1:]:
        every = every.unionByName(rows)
    assert same(vendor.velocity(every), got)
