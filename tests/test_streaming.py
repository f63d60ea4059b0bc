"""Streams give what the batch operators give."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import same
from ledgerlynx.operators import similarity, vendor
from ledgerlynx.plans import scoring
from ledgerlynx.session import path_exists, scratch_path
from ledgerlynx.sources import invoices as src
from ledgerlynx.sources import jsonl, sinks
from ledgerlynx.streaming import live, outputs, pairs, tables
from ledgerlynx.streaming.snapshots import SnapshotLog
from ledgerlynx.streaming import vendor as stream_vendor


@pytest.fixture(scope="module")
def feed(spark, invoices, tmp_path_factory):
    """The invoices as four files in time order, read one per micro-batch."""
    folder = str(tmp_path_factory.mktemp("feed") / "in")
    quarters = invoices.withColumn("q", F.expr(
        "CASE WHEN ts < '1996-01-01' THEN 0 WHEN ts < '1998-01-01' THEN 1 "
        "WHEN ts < '2000-01-01' THEN 2 ELSE 3 END")).persist()
    for q in range(4):
        quarters.where(F.col("q") == q).drop("q").coalesce(1).write.mode("append").parquet(folder)
    quarters.unpersist()

    def stream():
        return spark.readStream.schema(invoices.schema).option("maxFilesPerTrigger", 1) \
            .parquet(folder)

    return stream


def test_arrival_equals_running_history(spark, invoices, feed, tmp_path):
    tables.run_to_end(
        stream_vendor.stream_arrival_history(feed()).writeStream.outputMode("append")
        .format("parquet").option("path", str(tmp_path / "rows")), str(tmp_path / "cp"))
    got = spark.read.schema(stream_vendor.ARRIVAL_SCHEMA).parquet(str(tmp_path / "rows"))
    assert same(got, vendor.running_history(invoices))


def test_live_enrichment_equals_batch(spark, invoices, feed, tmp_path):
    rows = str(tmp_path / "rows")
    live.run_live_enrichment(
        feed(), str(tmp_path / "log"), rows, str(tmp_path / "cp"), vendor.enrich_vendor)
    want = vendor.enrich_vendor(invoices)
    assert same(want, tables.current_rows(spark, rows, ["invoice_id"], want.schema))
    versions = tables.read_versions(spark, rows, want.schema)
    assert versions.select("_version").distinct().count() == 4
    assert versions.count() > invoices.count()


def test_live_enrichment_retries_are_idempotent(spark, invoices, tmp_path):
    rows = str(tmp_path / "rows")
    step = live.LiveEnrichment(
        str(tmp_path / "log"), rows, vendor.enrich_vendor, invoices.schema)
    half = invoices.where("ts < '1998-01-01'")
    for batch_id, batch in ((0, half), (0, half), (1, invoices.where("ts >= '1998-01-01'"))):
        step(batch, batch_id)
    want = vendor.enrich_vendor(invoices)
    assert same(want, tables.current_rows(spark, rows, ["invoice_id"], want.schema))


def test_all_outputs_on_a_stream_equal_batch(spark, invoices, feed, tmp_path):
    out = str(tmp_path / "out")
    outputs.run_stream(feed(), out, str(tmp_path / "state"))
    tables_ = scoring.build(invoices)
    for name, key in (("autonomous_decisions", "invoice_id"), ("vendor_stats", "vendor_id"),
                      ("realtime_risk_scores", "invoice_id"),
                      ("all_invoices_explained", "invoice_id")):
        want = tables_[name]
        got = jsonl.read_jsonl_latest(spark, f"{out}/{name}.jsonl", want.schema, key)
        assert same(want, got), name


def test_vendor_stats_stream(spark, invoices, feed, tmp_path):
    stream = stream_vendor.stream_vendor_stats(feed())
    tables.run_to_versions(stream, str(tmp_path / "rows"), str(tmp_path / "cp"))
    assert same(vendor.vendor_stats(invoices), tables.current_rows(
        spark, str(tmp_path / "rows"), ["vendor_id"], stream.schema))


def test_velocity_append_closes_windows(spark, invoices, feed, tmp_path):
    stream = stream_vendor.stream_velocity(feed(), watermark="1 hour")
    tables.run_to_end(
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", str(tmp_path / "rows")), str(tmp_path / "cp"))
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "rows"))
    want = vendor.velocity(invoices)
    last = invoices.agg(F.max("ts")).first()[0]
    closed = want.where(F.col("window_end") <= F.lit(last - dt.timedelta(hours=1)))
    assert same(closed, got) and got.count() < want.count()


def test_interval_pairs_equal_batch(spark, invoices, feed, tmp_path):
    stream = pairs.stream_duplicates(feed(), time_window_hours=48, watermark="10000 days")
    tables.run_to_end(
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", str(tmp_path / "rows")), str(tmp_path / "cp"))
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "rows"))
    assert same(similarity.detect_duplicates(invoices, time_window_hours=48), got)


def test_routed_decisions_on_a_stream(spark, feed, invoices, tmp_path):
    out = str(tmp_path / "out")
    scored = feed().withColumn("risk_score", F.col("amount") / 100000.0)
    tables.run_to_end(scored.writeStream.foreachBatch(
        lambda batch, i: sinks.append_decisions(
            batch, f"{out}/all", f"{out}/alerts", batch_id=i)), str(tmp_path / "cp"))
    assert spark.read.json(f"{out}/all").count() == invoices.count()
    assert spark.read.json(f"{out}/alerts").count() == invoices.where("amount >= 60000").count()


def test_jsonl_keeps_the_last_good_version(spark, tmp_path):
    record = {"invoice_id": "A", "timestamp": "2024-01-03T10:00:00", "risk_score": 0.1}
    lines = [json.dumps(record), "", "{broken", json.dumps({**record, "risk_score": 0.9}),
             json.dumps({**record, "invoice_id": "B", "timestamp": "never"})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "log.jsonl")
    rows = {r.invoice_id: r for r in jsonl.read_jsonl_latest(spark, path).collect()}
    assert set(rows) == {"A", "B"} and rows["A"].risk_score == 0.9
    assert rows["A"].ts == dt.datetime(2024, 1, 3, 10) and rows["B"].ts is None
    _, bad = jsonl.read_jsonl(spark, path)
    assert [r.line for r in bad.collect()] == ["{broken"]
    assert jsonl.read_jsonl_latest(spark, str(tmp_path / "missing")).isEmpty()


def test_feed_readers(spark, tmp_path, make):
    inv = make({}, {"invoice_id": "J"}).withColumn(
        "timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).drop("ts")
    inv.write.json(str(tmp_path / "feed"))
    table = src.read_invoices(spark, str(tmp_path / "feed"), "json")
    assert table.where("ts = '2024-01-03 12:00:00'").count() == 2
    stream = src.stream_invoices(
        spark, str(tmp_path / "feed"), "json", max_files_per_trigger=1, glob="*.json")
    tables.run_to_versions(stream, str(tmp_path / "rows"), str(tmp_path / "cp"), "append")
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 2


def test_outputs_are_stored_compressed(spark, invoices, tmp_path):
    rows = invoices.limit(200).select("invoice_id", F.lit(0.9).alias("risk_score"))
    sinks.write_jsonl({"autonomous_decisions": rows}, str(tmp_path / "batch"))
    sinks.write_jsonl({"autonomous_decisions": rows}, str(tmp_path / "stream"), batch_id=3)
    sinks.append_decisions(rows, str(tmp_path / "log/all"), str(tmp_path / "log/alerts"), 0.5, batch_id=0)
    log = SnapshotLog(spark, str(tmp_path / "snapshots"), {"autonomous_decisions": "invoice_id"})
    log.commit({"autonomous_decisions": rows}, 0)
    files = [f for f in tmp_path.rglob("part-*") if f.is_file()]
    assert len({f.relative_to(tmp_path).parts[0] for f in files}) == 4 and all(f.name.endswith(".json.gz") for f in files)
    for back in (spark.read.json(str(tmp_path / "batch/autonomous_decisions.jsonl")),
                 jsonl.read_jsonl_latest(spark, str(tmp_path / "stream/autonomous_decisions.jsonl"), rows.schema),
                 log.read("autonomous_decisions")):
        assert {r.invoice_id for r in back.collect()} == {r.invoice_id for r in rows.collect()}


def test_arrival_takes_plain_rows():
    """One pass over the rows of a vendor: no table is built for it."""
    from types import SimpleNamespace as Obj

    class State:
        now = None

        def get(self):
            return self.now

        def update(self, value):
            self.now = value

    state = State()
    step = stream_vendor.ArrivalHistory()
    step.init(Obj(getValueState=lambda name, schema: state))
    row = lambda i, at, amount, bank: Obj(invoice_id=i, at=at, amount=amount, bank_account=bank)
    got = list(step.handleInputRows(("V",), iter([row("b", 5, 30.0, None), row("c", 5, float("nan"), "B"),
                                                  row("a", None, 10.0, "A")]), None))
    assert [r.invoice_id for r in got] == ["a", "b", "c"] and [r.vendor_total_invoices for r in got] == [1, 2, 3]
    assert [(r.vendor_total_amount, r.vendor_max_amount, r.vendor_min_amount) for r in got][1:] == [(40.0, 30.0, 10.0)] * 2
    assert [r.vendor_last_bank_account for r in got] == ["A", "A", "B"] and got[2].amount is None
    more = list(step.handleInputRows(("V",), iter([row("d", 9, 50.0, "A")]), None))
    assert (more[0].vendor_total_invoices, more[0].vendor_total_amount, more[0].vendor_last_bank_account) == (4, 90.0, "B")


def _state_rows(stream, folder, mode):
    """Rows that the stream's stateful operator holds after all input, which goes to ``folder``."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint") \
        .trigger(availableNow=True).foreachBatch(
            lambda batch, i: batch.write.mode("overwrite").parquet(f"{folder}/rows/_version={i}")).start()
    query.awaitTermination()
    return max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])


def test_velocity_holds_two_state_rows_for_an_invoice(spark, make, tmp_path):
    at = dt.datetime(2024, 1, 3, 12, 32, 1)
    times = [at, at + dt.timedelta(minutes=7), at + dt.timedelta(minutes=61), dt.datetime(1969, 12, 31, 23, 59), None]
    amounts = [10.25, None, 3e15, 1e30, 5.0]
    rows = make(*[{"ts": t, "amount": a, "vendor_id": v} for t in times for a in amounts for v in ("V1", None)])
    rows.repartition(3).write.parquet(f"{tmp_path}/feed")
    feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
    stream = stream_vendor.stream_velocity(feed, watermark=None)
    # three times of two vendors, in two of three blocks each, and one time in two
    assert _state_rows(stream, tmp_path, "update") <= 2 * (3 + 2)
    got = tables.current_rows(spark, f"{tmp_path}/rows", ["vendor_id", "window_start"], stream.schema)
    assert same(vendor.velocity(rows), got)


def test_pairs_hold_few_copies_of_a_row(spark, make, tmp_path):
    day = dt.datetime(2024, 1, 3)
    hours = [*range(0, 30, 3), 40, 63.9, 64, 88, 112.1, 200, 224, 248.01]
    rows = make(*[{"ts": day + dt.timedelta(hours=h)} for h in hours])
    rows.write.parquet(f"{tmp_path}/feed")
    feed = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/feed")
    stream = pairs.stream_duplicates(feed, 0.9, 24, "10000 days")
    assert _state_rows(stream, tmp_path, "append") < 3 * len(hours)
    got = {(r.invoice_id_1, r.invoice_id_2) for r in spark.read.parquet(f"{tmp_path}/rows").collect()}
    assert got == {(f"I{i}", f"I{j}") for i, a in enumerate(hours) for j, b in enumerate(hours)
                   if i != j and abs(a - b) <= 24}


def test_only_what_was_an_alert_is_withdrawn(spark, invoices, feed, tmp_path, monkeypatch):
    out, scratch = str(tmp_path / "out"), []
    monkeypatch.setattr(outputs, "scratch_path", lambda *a: scratch.append(scratch_path(*a)) or scratch[-1])
    outputs.run_stream(feed(), out, str(tmp_path / "state"))
    want = {r.invoice_id for r in scoring.build(invoices)["high_risk_alerts"].collect()}
    for name in ("high_risk_alerts", "explanations"):
        log = spark.read.schema("invoice_id string, active boolean, _batch long").json(f"{out}/{name}.jsonl").collect()
        was = set()
        for b in sorted({r._batch for r in log}):
            assert {r.invoice_id for r in log if r._batch == b and not r.active} <= was
            was |= {r.invoice_id for r in log if r._batch == b and r.active}
        got = jsonl.read_jsonl_latest(spark, f"{out}/{name}.jsonl", T.StructType.fromDDL("invoice_id string"))
        assert {r.invoice_id for r in got.collect()} == want
    assert len(scratch) == 4 and not any(path_exists(spark, p) for p in scratch)
