"""Skewed keys, split blocks, plans and duplicates of one text."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import same
from ledgerlynx.functions.skew import attach_by_key, heavy_keys
from ledgerlynx.functions.text import fixed, float_text
from ledgerlynx.operators import duplicates, risk, similarity, vendor
from ledgerlynx.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of all rows; one key is NULL."""
    return spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL "
        "ELSE concat('k', id % 97) END AS k")


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_attach_splits_heavy_keys(skewed, how, null_safe):
    sizes = skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    heavy = heavy_keys(sizes, ["k"], "n", heavy_rows=100)
    assert heavy.first()["__splits"] == 10 and heavy.count() == 1
    got = attach_by_key(skewed, sizes, ["k"], "n", "id", how, heavy_rows=100, null_safe=null_safe)
    per_key = sizes.withColumnRenamed("k", "kk")
    want = skewed.join(per_key, F.expr("k <=> kk" if null_safe else "k = kk"), how).drop("kk")
    assert same(want, got)


def test_heavy_keys_are_bounded(skewed):
    sizes = skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert heavy_keys(sizes, ["k"], "n", heavy_rows=1, heavy_share=5).count() < 5


def brute_force(rows, threshold, window=None):
    """Ordered pairs by comparing everything with everything."""
    out = {}
    for a, ka, va, ta in rows:
        for b, kb, vb, tb in rows:
            if ka != kb or a == b or (window is not None and abs(ta - tb) > window):
                continue
            la, lb = np.linalg.norm(va), np.linalg.norm(vb)
            s = round(float(np.dot(va, vb) / (la * lb)), 6) if la and lb else 0.0
            if s >= threshold:
                out[a, b] = s
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        v = rng.normal(size=4).round(2).tolist()
        if i % 17 == 0:
            v = [0.0] * 4
        rows.append((f"v{i:03d}", "hot" if i % 3 == 0 else f"b{i % 7}", v, int(rng.integers(0, 90))))
    rows += [(f"c{i:03d}", "hot", [1.0, 2.0, 3.0, 4.0], i) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, block string, vec array<double>, t int") \
        .selectExpr("id", "block", "vec", "t", "timestamp_seconds(t) AS ts")
    return rows, df


@pytest.mark.parametrize("part_rows", [7, 1024])
@pytest.mark.parametrize("window", [None, 10])
def test_pairs_equal_brute_force(vectors, part_rows, window):
    rows, df = vectors
    got = similarity.similar_pairs(
        df, "id", "vec", 0.8, "block", ["t"], ts_col="ts", window_seconds=window,
        part_rows=part_rows).collect()
    want = brute_force(rows, 0.8, window)
    assert len(got) == len(want)
    assert {(r.id_a, r.id_b): r.similarity for r in got} == want
    times = {r[0]: r[3] for r in rows}
    assert all((r.t_a, r.t_b) == (times[r.id_a], times[r.id_b]) for r in got)


@pytest.mark.parametrize("part_rows", [7, 1024])
def test_best_matches_equal_brute_force(vectors, part_rows):
    rows, df = vectors
    want = {}
    for (a, b), s in brute_force(rows, 0.8).items():
        if a not in want or (-s, b) < want[a]:
            want[a] = (-s, b)
    got = {r.id: (-r.similarity, r.other_id) for r in similarity.best_matches(
        df, "id", "vec", 0.8, "block", part_rows).collect()}
    assert got == want


def test_no_unit_grows_with_its_block(vectors):
    _, df = vectors
    units = similarity._units(df, "id", "vec", F.col("block"), (), 8, None, None)
    biggest = units.where("__block = 'hot'").groupBy("__task", *similarity._UNIT).count()
    assert biggest.agg(F.max("count")).first()[0] < 8 * 6


@pytest.mark.parametrize("part_rows", [16, 1024])
def test_find_similar_equals_brute_force(vectors, part_rows):
    rows, df = vectors
    got = similarity.find_similar(df, df, "id", "id", "vec", 0.9, part_rows).collect()
    want = brute_force([(i, 0, v, t) for i, _, v, t in rows], 0.9)
    assert {(r.id, r.match_id): r.similarity for r in got if r.id != r.match_id} == want
    assert [(r.id, -r.similarity, r.match_id) for r in got] == sorted(
        (r.id, -r.similarity, r.match_id) for r in got)


def test_approximate_pairs_are_a_subset(vectors):
    rows, df = vectors
    want = brute_force(rows, 0.8)
    got = {(r.id_a, r.id_b): r.similarity for r in similarity.similar_approx(
        df, "id", "vec", 0.8, "block", bucket_length=1.0, part_rows=16).collect()}
    assert got.items() <= want.items() and len(got) > 0.5 * len(want)


def test_semantic_enrichment_of_copies(make):
    copies = [dict(invoice_id=f"C{i}", description="same", amount=5.0) for i in range(9)]
    out = similarity.enrich_semantic(make(
        *copies, dict(invoice_id="X", vendor_id="V2")), 1.0, part_rows=2).collect()
    match = {r.invoice_id: r.duplicate_invoice_id for r in out}
    assert match.pop("X") == "" and match.pop("C0") == "C8" and set(match.values()) == {"C0"}
    assert len(out) == 10


def test_float_text(spark):
    values = [0.0, 100.0, 12345.6, 1e7, 12345678.25, 123456789012.5, 0.0005, 2.5, -3e7]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.t for r in df.select(float_text(F.col("v")).alias("t")).collect()]
    assert got == [str(v) for v in values]
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double")
    assert [r.t for r in halves.select(fixed(F.col("v"), 0).alias("t")).collect()] == [
        f"{v:.0f}" for v in (0.5, 1.5, 2.5)]


PLAIN = ["enrich_vendor", "exact_duplicates", "decisions", "explain_audit", "arrival_history",
         "velocity", "composite_risk", "anomalies_prior", "registry_risk", "risk_trend_7d"]


@pytest.mark.parametrize("name", PLAIN)
def test_plans_stay_on_the_jvm(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "NestedLoopJoin"):
        assert node not in plan


def test_columns_are_pruned(spark, folder):
    # another folder than the one other tests have cached
    plan = QUERIES["category_patterns"](spark, "/root/testdata/sf0.01")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "o_orderpriority" not in plan and "c_name" not in plan


def test_windows_never_span_a_vendor_of_rows(invoices):
    """Row-level windows are partitioned by vendor and chunk of time."""
    plan = vendor.running_history(invoices)._jdf.queryExecution().executedPlan().toString()
    spans = [line for line in plan.splitlines() if "Window [" in line]
    assert spans and all("__chunk" in line for line in spans)


@pytest.mark.parametrize("grain", ["minute", "hour", "month"])
def test_running_history_does_not_depend_on_the_grain(invoices, grain):
    assert same(vendor.running_history(invoices, bank_rule="previous"),
                vendor.running_history(invoices, bank_rule="previous", grain=grain))


def test_duplicates_of_many_copies(make):
    inv = make(*[dict(invoice_id=f"I{i:03d}") for i in range(120)], dict(invoice_id="X", amount=1.0))
    out = {r.invoice_id: r for r in duplicates.exact_duplicates(inv).collect()}
    assert out["I050"].duplicate_count == 120 and out["I050"].duplicate_group_total == 12060.0
    assert out["X"].is_duplicate is False and out["X"].first_invoice_id == "X"


def test_duplicate_info_may_repeat_an_invoice(make, spark):
    inv = make({}, {})
    info = spark.createDataFrame([("I0",), ("I0",)], "invoice_id string")
    out = risk.join_left_dup_flag(inv, info).select("invoice_id", "is_duplicate").collect()
    assert sorted(map(tuple, out)) == [("I0", True), ("I1", False)]


def test_approximate_pairs_leave_one_table_only(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, "b", (v / 10 + 1).tolist()) for i, v in enumerate(rng.normal(size=(60, 5)))]  # near: equal in most tables
    df = spark.createDataFrame(rows + [(7, "b", rows[7][2])], "id long, block string, vec array<double>")
    left = []
    pairs = similarity.similar_pairs
    monkeypatch.setattr(similarity, "similar_pairs", lambda *a, **k: left.append(pairs(*a, **k)) or left[-1])
    got = similarity.similar_approx(df, "id", "vec", 0.9, "block", bucket_length=1.0, part_rows=8)
    found = {(r.id_a, r.id_b) for r in got.collect()}
    assert len(found) == got.count() and {(b, a) for a, b in found} == found
    once = left[0].collect()
    assert len([r for r in once if 7 not in (r.id_a, r.id_b)]) == len(
        {(r.id_a, r.id_b) for r in once if 7 not in (r.id_a, r.id_b)}) > 1000


def test_large_parts_leave_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(90, 4))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, "b", v.tolist()) for i, v in enumerate(unit)], "id long, block string, vec array<double>")
    monkeypatch.setattr(similarity, "SMALL_UNIT", 10)
    monkeypatch.setattr(similarity, "PRODUCT", 200)
    pdf = similarity._units(rows, "id", "vec", F.col("block"), (), 40, None, None).toPandas()
    pdf["__unit"] = pdf.groupby(similarity._UNIT, sort=False, dropna=False).ngroup()
    pdf = pdf.sort_values(["__unit", "__side"], kind="stable").reset_index(drop=True)
    ids, got, most = pdf["__id"].to_numpy(), [], 0
    for a, b, _ in similarity._scored_pairs(pdf, np.stack(pdf["__vec"]), -2.0):
        got += [tuple(sorted(p)) for p in zip(ids[a].tolist(), ids[b].tolist())]
        most = max(most, len(a))
    assert most <= 200 and sorted(got) == [(i, j) for i in range(90) for j in range(i + 1, 90)]
