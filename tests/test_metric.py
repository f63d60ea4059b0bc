"""The metric partition and the stored index against brute force, and what they spare."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import same
from ledgerlynx.operators import metric, similarity


def clustered(n, dim=12, members=25, seed=3):
    """Unit vectors around n / members centres."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // members), dim))
    points = centres[np.arange(n) % len(centres)] + rng.normal(scale=0.05, size=(n, dim))
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def frame(spark, unit, block=lambda i: "b"):
    return spark.createDataFrame(
        [(i, block(i), v.tolist()) for i, v in enumerate(unit)], "id long, block string, vec array<double>")


@pytest.mark.parametrize("threshold", [0.999, 0.95, 0.7, 0.3, 0.05])
@pytest.mark.parametrize("make", [clustered, lambda n: clustered(n, 3, n), lambda n: clustered(n, 30, 1)])
def test_each_pair_meets_once(make, threshold):
    unit = make(300)
    unit = np.concatenate([unit, unit[:40], np.zeros((2, unit.shape[1]))])
    partition = metric.Partition(unit[np.random.default_rng(1).permutation(300)[:9]], metric.reach_of(threshold))
    places = partition.regions(unit)
    assert all(len(set(p.tolist())) == len(p) for p in places)
    near = np.argwhere(np.triu(np.round(unit @ unit.T, 6) >= threshold, 1))
    for a, b in near:
        own_a, own_b = places[a][0], places[b][0]
        meetings = (own_a in places[b]) + (own_b in places[a] and own_a != own_b)
        assert meetings == 1, (a, b)


def test_no_bound_where_zero_vectors_match():
    assert metric.reach_of(0.0) is None and metric.reach_of(-0.5) is None
    assert metric.reach_of(1.0) > 0


@pytest.mark.parametrize("threshold", [0.97, 0.8])
def test_pairs_equal_plain_pairs(spark, threshold):
    unit = clustered(600)
    unit[::50] = 0.0
    unit[1:90:3] = unit[1]  # one vector in many rows
    rows = frame(spark, unit, lambda i: None if i % 3 == 0 else "hot" if i % 3 == 1 else f"b{i % 40}") \
        .withColumn("amount", F.col("id") * 2.0)
    args = (rows, "id", "vec", threshold, "block", ["amount"])
    split = similarity.similar_pairs(*args, part_rows=20)
    plain = similarity.similar_pairs(*args, part_rows=20, pivots=0)
    assert plain.count() > 100 and same(plain, split)
    best = [similarity.best_matches(rows, "id", "vec", threshold, "block", 20, all_ids=True, pivots=p) for p in (0, 64)]
    assert best[0].count() == 600 and same(*best)


def test_comparisons_grow_with_the_clusters(spark):
    found = []
    for n in (1500, 3000):
        rows = frame(spark, clustered(n, dim=24))
        r = similarity.comparisons(rows, "id", "vec", 0.9, "block", part_rows=32).first()
        assert r.n_rows == n and r.n_pairs == n * (n - 1) // 2
        found.append(r.n_compared)
    # twice the rows: four times the pairs, but about twice the comparisons
    assert found[1] < 0.2 * r.n_pairs and found[1] < 2.8 * found[0]
    small = similarity.comparisons(rows, "id", "vec", 0.9, "block", part_rows=5000).first()
    assert small.n_compared == small.n_pairs


def brute(queries, corpus, threshold):
    out = set()
    for i, q in queries:
        for j, c in corpus:
            a, b = (np.zeros(1) if v is None else np.array(v) for v in (q, c))
            score = 0.0
            if a.any() and b.any():
                score = round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6)
            if score >= threshold:
                out.add((i, j, score + 0.0))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    unit = clustered(260, dim=6, members=20)
    rows = [(i, (v * (1 + i % 3)).tolist()) for i, v in enumerate(unit)] + [(900, None), (901, [0.0] * 6)]
    return rows, spark.createDataFrame(rows, "id long, vec array<double>")


@pytest.mark.parametrize("threshold", [0.99, 0.6, -0.2])
def test_index_equals_brute_force(spark, corpus, tmp_path, threshold):
    rows, df = corpus
    index = metric.PivotIndex.build(df, "id", "vec", str(tmp_path / "index"), pivots=8, part_rows=7)
    got = index.search(df, "id", "vec", threshold, part_rows=9)
    assert {(r.id, r.match_id, round(r.similarity, 6) + 0.0) for r in got.collect()} == brute(rows, rows, threshold)


def test_index_is_stored_and_read_by_cell(spark, corpus, tmp_path):
    rows, df = corpus
    folder = str(tmp_path / "index")
    metric.PivotIndex.build(df, "id", "vec", folder, pivots=10, part_rows=50)
    again = metric.PivotIndex(spark, folder)  # the corpus is not needed any more
    few = spark.createDataFrame(rows[5:6], "id long, vec array<double>")
    got = similarity.find_similar(few, df.limit(0), "id", "id", "vec", 0.97, 50, index=again)
    assert {(r.id, r.match_id) for r in got.collect()} == {(i, j) for i, j, _ in brute(rows[5:6], rows, 0.97)}
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    cells = again.spark.read.parquet(f"{folder}/vectors").select("cell").distinct().count()
    asked = re.search(r"cell#\d+ IN \(([\d,]+)\)|cell#\d+ = (\d+)\)", plan)
    assert cells == 10 and len((asked[1] or asked[2]).split(",")) < 5


def test_empty_sides(spark, corpus, tmp_path):
    _, df = corpus
    index = metric.PivotIndex.build(df.limit(0), "id", "vec", str(tmp_path / "none"))
    assert index.search(df, "id", "vec", 0.5).count() == 0
    index = metric.PivotIndex.build(df, "id", "vec", str(tmp_path / "some"))
    assert index.search(df.limit(0), "id", "vec", 0.5).count() == 0
    assert metric.unit_vectors(pd.Series([None, []])).tolist() == [[0.0], [0.0]]


def test_index_in_a_session_without_arrow(spark, corpus, tmp_path):
    rows, df = corpus
    key = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        index = metric.PivotIndex.build(df, "id", "vec", str(tmp_path / "index"), pivots=8, part_rows=7)
        got = index.search(df, "id", "vec", 0.99, part_rows=9).collect()
    finally:
        spark.conf.set(key, before)
    assert {(r.id, r.match_id, round(r.similarity, 6) + 0.0) for r in got} == brute(rows, rows, 0.99)


def test_small_parts_share_tasks(spark):
    rows = frame(spark, clustered(800), lambda i: f"b{i % 20}")
    plain = similarity._units(rows, "id", "vec", F.col("block"), (), 4, None, None)
    partition = metric.partition_for(rows, "id", "vec", 0.9, 4, 40)
    split = similarity._units(rows, "id", "vec", F.col("block"), (), 4, None, None, partition)
    for units in (plain, split):
        assert units.select("__task").distinct().count() <= 1 + 2 * units.count() // similarity.TASK_ROWS


def test_wide_reach_does_not_copy_rows_everywhere(spark):
    unit = clustered(1500, dim=64, members=1)  # far apart: most regions are within the reach
    rows = frame(spark, unit)
    partition = metric.partition_for(rows, "id", "vec", 0.25, 16, 1500)
    units = similarity._units(rows, "id", "vec", F.col("block"), (), 16, None, None, partition)
    assert units.count() < 100 * len(unit)
    near = np.argwhere(np.triu(np.round(unit @ unit.T, 6) >= 0.25, 1))
    got = similarity.similar_pairs(rows, "id", "vec", 0.25, "block", part_rows=16, both_directions=False)
    assert {(r.id_a, r.id_b) for r in got.collect()} == {(a, b) for a, b in near.tolist()}


def test_search_writes_no_copies_of_vectors(spark, tmp_path):
    from pathlib import Path

    from ledgerlynx.session import shared_folder

    unit = clustered(1500, dim=64, members=1)  # far apart: a vector's partners can be in most cells
    rows = frame(spark, unit).drop("block")
    kept = set(Path(shared_folder(spark)).iterdir())
    index = metric.PivotIndex.build(rows, "id", "vec", str(tmp_path / "index"), part_rows=16)
    found = index.search(rows, "id", "vec", 0.25, part_rows=16)
    near = np.argwhere(np.round(unit @ unit.T, 6) >= 0.25)
    assert {(r.id, r.match_id) for r in found.collect()} == {(a, b) for a, b in near.tolist()}
    new = [p for folder in set(Path(shared_folder(spark)).iterdir()) - kept for p in folder.rglob("*.parquet")]
    assert sum(p.stat().st_size for p in new) < 2 * unit.nbytes


@pytest.mark.parametrize("rows", [3, 40, 1000])
def test_groups_hold_all_cells_once(rows):
    rng = np.random.default_rng(2)
    space = metric.Partition(clustered(30, 5, 3), 0.5)
    sizes = rng.integers(1, 100, 30)
    parts = -(-sizes // 5)
    first, n = metric._groups(space, sizes, parts, rows)
    alone = sizes > rows
    assert (n[~alone] == 1).all() and (n[alone] == np.minimum(parts, -(-sizes // rows))[alone]).all()
    held = np.bincount(first[~alone], weights=sizes[~alone], minlength=int((first + n).max()))
    assert held.max() <= rows and not held[first[alone]].any()
    assert len({g for f, k in zip(first[alone], n[alone]) for g in range(f, f + k)}) == n[alone].sum()
