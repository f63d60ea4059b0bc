"""Exact cosine search by a metric partition.

For unit vectors cos >= t is the same as a distance of at most ``sqrt(2 - 2t)``, the
*reach*. Pivots split the space into cells (a vector belongs to its nearest pivot) and
each cell into rings by the distance to its pivot. Two bounds say where partners of a vector
can be, both exact consequences of the triangle inequality:

* a partner in the cell of pivot p lies in a ring no further than the reach from the
  vector's own distance to p;
* a vector nearer to pivot h than to p is at least
  ``(d(v,p)**2 - d(v,h)**2) / (2 d(p,h))`` away from everything in the cell of p.

Pivots steer only the work: any choice gives the same pairs. They are picked from a
bounded sample of rows, each as far as possible from those before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlynx.session import drop_path, scratch_path

#: Most pivots, and rows they are picked from.
PIVOTS, SAMPLE_ROWS = 256, 8192
#: Regions of others that a row visits on average at most, if there are more than three pivots.
MOST_VISITS = 8
#: Numbers in the vectors of one side of a unit of a search at most, and in how many units either side of
#: a small search is cut. A product takes so many pairs at a time.
SIDE_NUMBERS, SIDES, PRODUCT = 1 << 21, 6, 1 << 20
DECIMALS = 6
_SLACK = 1e-9  # more than the rounding of a distance


def unit_vectors(vectors: pd.Series) -> np.ndarray:
    """Rows scaled to length one; missing, empty and zero vectors become zeros."""
    width = max((len(v) for v in vectors if v is not None), default=0)
    out = np.zeros((len(vectors), max(width, 1)))
    for row, v in enumerate(vectors):
        if v is not None and len(v):
            out[row, :] = v
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def reach_of(threshold: float, decimals: int = DECIMALS) -> float | None:
    """The distance within which all pairs lie whose rounded cosine is at the threshold.
    None where zero vectors, which have no place on the sphere, could match."""
    least = threshold - 10.0 ** -decimals
    return math.sqrt(max(0.0, 2.0 - 2.0 * least)) + _SLACK if least > 0 else None


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Vectors as a table in the shared folder: a model upstream runs once."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def choose_pivots(rows: DataFrame, id_col: str, vector_col: str, count: int = PIVOTS) -> np.ndarray:
    """At most ``count`` unit vectors, each the farthest of a sample from those before it."""
    sample = rows.orderBy(F.xxhash64(id_col)).limit(SAMPLE_ROWS).select(vector_col).toPandas()[vector_col]
    unit = unit_vectors(sample)
    unit = unit[unit.any(axis=1)]
    if not len(unit):
        return np.zeros((0, unit.shape[1]))
    picked = [0]
    near = 1.0 - unit @ unit[0]
    while len(picked) < count and near.max() > _SLACK:
        picked.append(int(near.argmax()))
        near = np.minimum(near, 1.0 - unit @ unit[picked[-1]])
    return unit[picked]


class Partition:
    """Cells and rings for a set of pivots and a reach."""

    def __init__(self, pivots: np.ndarray, reach: float):
        self.pivots, self.reach, self.width = pivots, reach, max(reach, 1e-3)
        self.rings = int(2.0 / self.width) + 2
        self.between = self._distances(pivots)

    def _distances(self, unit: np.ndarray) -> np.ndarray:
        if unit.shape[1] != self.pivots.shape[1]:  # a batch of missing vectors only
            unit = np.zeros((len(unit), self.pivots.shape[1]))
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (unit @ self.pivots.T)))

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances to all pivots, the nearest one, and the cells a partner can be in."""
        d = self._distances(unit)
        home = d.argmin(axis=1)
        nearest = d[np.arange(len(d)), home][:, None]
        possible = d * d - nearest * nearest <= 2.0 * (self.reach + _SLACK) * self.between[home] + _SLACK
        return d, home, possible

    def regions(self, unit: np.ndarray) -> list[np.ndarray]:
        """Per vector its own region (cell and ring as one number), then those regions of a lower
        number in which it can have partners: so each pair meets in exactly one region."""
        d, home, possible = self.cells(unit)
        ring = np.floor(d / self.width).astype(np.int64)
        own = home * self.rings + ring[np.arange(len(d)), home]
        low = np.floor(np.maximum(0.0, d - self.reach - _SLACK) / self.width).astype(np.int64)
        high = np.minimum(np.floor((d + self.reach + _SLACK) / self.width).astype(np.int64), self.rings - 1)
        first = np.arange(len(self.pivots)) * self.rings
        row, region = [np.arange(len(d))], [own]
        for step in range(int((high - low).max(initial=0)) + 1):
            at = low + step
            r, c = np.nonzero(possible & (at <= high) & (first + at < own[:, None]))
            row.append(r)
            region.append(first[c] + at[r, c])
        order = np.argsort(np.concatenate(row), kind="stable")
        sizes = np.bincount(np.concatenate(row), minlength=len(d))
        return np.split(np.concatenate(region)[order].astype(np.int32), np.cumsum(sizes)[:-1])

    def mean_visits(self, unit: np.ndarray) -> float:
        return float(np.mean([len(r) - 1 for r in self.regions(unit)]))

    def regions_column(self, vector: Column) -> Column:
        @F.pandas_udf("array<int>")
        def regions(vectors: pd.Series) -> pd.Series:
            return pd.Series(self.regions(unit_vectors(vectors)) if len(vectors) else [], index=vectors.index)

        return regions(vector)


def partition_for(rows: DataFrame, id_col: str, vector_col: str, threshold: float, part_rows: int,
                  largest: int, pivots: int = PIVOTS) -> Partition | None:
    """A partition of (stored) vectors whose largest block has ``largest`` rows, with two pivots
    for each ``part_rows`` of it, fewer where the reach is so wide that rows would visit more than
    ``MOST_VISITS`` regions on average. None where it would not help."""
    reach = reach_of(threshold)
    count = min(pivots, 2 * -(-largest // part_rows))
    if reach is None:
        return None
    chosen = choose_pivots(rows, id_col, vector_col, count)
    # the last pivots picked are the ones least apart from others
    while len(chosen) > 3 and Partition(chosen, reach).mean_visits(chosen) > MOST_VISITS:
        chosen = chosen[:-(-len(chosen) // 2)]
    return Partition(chosen, reach) if len(chosen) > 1 else None


# ------------------------------------------------------------ stored index

class PivotIndex:
    """A corpus as a table of vectors by cell, with each cell's pivot, size and radii.

    ``build`` writes it once; ``search`` reads only cells that the bounds allow for some
    query, and compares a query only with the cells the bounds allow for it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @staticmethod
    def build(corpus: DataFrame, id_col: str, vector_col: str, folder: str,
              pivots: int = PIVOTS, part_rows: int = 1024) -> PivotIndex:
        """Rows without a vector, and zero vectors, are kept: they match at thresholds up to 0."""
        spark = corpus.sparkSession
        path = scratch_path(spark, "corpus")
        corpus.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec")).write.parquet(path)
        rows = spark.read.parquet(path)
        # two pivots for each part of the corpus: more cells than that cost more than they spare
        chosen = choose_pivots(rows, "id", "vec", min(pivots, max(1, 2 * -(-rows.count() // part_rows))))
        chosen = chosen if len(chosen) else np.zeros((1, chosen.shape[1]))
        cells = Partition(chosen, 2.0)

        @F.pandas_udf("cell int, radius double")
        def place(vectors: pd.Series) -> pd.DataFrame:
            d, home, _ = cells.cells(unit_vectors(vectors))
            return pd.DataFrame({"cell": home, "radius": d[np.arange(len(d)), home]})

        placed = rows.withColumn("at", place("vec")).select("id", "vec", "at.*")
        sizes = placed.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("radius").alias("near"), F.max("radius").alias("far")) \
            .withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int"))
        # plain numbers: sessions without Arrow take no others
        spark.createDataFrame(list(enumerate(chosen.tolist())), "cell int, pivot array<double>").join(sizes, "cell") \
            .coalesce(1).write.parquet(f"{folder}/cells")
        # one row a pivot: PIVOTS at most
        placed.join(F.broadcast(spark.read.parquet(f"{folder}/cells").select("cell", "parts")), "cell") \
            .withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts") \
            .repartition("cell", "part").write.partitionBy("cell").parquet(f"{folder}/vectors")
        drop_path(spark, path)
        return PivotIndex(spark, folder)

    def search(self, queries: DataFrame, query_id: str, vector_col: str, threshold: float,
               part_rows: int = 1024) -> DataFrame:
        """``query_id``, ``match_id`` and ``similarity`` (rounded; the threshold applies to it) of all
        corpus rows at the threshold."""
        cells = self.spark.read.parquet(f"{self.folder}/cells").orderBy("cell").toPandas()  # a row a pivot
        id_type = queries.schema[query_id].dataType
        fields = [T.StructField(query_id, id_type), T.StructField("match_id", id_type),
                  T.StructField("similarity", T.DoubleType())]
        if not len(cells):  # an empty corpus has no table of vectors
            return self.spark.createDataFrame([], T.StructType(fields))
        vectors = self.spark.read.parquet(f"{self.folder}/vectors")
        fields[1] = T.StructField("match_id", vectors.schema["id"].dataType)
        schema = T.StructType(fields)
        asked = stored(queries.select(F.col(query_id).alias("id"), F.col(vector_col).alias("vec")), "queries")
        n_asked = asked.count()
        reach = reach_of(threshold)
        near, far = cells["near"].to_numpy(), cells["far"].to_numpy()
        names = cells["cell"].to_numpy().astype(np.int32)
        space = Partition(np.stack(cells["pivot"]), reach or 2.0)
        # the same number of rows to a side of a unit, as each side is copied to all units of the other
        most = max(part_rows, SIDE_NUMBERS // space.pivots.shape[1])
        rows = min(max(part_rows, -(-max(n_asked, int(cells["n"].sum())) // SIDES)), most)
        first, n_groups = _groups(space, cells["n"].to_numpy(), cells["parts"].to_numpy(), rows)
        n_all = int((first + n_groups).max())
        inside = np.zeros((len(cells), n_all), np.float32)  # which groups have rows of which cell
        for c, (at, n) in enumerate(zip(first, n_groups)):
            inside[c, at:at + n] = 1

        def possible(unit: np.ndarray) -> np.ndarray:
            d, _, found = space.cells(unit)
            if reach is None:
                found[:] = True
            else:
                found &= (d - reach - _SLACK <= far) & (d + reach + _SLACK >= near) & unit.any(axis=1)[:, None]
            return found

        @F.pandas_udf("struct<cells:array<int>,groups:array<int>>")
        def candidates(batch: pd.Series) -> pd.DataFrame:
            found = possible(unit_vectors(batch))
            into = found.astype(np.float32) @ inside > 0
            return pd.DataFrame({"cells": [names[p] for p in found], "groups": [
                np.flatnonzero(p).astype(np.int32) for p in into]}, index=batch.index)

        # vectors go once to each group of cells, and how many go there is counted before: no copy is written for that
        visits = asked.select("id", "vec", candidates("vec").alias("to"))
        counted = visits.select(F.explode(F.concat("to.groups", F.transform("to.cells", lambda c: -1 - c))).alias("to")) \
            .groupBy("to").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a cell and a group at most
        visited = [-1 - r["to"] for r in counted if r["to"] < 0]
        sides = [(r["to"], -(-r["n"] // rows)) for r in counted if r["to"] >= 0]
        groups = F.broadcast(self.spark.createDataFrame(sides, "group int, sides int"))
        where = F.broadcast(self.spark.createDataFrame(
            [(int(c), int(at), int(n), int(p)) for c, at, n, p in zip(names, first, n_groups, cells["parts"])],
            "cell int, first int, n_groups int, parts int"))
        here = visits.select("id", "vec", F.explode("to.groups").alias("group")).join(groups, "group").select(
            "group", F.pmod(F.xxhash64("id"), "sides").cast("int").alias("q"), F.lit(-1).alias("cell"),
            F.col("id").alias("own"), F.lit(None).cast(fields[1].dataType).alias("other"), "vec")
        there = vectors.where(F.col("cell").isin(visited)).join(where, "cell") \
            .withColumn("group", F.expr("first + CAST(part * CAST(n_groups AS BIGINT) DIV parts AS INT)")).join(groups, "group").select(
            "group", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("q"), "cell",
            F.lit(None).cast(id_type).alias("own"), F.col("id").alias("other"), "vec")
        units = here.unionByName(there).repartition(max(1, sum(n for _, n in sides)), "group", "q") \
            .sortWithinPartitions("group", "q", "cell")

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for unit in _whole_units(batches):
                cell = unit["cell"].to_numpy()
                n = int(np.searchsorted(cell, -1, "right"))
                if not 0 < n < len(cell):
                    continue
                a, b = _same_width(*(unit_vectors(unit["vec"].slice(*part).to_pandas()) for part in ((0, n), (n,))))
                own, other = unit["own"].slice(0, n).combine_chunks(), unit["other"].slice(n).combine_chunks()
                for i, j, scores in _at_threshold(a, b, possible(a), np.searchsorted(names, cell[n:]), threshold):
                    yield pa.RecordBatch.from_arrays(
                        [own.take(pa.array(i)), other.take(pa.array(j)), pa.array(scores)], [f.name for f in fields])

        return units.mapInArrow(match, schema)


def _groups(space: Partition, sizes: np.ndarray, parts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first group and how many it has: cells near each other share a group of about ``rows``
    rows, and a cell of more is spread over several."""
    left, at = np.ones(len(sizes), bool), 0
    first, n_groups = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    group, held = -1, rows
    while left.any():
        left[at] = False
        if sizes[at] > rows:
            n_groups[at] = min(int(parts[at]), -(-int(sizes[at]) // rows))
            first[at], held = group + 1, rows
            group += int(n_groups[at])
        else:
            if held + sizes[at] > rows:
                group, held = group + 1, 0
            first[at], held = group, held + int(sizes[at])
        at = int(np.where(left, space.between[at], np.inf).argmin())
    return first, n_groups


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (group, q) of a task, sorted by them."""
    held, last = [], None
    for batch in batches:
        key = batch["group"].to_numpy(zero_copy_only=False).astype(np.int64) << 32 | batch["q"].to_numpy(zero_copy_only=False)
        border = np.flatnonzero(np.diff(key)) + 1
        for a, b in zip([0, *border], [*border, len(key)]):
            if a < b:
                if held and key[a] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = key[a]
    if held:
        yield pa.Table.from_batches(held)


def _at_threshold(a: np.ndarray, b: np.ndarray, possible: np.ndarray, cell: np.ndarray, threshold: float):
    """Row numbers and scores of the pairs at the threshold, of each row of ``a`` with the rows of ``b`` (in the order of
    their cells) whose cell is possible for it. PRODUCT pairs at most are compared at a time."""
    begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    step = 1024
    for p in range(0, len(a), step):
        asked = possible[p:p + step][:, cell[begin]]
        every = asked.all(axis=0)
        # cells that are possible for all of these go on as one
        new = np.append(True, ~(every[1:] & every[:-1]))
        for c, low, high in zip(np.flatnonzero(new), begin[new], np.append(begin[new][1:], len(cell))):
            rows = np.flatnonzero(asked[:, c]) + p
            for q in range(low, high if len(rows) else low, max(1, PRODUCT // step)):
                most = min(q + max(1, PRODUCT // step), high)
                scores = np.round(np.einsum("ik,jk->ij", a[rows], b[q:most], optimize=False), DECIMALS)
                i, j = np.nonzero(scores >= threshold)
                if len(i):
                    yield rows[i], j + q, scores[i, j]


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A side of missing vectors only has no width of its own."""
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.zeros((len(x), width)) for x in (a, b))
