"""Near duplicates: n-gram Jaccard join through a MinHash LSH forest, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlynx.llm.common import dropped, give_back_memory, written
from ledgerlynx.llm.components import components
from ledgerlynx.llm.tokens import mixed, shingles, slices, words

#: Words of a shingle, the similarity of a link, tries of the forest, their deepest
#: prefix, and the share of links at exactly the threshold that must be found.
SHINGLE, THRESHOLD, TREES, DEEPEST, RECALL = 5, 0.8, 16, 8, 0.998
#: Members of a group that are compared with each other in one unit of work.
PART = 512
SLICE = 1 << 20


def expected_recall(depth: int, trees: int = TREES, similarity: float = THRESHOLD) -> float:
    """Chance that two texts of that similarity share a prefix of ``depth`` in some trie."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(recall: float = RECALL, trees: int = TREES, deepest: int = DEEPEST,
                 similarity: float = THRESHOLD) -> int:
    """Shortens the matched prefix from ``deepest`` until the recall is reached."""
    depth = deepest
    while depth > 1 and expected_recall(depth, trees, similarity) < recall:
        depth -= 1
    return depth


def _signer(k: int, trees: int, depth: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = mixed(np.arange(1, trees * depth + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            rows, texts = batch["row"].to_numpy(), list(batch["text"])
            for a, b in slices(texts, SLICE):
                grams, first = shingles(words(texts[a:b]), k)
                grown = np.flatnonzero(np.diff(first))  # texts with words
                if not len(grown):
                    continue
                starts = first[:-1][grown]
                labels = np.zeros((len(grown), trees), np.uint64)
                for i, seed in enumerate(seeds):
                    low = np.minimum.reduceat(mix_light(grams, seed), starts)
                    tree = i // depth
                    labels[:, tree] = mixed(labels[:, tree] * np.uint64(0x9E3779B97F4A7C15) + low + np.uint64(tree))
                yield pd.DataFrame({
                    "row": rows[a:b][grown],
                    "content": _set_hash(grams, first)[grown].view(np.int64),
                    "labels": list(labels.view(np.int64))})
        give_back_memory()
    return sign


def mix_light(x: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A different order of the same numbers for each odd ``seed``: x are spread already."""
    y = x * seed
    y ^= y >> np.uint64(29)
    return y


def _set_hash(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each text's set of shingles."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((grams, owner))
    g, o = grams[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    out = np.zeros(len(first) - 1, np.uint64)
    np.add.at(out, o[new], mixed(g[new] ^ np.uint64(0x5851F42D4C957F2D)))
    return out + np.bincount(o[new], minlength=len(out)).astype(np.uint64)


def _sets(k: int):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, texts = batch["row"].to_numpy(), list(batch["text"])
            for a, b in slices(texts, SLICE):
                grams, first = shingles(words(texts[a:b]), k)
                yield pd.DataFrame({"row": rows[a:b], "grams": [
                    np.unique(grams[x:y]).view(np.int64).tobytes() for x, y in zip(first[:-1], first[1:])]})
        give_back_memory()
    return make


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i of ``a``, j of ``b``) with shared shingles and how many, by one sort of ``b``."""
    b_all = np.concatenate(b)
    b_of = np.repeat(np.arange(len(b)), [len(x) for x in b])
    order = np.argsort(b_all, kind="stable")
    b_all, b_of = b_all[order], b_of[order]
    left, right, n = [], [], []
    for i, grams in enumerate(a):
        low, high = np.searchsorted(b_all, grams, "left"), np.searchsorted(b_all, grams, "right")
        span = high - low
        if not span.any():
            continue
        at = np.repeat(low - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
        shared = np.bincount(b_of[at], minlength=len(b))
        j = np.flatnonzero(shared)
        left.append(np.full(len(j), i))
        right.append(j)
        n.append(shared[j])
    if not left:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(left), np.concatenate(right), np.concatenate(n)


def _verifier(threshold: float):
    """Compares the two parts of each unit. A pair counts in the first trie whose
    prefix both share, so never twice. Per member the number of links (and of rows
    behind them), and one link for each merge of two sets of linked members."""
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit in _units(batches):
            second = unit["side"] == 1
            same = not second.any()
            a = np.flatnonzero(~second)
            b = a if same else np.flatnonzero(second)
            if not len(a) or len(b) < 1 + same:
                continue
            sets = [np.frombuffer(x, np.int64) for x in unit["grams"]]
            size = np.array([len(x) for x in sets])
            i, j, shared = _common([sets[x] for x in a], [sets[x] for x in b])
            i, j = a[i], b[j]
            linked = shared >= threshold * (size[i] + size[j] - shared) - 1e-9
            if same:
                linked &= i < j
            i, j = i[linked], j[linked]
            if not len(i):
                continue
            labels = np.stack(unit["labels"])
            earlier = np.zeros(len(i), bool)
            for tree in range(unit["tree"][0]):
                earlier |= labels[i, tree] == labels[j, tree]
            i, j = i[~earlier], j[~earlier]
            if not len(i):
                continue
            row, copies = unit["row"], unit["copies"]
            near, at = np.unique(np.concatenate([row[i], row[j]]), return_inverse=True)
            x, y = at[:len(i)], at[len(i):]
            links = np.bincount(at)
            rows = np.bincount(at, weights=np.concatenate([copies[j], copies[i]])).astype(np.int64)
            yield pd.DataFrame({"row": near, "links": links, "link_rows": rows, "root": near[_roots(near, x, y)]})
        give_back_memory()
    return verify


def _roots(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position of each connected set of positions."""
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of each run of equal ``unit`` in rows that are sorted by it."""
    held: list[dict[str, np.ndarray]] = []
    key = None
    for batch in batches:
        if not len(batch):
            continue
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        unit = columns["unit"]
        cuts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]]))
        for x, y in zip(cuts[:-1], cuts[1:]):
            if held and unit[x] != key:
                yield _joined(held)
                held = []
            key = unit[x]
            held.append({c: v[x:y] for c, v in columns.items()})
    if held:
        yield _joined(held)


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def jaccard_join(rows: DataFrame, text: Column, k: int = SHINGLE, threshold: float = THRESHOLD,
                 trees: int = TREES, recall: float = RECALL, part: int = PART) -> DataFrame:
    """``row, class_row, text_row, n_links, n_texts`` for each of ``rows(row, ...)``.

    Two texts are linked when their sets of ``k``-word shingles (A-Z as a-z) have a
    Jaccard similarity of ``threshold`` or more. ``class_row`` is the least row of a
    row's connected class, ``text_row`` the least row with the same set of
    shingles, ``n_texts`` the number of different linked texts and ``n_links`` the
    number of other rows that are linked, copies included. A text of fewer words
    is one shingle; texts without words (null, empty) are in no class but their
    own and have no links.

    Candidates share a prefix of the sorted signature in one of ``trees`` tries; the
    prefix is the longest that reaches ``recall`` for a link at the threshold.
    Every candidate pair is verified on the full sets. Copies are one text, tries
    that show the same group again count once, and a group of any size is cut
    into parts whose pairs are units of work for many tasks: no pair is written.
    """
    depth = prefix_depth(recall, trees, DEEPEST, threshold)
    read = rows.select("row", text.alias("text"))
    signed = written(read.mapInPandas(_signer(k, trees, depth), "row long, content long, labels array<long>"),
                     "forest-signed")
    texts = signed.groupBy("content").agg(F.min("row").alias("text_row"), F.count(F.lit(1)).alias("copies"))
    texts = written(texts, "forest-texts")
    one = texts.select(F.col("text_row").alias("row"), "copies").join(signed.select("row", "labels"), "row")
    leaves = written(one.select("row", "copies", F.posexplode("labels").alias("tree", "label")), "forest-leaves")

    # of groups with the same members the one of the first trie is kept
    whole = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.col("row").cast("decimal(38,0)")).alias("sum"),
                     F.bit_xor(F.xxhash64("row")).alias("xor"))
    groups = leaves.groupBy("tree", "label").agg(whole.alias("whole")).where("whole.n > 1")
    first = groups.groupBy("whole").agg(F.min(F.struct("tree", "label")).alias("first")) \
        .select("first.tree", "first.label", F.col("whole.n").alias("n"))
    first = written(first.withColumn("grp", F.monotonically_increasing_id()), "forest-groups")
    members = leaves.join(first, ["tree", "label"]).select("grp", "tree", "row", "copies", "n")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / part)).cast("int")
    members = written(members.withColumn("parts", parts).withColumn(
        "part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")), "forest-members")

    involved = members.select("row").distinct()
    needed = read.join(involved, "row")
    payload = written(needed.mapInPandas(_sets(k), "row long, grams binary")
                      .join(signed.select("row", "labels"), "row"), "forest-sets")
    # unit (p, q), p <= q: part p meets part q
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    unit = members.withColumn("other", F.explode(others)) \
        .withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")) \
        .withColumn("side", (F.col("part") != F.col("low")).cast("int")) \
        .withColumn("unit", F.xxhash64("grp", "low", "high"))
    work = unit.join(payload, "row").select("unit", "side", "tree", "row", "copies", "labels", "grams")
    found = work.repartition("unit").sortWithinPartitions("unit").mapInPandas(
        _verifier(threshold), "row long, links long, link_rows long, root long")
    found = written(found, "forest-links")
    dropped(leaves, first, members, payload)
    classes = components(found.select(F.col("row").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("row").agg(F.sum("links").alias("n_texts"), F.sum("link_rows").alias("link_rows"))
    per_text = texts.join(linked, F.col("text_row") == F.col("row"), "left").drop("row") \
        .join(classes.withColumnRenamed("node", "text_row"), "text_row", "left") \
        .select("content", "text_row", F.coalesce("class", "text_row").alias("class_row"),
                F.coalesce("n_texts", F.lit(0).cast("long")).alias("n_texts"),
                (F.coalesce("link_rows", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"))
    per_text = written(per_text, "forest-classes")
    with_words = signed.select("row", "content").join(per_text, "content") \
        .select("row", "class_row", "text_row", "n_links", "n_texts")
    none = F.lit(0).cast("long")
    return rows.select("row").join(with_words, "row", "left").select(
        "row", F.coalesce("class_row", "row").alias("class_row"), F.coalesce("text_row", "row").alias("text_row"),
        F.coalesce("n_links", none).alias("n_links"), F.coalesce("n_texts", none).alias("n_texts"))
