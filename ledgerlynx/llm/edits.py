"""Token counts that follow edits: a segment tree of pre-token runs per document."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The public byte-level vocabulary and the pattern that splits text before its merges (fixed values).
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens of a leaf, and entries of a task's memory of pre-token lengths.
LEAF, REMEMBERED = 64, 1 << 19

TREE = "struct<ends:array<int>,sums:array<bigint>>"
EDITS = "array<struct<start:int,end:int,text:string>>"


class Counter:
    """Tokens of a pre-token. Merges never cross pre-tokens, so counts add up."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.pieces = regex.compile(pattern).finditer
        self.split = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def __call__(self, pieces: list[str]) -> int:
        total, known = 0, self.known
        for p in pieces:
            n = known.get(p)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = known[p] = len(self.encode(p))
            total += n
        return total


def grown(counts: list[int]) -> np.ndarray:
    """A segment tree: node 1 is the whole, node i has the children 2i and 2i + 1, leaves are last."""
    size = 1 << max(0, (len(counts) - 1).bit_length())
    sums = np.zeros(2 * size, np.int64)
    sums[size:size + len(counts)] = counts
    while size > 1:
        sums[size // 2:size] = sums[size:2 * size:2] + sums[size + 1:2 * size:2]
        size //= 2
    return sums


def set_leaf(sums: np.ndarray, leaf: int, count: int) -> None:
    """Change one leaf and the sums above it."""
    node = len(sums) // 2 + leaf
    change = count - sums[node]
    while node:
        sums[node] += change
        node //= 2


def leaves_of(text: str, counter: Counter) -> tuple[list[int], list[int]]:
    """Ends (code points) and token counts of the runs of LEAF pre-tokens of ``text``."""
    pieces = counter.split(text)
    ends, counts, at = [], [], 0
    for i in range(0, len(pieces), LEAF):
        run = pieces[i:i + LEAF]
        at += sum(map(len, run))
        ends.append(at)
        counts.append(counter(run))
    return ends, counts


def in_order(edits: list[tuple[int, int, str]], size: int) -> list[tuple[int, int, str]]:
    """Edits of a text of ``size`` code points by start, then end, then place in the list, inside the
    text. One that begins before an earlier one ends is cut to begin there, so all new texts
    appear, in this order, and nothing is replaced twice."""
    out, at = [], 0
    for start, end, new in sorted(edits, key=lambda e: e[:2]):
        start = max(at, min(start, size))
        at = max(start, min(end, size))
        out.append((start, at, new))
    return out


def edited(text: str, ends: list[int], sums: np.ndarray, edits: list[tuple[int, int, str]],
           counter: Counter) -> tuple[str, list[int], np.ndarray, int]:
    """The text, its tree, and how many code points were split and encoded anew.

    Edits are ranges of the old text, made disjoint by ``in_order`` and applied from the last
    to the first so earlier positions stay. Where a pre-token ends depends on the
    text from its start to two characters past its end (a blank given up before a word,
    the letters of 're), so splitting starts anew at the leaf that holds the second
    character before the edit, and stops at the
    first old leaf border behind the edit at which a new pre-token starts.
    """
    size = len(sums) // 2
    counts = sums[size:size + len(ends)].tolist()
    anew = 0
    for start, end, new in reversed(in_order(edits, len(text))):
        text = text[:start] + new + text[end:]
        shift = len(new) - (end - start)
        first = int(np.searchsorted(ends, start - 2, "right")) if start > 1 else 0
        first = min(first, len(ends))
        begin = ends[first - 1] if first else 0
        behind = int(np.searchsorted(ends, end, "left"))  # first old border at or behind the edit
        borders = {e + shift: i for i, e in enumerate(ends[behind:], behind)}
        pieces: list[str] = []
        stop, last = len(text), len(ends)
        for m in counter.pieces(text, begin):
            at = m.start()
            # a border counts once the edited text lies wholly before it
            if at >= start + len(new) and at in borders and at > begin:
                stop, last = at, borders[at] + 1
                break
            pieces.append(m.group())
        anew += stop - begin
        new_ends, new_counts, at = [], [], begin
        for i in range(0, len(pieces), LEAF):
            run = pieces[i:i + LEAF]
            at += sum(map(len, run))
            new_ends.append(at)
            new_counts.append(counter(run))
        tail = [e + shift for e in ends[last:]]
        same_shape = len(new_ends) == last - first
        ends = ends[:first] + new_ends + tail
        counts[first:last] = new_counts
        if same_shape:
            for i, c in enumerate(new_counts, first):
                set_leaf(sums, i, c)
        else:
            sums = grown(counts)  # other leaves move: their counts are kept, nothing is encoded
    return text, ends, sums, anew


def _shared(spark: SparkSession, ranks: str):
    with open(ranks, "rb") as f:  # a vocabulary file of fixed size, on the driver
        return spark.sparkContext.broadcast(f.read())


def with_trees(rows: DataFrame, text: Column, ranks: str = RANKS) -> DataFrame:
    """``rows`` with ``tree``: the ends of each document's leaves and the sums of its segment
    tree; ``tree.sums[1]`` is the number of tokens. A null text has an empty tree with sum 0."""
    shared = _shared(rows.sparkSession, ranks)

    @F.pandas_udf(TREE)
    def build(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Counter(shared.value)
        for part in parts:
            trees = [leaves_of(t or "", counter) for t in part]
            yield pd.DataFrame({"ends": [e for e, _ in trees], "sums": [grown(c) for _, c in trees]})

    return rows.withColumn("tree", build(text))


def apply_edits(rows: DataFrame, text: Column, edits: Column, ranks: str = RANKS) -> DataFrame:
    """``rows`` (with ``tree``) and ``edited``: the new ``text``, its ``tree`` and the number
    of code points encoded anew. ``edits``: see EDITS; null, and one without start or end, is no
    edit, a null replacement is empty; ranges beyond the text end at its end. Insertions at one place
    appear in the order of the list; for ranges that overlap see ``in_order``."""
    shared = _shared(rows.sparkSession, ranks)

    @F.pandas_udf(f"text string, tree {TREE}, encoded_anew int")
    def update(parts: Iterator[tuple[pd.Series, pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        counter = Counter(shared.value)
        for texts, trees, changes in parts:
            out = {"text": [], "tree": [], "encoded_anew": []}
            for t, ends, sums, change in zip(texts, trees["ends"], trees["sums"], changes):
                # Arrow may hand numbers over as floats where others are null
                todo = [(int(e["start"]), int(e["end"]), e["text"] or "") for e in (change if change is not None else [])
                        if e is not None and pd.notna(e["start"]) and pd.notna(e["end"])]
                new, ends, sums, anew = edited(t or "", list(ends), np.array(sums), todo, counter)
                out["text"].append(new if t is not None or new else None)
                out["tree"].append({"ends": ends, "sums": sums})
                out["encoded_anew"].append(anew)
            yield pd.DataFrame(out)

    return rows.withColumn("edited", update(text, F.col("tree"), edits))


def join_edits(rows: DataFrame, edits: DataFrame, on: str) -> DataFrame:
    """``rows`` with the column ``edits`` from a table ``on, start, end, text`` of single edits, by start,
    end and text, so that insertions at one place come in the order of their texts in every run."""
    one = F.struct("start", "end", "text")
    lists = edits.groupBy(on).agg(F.array_sort(F.collect_list(one)).cast(EDITS).alias("edits"))
    return rows.join(lists, on, "left")
