"""Benchmark passages in documents, found through an FM-index of each shard."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlynx.llm.common import as_rows, doc_field, give_back_memory, written

#: Words of a window; symbols of one shard's index; distance of sampled suffixes;
#: bytes of benchmark text that one pass holds in a task.
WINDOW, SHARD_SYMBOLS, SAMPLE, BLOCK_BYTES = 10, 1 << 18, 8, 4 << 20
WORD_CHARS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD_CHARS)
# A-Z to lower case, other ASCII that is not 0-9 a-z to a blank; bytes above 0x7F belong to words
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


class WaveletMatrix:
    """Ranks of symbols in a sequence of small numbers."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            count = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(symbols) - int(count[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` occurs before position ``upto``."""
        start, end = np.zeros_like(upto), upto
        for level, (zeros, ones) in enumerate(zip(self.zeros, self.ones)):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            start_one, end_one = ones[start], ones[end]
            start = np.where(bit, zeros + start_one, start - start_one)
            end = np.where(bit, zeros + end_one, end - end_one)
        return end - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the compared length until all differ."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    length = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:max(0, n - length)] = rank[length:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
        if n == 0 or new[order[-1]] == n - 1:
            return order
        rank, length = new, length * 2


class FMIndex:
    """Index of runs of symbols (1 and up). No match crosses the border of two runs."""

    def __init__(self, runs: list[np.ndarray], n_symbols: int, sample: int = SAMPLE):
        ends = np.cumsum([len(r) + 1 for r in runs])
        text = np.zeros(int(ends[-1]) if len(runs) else 0, np.int64)
        for run, end in zip(runs, ends):
            text[end - 1 - len(run):end - 1] = run
        # each border is a symbol of its own while sorting, so compared stretches stay within a run
        keys = text + len(runs)
        keys[ends - 1] = np.arange(len(runs))
        sa = suffix_array(keys)
        bwt = text[sa - 1]
        self.matrix = WaveletMatrix(bwt, max(1, int(n_symbols).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols + 2))])
        # run starts are sampled too: a walk never has to cross a border
        kept = sa % sample == 0
        starts = np.zeros(len(text), bool)
        starts[np.concatenate([[0], ends[:-1]]).astype(np.int64)] = True
        kept |= starts[sa]
        self.kept_rank = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.kept_at, self.bwt = kept, sa[kept], bwt

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of equally long ``patterns``, from their last symbol backwards."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.bwt), np.int64)
        alive = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, column]
            low[alive] = self.first[symbol] + self.matrix.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.matrix.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        high[low >= high] = low[low >= high]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back to the next sampled one."""
        rows, found, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.kept[rows[todo]]
            done = todo[hit]
            found[done] = self.kept_at[self.kept_rank[rows[done]]] + steps
            todo = todo[~hit]
            symbol = self.bwt[rows[todo]]
            rows[todo] = self.first[symbol] + self.matrix.rank(symbol, rows[todo])
            steps += 1
        return found


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each comes from."""
    n = high - low
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[owner], owner


class Phrases:
    """The windows of a block of benchmark items over a vocabulary of numbers."""

    def __init__(self, items: list[tuple], window: int):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple, set[int]] = {}
        for item, (_, text) in enumerate(items):
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                found.setdefault(tuple(words[i:i + size]), set()).add(item)
        self.tables = []
        for size in sorted({len(w) for w in found}):
            these = [w for w in found if len(w) == size]
            self.tables.append((size, np.array(these, np.int64), [sorted(found[w]) for w in these]))
        self.shortest = self.tables[0][0] if self.tables else 0


def scan_shard(texts: list[list[bytes]], phrases: Phrases) -> Iterator[tuple[int, list, set[int]]]:
    """``(document, merged word spans, items)`` of documents with an occurrence.

    Words that no phrase has cannot be hit, so the text to index is the runs of
    phrase words that are long enough for the shortest window.
    """
    runs, doc_of, word_of, get = [], [], [], phrases.vocabulary.get
    for doc, words in enumerate(texts):
        known = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known != 0, [0]]).astype(np.int8)))
        for start, end in edges.reshape(-1, 2):
            if end - start >= phrases.shortest:
                runs.append(known[start:end])
                doc_of.append(doc)
                word_of.append(start)
    if not runs:
        return
    index = FMIndex(runs, len(phrases.vocabulary))
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in runs])])
    spans: dict[int, list] = {}
    items: dict[int, set[int]] = {}
    for size, patterns, owners in phrases.tables:
        low, high = index.search(patterns)
        rows, which = _ranges(low, high)
        at = index.locate(rows)
        run = np.searchsorted(offsets, at, "right") - 1
        for r, place, p in zip(run.tolist(), (at - offsets[run]).tolist(), which.tolist()):
            start = int(word_of[r]) + place
            spans.setdefault(doc_of[r], []).append((start, start + size))
            items.setdefault(doc_of[r], set()).update(owners[p])
    for doc, found in spans.items():
        yield doc, merged(found), items[doc]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def removed(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    if not spans:
        return text
    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    kept, start = [], 0
    for first, end in spans:
        kept.append(text[start:at[first][0]])
        start = at[end - 1][1]
    return "".join(kept) + text[start:]


_LOWER = {c: c + 32 for c in range(65, 91)}
_HITS = "array<struct<start:int,end:int>>"


def _scanner(shared, shard_symbols: int):
    @F.pandas_udf(f"n_words long, spans {_HITS}, items array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        phrases = shared.value
        for batch in batches:
            out = {"n_words": np.zeros(len(batch), np.int64), "spans": [[] for _ in range(len(batch))],
                   "items": [[] for _ in range(len(batch))]}
            shard, first, symbols = [], 0, 0
            for i, text in enumerate(batch):
                words = words_of(text)
                out["n_words"][i] = len(words)
                shard.append(words)
                symbols += len(words)
                if symbols >= shard_symbols or i == len(batch) - 1:
                    for doc, spans, items in scan_shard(shard, phrases):
                        out["spans"][first + doc] = [{"start": int(a), "end": int(b)} for a, b in spans]
                        out["items"][first + doc] = sorted({str(phrases.ids[x]) for x in items})
                    shard, first, symbols = [], i + 1, 0
            yield pd.DataFrame(out)
        give_back_memory()
    return scan


def find_passages(rows: DataFrame, text: Column, benchmark: DataFrame, item_col: str = "item_id",
                  item_text: str = "text", keep: list[str] | None = None, window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """``rows`` (all columns or those of ``keep``, ``row`` among them) with ``n_words``,
    ``spans`` (word positions, merged) and ``items`` (ids as text, sorted) of benchmark
    passages in ``text``. Null texts have no words; items without id or text are no items.

    The benchmark is a query set against all documents: it goes to the tasks in
    blocks of at most ``block_bytes`` of text (or one item), each block in a pass
    of its own, and the hits of the passes are merged by row. Several passes read
    a written copy of the rows, so that a row keeps its number.
    """
    spark = rows.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").alias("text")) \
        .where("item IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    keep = list(keep or rows.columns)
    rows, found = rows.withColumn("__text", text), None
    if n_blocks > 1:
        rows = written(rows.select(*keep, "__text"), "fm-rows")
    for block in range(n_blocks):
        of_block = items.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block)
        shared = spark.sparkContext.broadcast(
            Phrases(sorted({(r["item"], r["text"]) for r in of_block.toLocalIterator()}), window))
        # only texts go to the shards; the other columns stay where they are
        hits = rows.select(*keep, _scanner(shared, shard_symbols)("__text").alias("__hit")) \
            .select(*keep, "__hit.n_words", "__hit.spans", "__hit.items")
        if n_blocks == 1:
            return hits
        part = written(hits, "fm-hits")
        if found is None:
            found = part
            continue
        both = found.join(part.select("row", F.col("spans").alias("s2"), F.col("items").alias("i2"))
                          .where("size(s2) > 0"), "row", "left")
        found = written(both.select(
            *keep, "n_words",
            _merge_spans(F.col("spans"), F.coalesce("s2", F.expr(f"CAST(array() AS {_HITS})"))).alias("spans"),
            F.array_sort(F.array_union("items", F.coalesce("i2", F.expr("CAST(array() AS array<string>)"))))
            .alias("items")), "fm-hits")
    return found


def _merge_spans(a, b):
    """Two lists of spans as one of spans that neither meet nor overlap."""
    def step(done, span):
        last = F.element_at(done, -1)
        return F.when((F.size(done) > 0) & (span["start"] <= last["end"]), F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))),
        )).otherwise(F.concat(done, F.array(span)))
    return F.aggregate(F.array_sort(F.concat(a, b)), F.expr(f"CAST(array() AS {_HITS})"), step)


def items_sha256(items):
    return F.sha2(F.concat_ws(",", items).cast("binary"), 256)


def hit_words(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                  length_col: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` without the benchmark passages: each merged span of hit words is cut
    out of its text, and a document of which no word is left goes. Untouched
    documents, also null and empty ones, stay as they are.
    """
    rows = as_rows(docs)
    if benchmark.isEmpty():
        return docs
    hits = find_passages(rows.withColumn("row", F.monotonically_increasing_id()), doc_field(text_col), benchmark,
                         **options)

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([removed(t, [(s["start"], s["end"]) for s in x]) if t is not None and len(x) else t
                          for t, x in zip(text, spans)], dtype=object)

    left = hits.where((F.size("spans") == 0) | (hit_words(F.col("spans")) < F.col("n_words")))
    text = F.when(F.size("spans") > 0, cut(doc_field(text_col), F.col("spans"))).otherwise(doc_field(text_col))
    columns = []
    for c in docs.columns:
        value = doc_field(c)
        if c == text_col:
            value = F.col("new_text")
        elif c == length_col:
            value = F.when(F.size("spans") > 0, F.length("new_text").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return left.withColumn("new_text", text).select(*columns)
