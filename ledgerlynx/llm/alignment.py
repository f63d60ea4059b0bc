"""Alignment of the tokens of two tokenizers over the same bytes.

A text is encoded by a byte-level vocabulary (A) and a piece vocabulary (B).
Character offsets of A and spans of B are coarse cuts: a character of several
bytes may belong to several tokens, and a byte-fallback token has no span of its own.
There the bytes that a token stands for decide. Byte offsets where tokens of both
end cut the text into groups; tokens whose bytes overlap are linked.

Neither vocabulary joins a character with a blank behind it, so texts are cut before
such blanks; a worker encodes and aligns a segment once as long as it remembers it.

Links are counted over the corpus in three steps that never bring one frequent pair
together row by row: pairs are counted per block of rows, summed over blocks, and the sums
go back to each block once.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerlynx.llm.common import written
from ledgerlynx.llm.tokens import slices

#: Public vocabularies: byte-level BPE (A) and pieces with byte fallback (B).
BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PIECE_BYTES = 2_000_000
#: Segments that a task remembers, and rows that share one look-up of link counts.
REMEMBERED, BLOCK_ROWS = 300_000, 1024

FOUND = "n_a bigint, n_b bigint, n_groups bigint, groups string, ends array<int>, pairs array<bigint>, times array<int>"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable characters of Latin-1
    are themselves, the other bytes follow from 256 on in their order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


class Vocabulary:
    """What an id stands for: its bytes, their number and its decimal text."""

    def __init__(self, entries: list[bytes]):
        self.bytes, self.size = entries, np.array([len(e) for e in entries], np.int64)
        names = [str(i) for i in range(len(entries))]
        # with the sign that follows it in a group
        self.inside, self.last = (np.array([n + sign for n in names], object) for sign in (",", ";"))
        self.closing = np.array([n + "|" for n in names], object)

    def ends(self, data: bytes, ids: np.ndarray, coarse: np.ndarray, certain: np.ndarray) -> np.ndarray | None:
        """Where each token ends in ``data``: at a certain coarse cut, behind others by the bytes
        that each token stands for. None if the tokens are not the text."""
        if not (self.size[ids] > 0).all() or b"".join([self.bytes[i] for i in ids.tolist()]) != data:
            return None
        decoded = np.cumsum(self.size[ids])
        # an uncertain token ends as far behind the certain cut before it as their bytes say
        before = np.maximum.accumulate(np.where(certain, np.arange(len(ids)), -1))
        from_cut = np.where(before >= 0, (coarse - decoded)[before], 0) + decoded
        return from_cut if np.array_equal(from_cut, decoded) else decoded


class Aligner:
    """Encodes segments with both vocabularies and remembers their alignments."""

    def __init__(self, byte_vocabulary: bytes, piece_vocabulary: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_vocabulary.decode())
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        byte_of = byte_alphabet()
        special = {t["id"] for t in json.loads(byte_vocabulary)["added_tokens"]}
        entries = sorted((i, e) for e, i in self.a.get_vocab(with_added_tokens=True).items())
        self.a_words = Vocabulary([e.encode() if i in special else bytes(byte_of[c] for c in e) for i, e in entries])
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_vocabulary)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_is_byte = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.b_words = Vocabulary([bytes([int(p[3:-1], 16)]) if byte else p.replace("▁", " ").encode()
                                   for p, byte in zip(pieces, self.b_is_byte)])
        # a piece that goes on behind a blank would join segments; then texts stay whole
        self.cuttable = not any("▁" in p.lstrip("▁") for p in pieces)
        # the library's spans count bytes or characters, depending on its version
        self.spans_are_bytes = self.b.encode("é", return_type="proto").pieces[-1].end == 2
        self._start([])

    def _start(self, keep: list[int]) -> None:
        """Forget all segments but those numbered ``keep``."""
        if keep:
            place = {c: i for i, c in enumerate(keep)}
            self.known, self.last = ({s: place.get(c, -1) for s, c in t.items() if c < 0 or c in place}
                                     for t in (self.known, self.last))
            which = np.array(keep)
            self.pairs, self.ends = _ragged(self.pairs, which), _ragged(self.ends, which)
            self.numbers, self.bad = self.numbers[:, which], self.bad[which]
            self.groups = [self.groups[c] for c in keep]
        else:
            # segments before a blank (-1: the text goes on behind it), and last ones that end otherwise
            self.known, self.last = {}, {}
            self.pairs = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # sizes, values
            self.ends = (np.zeros(0, np.int64), np.zeros(0, np.int32))
            self.numbers, self.bad = np.zeros((4, 0), np.int64), np.zeros(0, bool)
            self.groups = []
        self.used = np.zeros(len(self.groups), np.int64)

    def _add(self, segments: list[str]) -> None:
        """Records of segments, each of which ends where a blank may follow (or is the only one)."""
        if not segments:
            return
        whole = " " + " ".join(segments)
        found = self._aligned(whole, segments)
        if found is None and len(segments) > 1:  # some are not spelled by their tokens: search for them
            half = len(segments) // 2
            self._add(segments[:half])
            self._add(segments[half:])
            return
        if found is None:
            empty = np.zeros(1, np.int64)
            found = [""], (empty, empty[:0]), (empty, empty[:0].astype(np.int32)), np.zeros((4, 1), np.int64)
        groups, pairs, ends, numbers = found
        self.groups += groups
        self.pairs = tuple(map(np.concatenate, zip(self.pairs, pairs)))
        self.ends = tuple(map(np.concatenate, zip(self.ends, ends)))
        self.numbers = np.concatenate([self.numbers, numbers], axis=1)
        self.bad = np.append(self.bad, numbers[0] == 0)

    def _aligned(self, whole: str, segments: list[str]):
        """Group strings, linked pairs, group ends and numbers (tokens of A and B, groups, bytes) of segments
        that together, each behind a blank, are ``whole``; None if the tokens are not the text."""
        data = whole.encode()
        byte = np.frombuffer(data, np.uint8)
        place = np.append(np.flatnonzero((byte & 0xC0) != 0x80), len(data))  # byte of each character
        found = self.a.encode(whole, add_special_tokens=False)
        a = np.array(found.ids, np.int64)
        span = np.fromiter(itertools.chain.from_iterable(found.offsets), np.int64, 2 * len(a))
        # a character that the next token shares is no certain cut
        certain = np.append(span[2::2] >= span[1:-1:2], True)[:len(a)]
        a_end = self.a_words.ends(data, a, place[span[1::2]], certain)
        pieces = self.b.encode(whole[1:], return_type="proto").pieces  # without the blank that B adds
        b = np.fromiter([p.id for p in pieces], np.int64, len(pieces))
        end = np.fromiter([p.end for p in pieces], np.int64, len(pieces)) + 1
        coarse = end if self.spans_are_bytes else place[end]
        b_end = self.b_words.ends(data, b, coarse, ~self.b_is_byte[b] & (np.diff(end, prepend=1) > 0))
        if a_end is None or b_end is None:
            return None
        cuts = np.sort(np.concatenate([a_end, b_end]), kind="stable")
        twice = cuts[1:] == cuts[:-1]
        common, cuts = cuts[1:][twice], cuts[np.append(~twice, True)]
        sizes = np.array([len(s.encode()) + 1 for s in segments], np.int64)
        stop = np.cumsum(sizes)
        n_groups = np.diff(np.searchsorted(common, stop, "right"), prepend=0)
        # the ids of a group stand side by side, A's before B's, each with the sign behind it
        a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        signed = np.concatenate([np.where(a_end == common[a_group], self.a_words.closing[a], self.a_words.inside[a]),
                                 np.where(b_end == common[b_group], self.b_words.last[b], self.b_words.inside[b])])
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        items, upto = signed[order].tolist(), np.searchsorted(a_end, stop, "right") + np.searchsorted(b_end, stop, "right")
        for i in (upto[:-1] - 1).tolist():
            items[i] = items[i][:-1] + "\n"
        # each stretch between neighbouring cuts of either side lies in one token of both
        pairs = a[np.searchsorted(a_end, cuts)] << 32 | b[np.searchsorted(b_end, cuts)]
        n_pairs = np.diff(np.searchsorted(cuts, stop, "right"), prepend=0)
        numbers = np.stack([np.diff(np.searchsorted(a_end, stop, "right"), prepend=0),
                            np.diff(np.searchsorted(b_end, stop, "right"), prepend=0), n_groups, sizes])
        ends = (common - np.repeat(stop - sizes, n_groups)).astype(np.int32)
        return "".join(items)[:-1].split("\n"), (n_pairs, pairs), (n_groups, ends), numbers

    def _number(self, part: str, new: list[str]) -> int:
        """The number of a part as a segment, the next one if it is new, or -1 if the text goes on behind it."""
        end = part[-1:]
        if self.cuttable and (end.isalnum() or "!" <= end <= "~"):
            code = len(self.groups) + len(new)
            new.append(part)
        else:
            code = -1
        self.known[part] = code
        return code

    def _segments(self, text: str, new: list[str]) -> list[int]:
        """Numbers of a text's segments; unknown ones get the next numbers and go to ``new``."""
        parts = text.split(" ") if self.cuttable else [text]
        if len(parts) > 1 and not parts[-1]:
            parts[-2:] = [parts[-2] + " "]  # a blank at the end has no segment of its own: B would see nothing
        known = self.known
        codes = list(map(known.get, parts))
        if None in codes:
            codes = [self._number(p, new) if c is None and p not in known else c if c is not None else known[p]
                     for p, c in zip(parts, codes)]
        if -1 not in codes:
            return codes
        codes, open_ = [], None
        for k, part in enumerate(parts, 1 - len(parts)):
            part = part if open_ is None else f"{open_} {part}"
            code, open_ = known.get(part), None
            if code is None:
                code = self._number(part, new)
            if code >= 0:
                codes.append(code)
            elif k < 0:
                open_ = part
            else:  # the end of the text: encoded on its own
                code = self.last.get(part)
                if code is None:
                    self._add(new)  # those numbered before it
                    new.clear()
                    code = self.last[part] = len(self.groups)
                    self._add([part])
                codes.append(code)
        return codes

    def __call__(self, texts: list[str | None], with_ends: bool) -> list[pa.Array]:
        """The columns of FOUND for some texts."""
        if len(self.groups) > REMEMBERED:
            often = np.flatnonzero(self.used > 1).tolist()
            self._start(often if len(often) < REMEMBERED // 2 else [])
        new: list[str] = []
        codes = [self._segments(t, new) if t else [] for t in texts]
        self._add(new)
        if self.bad.any():
            wrong = set(np.flatnonzero(self.bad).tolist())
            codes = [[] if wrong.intersection(c) else c for c in codes]
        sizes = np.array([len(c) for c in codes], np.int64)
        flat = np.fromiter(itertools.chain.from_iterable(codes), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(codes)), sizes)
        self.used = np.concatenate([self.used, np.zeros(len(self.groups) - len(self.used), np.int64)])
        self.used += np.bincount(flat, minlength=len(self.groups)) > 0
        n_a, n_b, n_groups, size = (np.bincount(doc, n[flat], len(codes)).astype(np.int64) for n in self.numbers)
        name = self.groups.__getitem__
        groups = pa.array([";".join(map(name, own)) for own in codes], pa.string())
        ends = pa.nulls(len(codes), pa.list_(pa.int32()))
        if with_ends:
            own = self.numbers[3][flat]
            start = np.cumsum(own) - own - (np.cumsum(size) - size)[doc]
            taken, at = _ragged(self.ends, flat)
            ends = _lists(n_groups, at + np.repeat(start, taken), pa.int32())
        # segments of a text once with their number, then their pairs once with theirs
        own, count = np.unique(doc * max(len(self.groups), 1) + flat, return_counts=True)
        taken, pair = _ragged(self.pairs, own % max(len(self.groups), 1))
        of, weight = np.repeat(own // max(len(self.groups), 1), taken), np.repeat(count, taken)
        order = np.lexsort((pair, of))
        pair, of, weight = pair[order], of[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (of[1:] != of[:-1])])[:len(pair)])
        times = np.add.reduceat(weight, first) if len(first) else weight
        n_pairs = np.bincount(of[first], minlength=len(codes))
        return [pa.array(n_a), pa.array(n_b), pa.array(n_groups), groups, ends,
                _lists(n_pairs, pair[first], pa.int64()), _lists(n_pairs, times, pa.int32())]


@functools.cache
def aligner(byte_vocabulary: bytes, piece_vocabulary: bytes) -> Aligner:
    """One for all tasks of a worker, so that frequent segments stay known."""
    return Aligner(byte_vocabulary, piece_vocabulary)


def _ragged(parts: tuple[np.ndarray, np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and values, one after the other, of the numbered parts of (sizes, values)."""
    sizes, values = parts
    first, taken = np.cumsum(sizes) - sizes, sizes[which]
    inside = np.arange(int(taken.sum())) - np.repeat(np.cumsum(taken) - taken, taken)
    return taken, values[np.repeat(first[which], taken) + inside]


def _lists(sizes: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def aligned(rows: DataFrame, text: Column, with_ends: bool = True,
            byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY) -> DataFrame:
    """Both tokenizations of each text and how they meet: ``doc`` (the input row) and

    * ``n_a``, ``n_b``: tokens of ``" " + text`` without special tokens, whose strings are plain text;
    * ``groups``: ``a1,a2|b1;a3|b2,b3``, the ids of A and B of each group in order; ``n_groups``;
    * ``ends``: the byte of ``" " + text`` behind each group (null without ``with_ends``);
    * ``pairs`` and ``times``: each linked pair of ids once (A's id in the upper 32 bits, B's in the
      lower) and how many of its tokens overlap.

    A null or empty text, and one that the tokens do not spell, has zeros and empty lists.
    The vocabularies are files of fixed size, read on the driver.
    """
    files = []
    for path in (byte_vocabulary, piece_vocabulary):
        with open(path, "rb") as f:
            files.append(f.read())
    shared = rows.sparkSession.sparkContext.broadcast(tuple(files))
    given = rows.select(F.struct(*[rows[f"`{c}`"] for c in rows.columns]).alias("doc"), text.alias("text"))
    schema = T.StructType([given.schema["doc"], *T.StructType.fromDDL(FOUND).fields])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = aligner(*shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts, PIECE_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(a, b - a), *one(texts[a:b], with_ends)], names=schema.names)

    return given.mapInArrow(align, schema)


def link_counts(found: DataFrame) -> DataFrame:
    """``pair``, ``n_rows`` that hold it, and whether no other pair of its A id is in more rows (``best``)."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_rows"))
    return _with_best(counts)


def _with_best(counts: DataFrame) -> DataFrame:
    # a window over the pairs of one A id: no more than B has ids
    most = F.max("n_rows").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.withColumn("best", F.col("n_rows") == most)


def with_link_counts(found: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``found`` (rows with ``pairs`` and ``times``) without these columns, but with ``n_links`` (overlapping
    pairs of tokens), ``n_best`` (those whose pair is in as many rows as any pair of its
    A id) and ``count_sum`` (over links, in how many rows their pair is).

    ``found`` is written once with the number of a block of rows, so all steps see the same blocks.
    """
    others = [c for c in found.columns if c not in ("pairs", "times")]
    rows = written(found.select(F.struct(*[found[f"`{c}`"] for c in others]).alias("row"), "pairs", "times",
                                F.floor(F.monotonically_increasing_id() / block_rows).alias("block")), "alignment")
    in_block = rows.select("block", F.explode("pairs").alias("pair")).groupBy("block", "pair") \
        .agg(F.count(F.lit(1)).alias("n_rows"))
    counts = _with_best(in_block.groupBy("pair").agg(F.sum("n_rows").alias("n_rows")))
    of_block = in_block.select(F.col("block").alias("of_block"), "pair").join(counts, "pair")
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("n_links bigint, n_best bigint, count_sum bigint").fields])

    def look_up(here: pa.Table, there: pa.Table) -> pa.Table:
        lists = here.column("pairs").combine_chunks()
        pair = lists.flatten().to_numpy()
        times = here.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        known = there.column("pair").to_numpy()
        order = np.argsort(known)
        at = order[np.searchsorted(known, pair, sorter=order)] if len(pair) else np.zeros(0, np.int64)
        n_rows, best = there.column("n_rows").to_numpy()[at], there.column("best").to_numpy()[at].astype(bool)

        def summed(values: np.ndarray) -> pa.Array:
            out = np.zeros(len(lists), np.int64)
            np.add.at(out, owner, values)
            return pa.array(out)

        return pa.Table.from_arrays([here.column("row"), summed(times), summed(times * best), summed(times * n_rows)],
                                    names=schema.names)

    out = rows.groupBy("block").cogroup(of_block.groupBy("of_block")).applyInArrow(look_up, schema)
    return out.select("row.*", "n_links", "n_best", "count_sum")
