"""Token alignments against whole-text encodings and plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlynx.llm import alignment
from ledgerlynx.llm.queries import QUERIES


@pytest.fixture(scope="module")
def files():
    return [open(p, "rb").read() for p in (alignment.BYTE_VOCABULARY, alignment.PIECE_VOCABULARY)]


@pytest.fixture
def aligner(files):
    return alignment.Aligner(*files)


ATOMS = ["a", "it's", "don't ", " ", "  ", "\n", "\t", "\r\n", "é", "ñ", "中文", "\U0001F680", "▁", "　", " ", "\x00", "\x1c",
         "<|endoftext|>", "<s>", "</s>", "<0x41>", "<unk>", "123", "!?", "##", "ﬁ", "Å", "​", "word", "HELLO", "﻿",
         "ß", "\U0001D4B3", "ꙮ", "\x85", " ", "q"]


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    return [None, "", *ATOMS, *["".join(rnd.choices(ATOMS, k=rnd.randint(1, 30))) for _ in range(n)]]


def brute(aligner, text):
    """Whole text, bytes of tokens added up, every pair of tokens looked at."""
    nothing = 0, 0, 0, "", {}
    if not text:
        return nothing
    data = f" {text}".encode()
    a = aligner.a.encode(f" {text}", add_special_tokens=False).ids
    b = aligner.b.encode(text)
    sides = []
    for ids, entries in ((a, aligner.a_words.bytes), (b, aligner.b_words.bytes)):
        if b"".join(entries[i] for i in ids) != data:
            return nothing
        at, spans = 0, []
        for i in ids:
            spans.append((i, at, at := at + len(entries[i])))
        sides.append(spans)
    cuts = sorted({s[2] for s in sides[0]} & {s[2] for s in sides[1]})
    groups = ["|".join(",".join(str(i) for i, _, end in side if start < end <= stop) for side in sides)
              for start, stop in zip([0, *cuts], cuts)]
    links, low = Counter(), 0
    for i, start, end in sides[0]:
        while sides[1][low][2] <= start:
            low += 1
        for j, s, e in sides[1][low:]:
            if s >= end:
                break
            links[i << 32 | j] += 1
    return len(a), len(b), len(groups), ";".join(groups), dict(links)


def found(aligner, texts):
    n_a, n_b, n_groups, groups, ends, pairs, times = (c.to_pylist() for c in aligner(texts, True))
    for text, count, end in zip(texts, n_groups, ends):
        assert len(end) == count and end == sorted(set(end)) and (not count or end[-1] == len(f" {text}".encode()))
    return [(*row[:4], dict(zip(row[4], row[5]))) for row in zip(n_a, n_b, n_groups, groups, pairs, times)]


def test_odd_texts(aligner):
    texts = odd_texts(1500)
    assert found(aligner, texts) == [brute(aligner, t) for t in texts]


def test_documents(aligner, spark, folder):
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").limit(80).collect()]
    assert found(aligner, texts) == [brute(aligner, t) for t in texts]


def test_forgetting_changes_nothing(aligner, monkeypatch):
    texts = odd_texts(400, seed=5)
    want = [brute(aligner, t) for t in texts]
    monkeypatch.setattr(alignment, "REMEMBERED", 60)
    got = [row for i in range(0, len(texts), 20) for row in found(aligner, texts[i:i + 20])]
    assert got == want and len(aligner.groups) < 400


def test_whole_texts_where_pieces_cross_blanks(aligner):
    texts = odd_texts(60, seed=6) + ["a b c", "trailing "]
    want = found(aligner, texts)
    aligner.cuttable = False
    aligner._start([])
    assert found(aligner, texts) == want


def test_byte_alphabet():
    alphabet = alignment.byte_alphabet()
    assert sorted(alphabet.values()) == list(range(256)) and alphabet["Ġ"] == 32 and alphabet["Ċ"] == 10


def test_query_brute_force(spark, documents, table_folder, aligner, monkeypatch):
    texts = odd_texts(150, seed=7) + ["the cat sat on the mat"] * 40 + ["word " * 3000]
    rows = [(i if i % 50 else None, t, "en", "s") for i, t in enumerate(texts)]
    monkeypatch.setattr(alignment, "BLOCK_ROWS", 8)
    folder = table_folder(documents=documents(rows).selectExpr("*", "1 AS block", "2 AS pairs", "3 AS n_links"))
    each = [(r[0], *brute(aligner, r[1])) for r in rows]
    n_rows, highest = Counter(), defaultdict(int)
    for r in each:
        n_rows.update(r[5].keys())
    for pair, n in n_rows.items():
        highest[pair >> 32] = max(highest[pair >> 32], n)
    want = [(i, a, b, g, sum(links.values()), sum(n for p, n in links.items() if n_rows[p] == highest[p >> 32]),
             sum(n * n_rows[p] for p, n in links.items()), hashlib.sha256(groups.encode()).hexdigest() if g else "")
            for i, a, b, g, groups, links in each]
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
           for r in QUERIES["op12_tokenizer_spans"](spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_counts_of_links_and_small_blocks(documents, spark):
    docs = documents([(i, "some text here" if i % 3 else "other text", "en", "s") for i in range(30)])
    out = alignment.aligned(docs, F.col("text"))
    counts = {r.pair: (r.n_rows, r.best) for r in alignment.link_counts(out).collect()}
    assert {n for n, _ in counts.values()} == {10, 20, 30}
    big, small = (alignment.with_link_counts(out.drop("doc"), size).orderBy("count_sum").collect() for size in (1000, 1))
    assert big == small and len(big) == 30


def test_empty_table_and_clashing_columns(documents):
    docs = documents([(1, "a b", "en", "s")]).selectExpr("*", "'x' AS doc", "1 AS groups", "2 AS n_a")
    out = alignment.aligned(docs, F.col("text"))
    assert out.select("doc.*").columns == docs.columns and out.first().n_a == 2
    assert alignment.with_link_counts(alignment.aligned(docs.limit(0), F.col("text"))).count() == 0
