"""Compression bands: counts against plain Python, verdicts on texts of known kind."""

import random
import re
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from ledgerlynx.llm import bands
from ledgerlynx.llm.queries import QUERIES

WORD = r"[^\x20\x09-\x0D]+"


def brute_counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    again, seen = 0, set()
    for line in text.split("\n"):
        if re.search(WORD, line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


ODD = [None, "", " ", "\n\n", "a\na\n\na\x0b", "x y z\r\nx y z\r\n", "a b c d e a b c d e f", "ü#ß|  \x85 \x1c", "a\n\n\n \n \n",
       "a a a a", "a a a a a a", "b a b a b a b", "#*$%&|<>" * 3, "one two three four five\n" * 40, "\U0001F600 " * 9]


def test_counts_brute_force(spark, folder):
    texts = ODD + [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").limit(150).collect()]
    assert [tuple(r) for r in bands.counts_of(texts).itertuples(index=False)] == list(map(brute_counts, texts))


def test_query_brute_force(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op13_compression_bands"](spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    compress = zstandard.ZstdCompressor(level=3).compress
    for r in got:
        data = docs[r.doc_id].encode()
        n, *_, repeated = counts = brute_counts(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n)
        assert r.ratio == pytest.approx(len(data) / len(compress(data)), abs=1e-6)
        # the verdict from the limits, written out
        def outside(part):
            low, high = next((lo, hi) for end, lo, hi in bands.BANDS if end is None or len(part) <= end)
            x = len(part) / len(compress(part))
            return (x > high) - (x < low)
        count = max(1, (len(data) + 2048) // 4096)
        sides = [outside(data[4096 * i:4096 * (i + 1) if i < count - 1 else len(data)]) for i in range(count)]
        bad = outside(data) or sides.count(1) > 0.2 * count or sides.count(-1) > 0.2 * count
        assert r.kept == (not r.base_failed and not bad)


def test_labelled_good_documents_stay(spark):
    """No text of a good label that passes the plain rule is lost."""
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op13_compression_bands"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    assert got.where("quality = 1 AND NOT base_failed AND NOT kept").count() == 0
    assert got.where("quality = 0 AND verdict <> 'keep'").count() > 10


def noise(n, seed=1):
    rnd = random.Random(seed)
    return "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) if rnd.random() < 0.5 else chr(rnd.randrange(33, 127)) for _ in range(n))


def prose(n, seed=2):
    rnd = random.Random(seed)
    parts = "the of to in and re ver con tion ment al ly er an on ing es ti pro com sta ble ous".split()
    return " ".join("".join(rnd.choices(parts, k=rnd.randint(1, 4))) for _ in range(n // 4))[:n]


@pytest.mark.parametrize("text,verdict", [
    (None, "empty"), ("", "empty"), ("word", "keep"), (prose(300), "keep"), (prose(3000), "keep"), (prose(60000), "keep"),
    ("same line again\n" * 400, "repetitive"), ("x" * 80, "repetitive"), (noise(3000), "incompressible"),
    (prose(40000) + "buy now and save\n" * 850, "repetitive chunks"), (prose(40000) + noise(7000), "incompressible chunks"),
    (prose(40000) + "buy now and save\n" * 100, "keep"),
])
def test_verdicts(documents, text, verdict):
    docs = documents([(1, text, "en", "s")]).selectExpr("*", "3 AS bands", "4 AS ratio")
    assert bands.with_bands(docs, F.col("text")).select("bands.verdict").first()[0] == verdict


def test_chunks_cover_the_text():
    for n in (0, 1, 9, 10, 14, 15, 16, 25, 99, 100):
        parts = bands.chunks(bytes(range(n)), 10)
        assert b"".join(parts) == bytes(range(n)) and all(5 <= len(p) < 15 for p in parts[1:])


def test_odd_tables(documents):
    docs = documents([(1, "a", "en", "s"), (1, "a", "en", "s"), (None, None, None, None)])
    out = bands.with_counts(bands.with_bands(docs, F.col("text")), F.col("text"))
    assert out.count() == 3 and out.limit(0).count() == 0
    assert bands.with_counts(docs.limit(0), F.col("text")).count() == 0
