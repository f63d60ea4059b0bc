"""Periodic runs against plain loops."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlynx.llm import periodic
from ledgerlynx.llm.queries import QUERIES


def brute_runs(words):
    """(start, length, smallest period) of all runs, by start, then period."""
    n, found = len(words), {}
    for q in range(1, n):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def random_words(rnd):
    n, kinds = rnd.choice([0, 1, 5, 6, 7, 20, 60, 150, 400]), rnd.choice([1, 2, 2, 3, 10])
    words = [b"%d" % rnd.randrange(kinds) for _ in range(n)]
    if rnd.random() < 0.5 and n > 10:
        a = rnd.randrange(n)
        p = 1 + rnd.randrange(max(1, (n - a) // 4 + 1))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_cover_reaches_every_difference():
    assert {(a - b) % periodic.MODULUS for a in periodic.COVER for b in periodic.COVER} == set(range(periodic.MODULUS))


def test_extensions_brute_force():
    rnd = random.Random(4)
    for kinds, period in ((1, 1), (2, 7), (3, 90), (50, 400)):
        ids = np.array([rnd.randrange(kinds) for _ in range(period)] * (900 // period) + [99])
        extend = periodic.Extensions(ids)
        i, j = np.array([sorted(rnd.sample(range(len(ids)), 2)) for _ in range(300)]).T
        want = [next(k for k in range(len(ids)) if b + k == len(ids) - 1 or ids[a + k] != ids[b + k])
                if b < len(ids) - 1 else 0 for a, b in zip(i, j)]
        assert extend.forward(i, j).tolist() == want


def test_runs_brute_force():
    rnd = random.Random(3)
    for _ in range(150):
        texts = [random_words(rnd) for _ in range(rnd.randint(1, 8))]
        texts += texts[:rnd.randint(0, 1)]  # copies in one piece
        for words, got in zip(texts, periodic.runs_of_texts(texts)):
            assert [tuple(r) for r in got.tolist()] == brute_runs(words)


def test_runs_inside_runs():
    a, b = [b"a"], [b"a", b"b"]
    for _ in range(9):
        a, b = b, a + b  # Fibonacci words: nested and overlapping runs
    for words in (b * 4, (b"x x x x x x y ".split()) * 5, [b"w"] * 500):
        assert [tuple(r) for r in periodic.runs_of_texts([words])[0].tolist()] == brute_runs(words)


ODD = [
    (1, "a a a a a", "en", "s"), (2, "a a a a a a", "en", "s"), (3, None, "en", "s"), (4, "", "en", None),
    (5, " \t\n", None, "s"), (None, "to be or not to be or not to be or not to be or not", "en", "s"), (6, "A a A a A a A a", "en", "s"),
    (2, "a a a a a a", "en", "s"), (7, "x " * 3000 + "y " * 2000, "en", "s"), (8, "é　 é　 é　\x0bé　 é　\x1c é　", "de", "s"),
]


def test_query_brute_force(spark, documents, table_folder):
    rnd = random.Random(8)
    rows = ODD + [(100 + i, b" ".join(random_words(rnd)).decode(), "en", "s") for i in range(120)]
    docs = documents(rows).selectExpr("*", "1 AS periodic", "2 AS n_runs")
    got = QUERIES["op11_periodic_runs"](spark, table_folder(documents=docs)).collect()
    assert len(got) == len(rows)
    want = []
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        dropped = {i for s, k, q in runs for i in range(s + q, s + k)}
        want.append((doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
                     hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest(),
                     hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()))
    found = [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert any(r.n_runs > 1 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "s")]])
def test_nothing_to_find(documents, rows):
    out = periodic.with_runs(documents(rows), F.col("text")).select("periodic.*").collect()
    assert [tuple(r) for r in out] == [(0, [], "")] * len(rows)


def test_collapsed_text(documents):
    out = periodic.with_runs(documents([(1, "so " + "tick tock " * 9 + "end", "en", "s")]), F.col("text")).first()
    assert out.periodic.collapsed == "so tick tock end" and out.periodic.runs[0].asDict() == {"start": 1, "length": 18, "period": 2}
