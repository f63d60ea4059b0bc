"""Pages, benchmark passages and language-model scores: against plain Python."""

import hashlib
import html
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlynx.llm import fmindex, mixlm, sitetree
from ledgerlynx.llm.queries import QUERIES
from ledgerlynx.llm.tokens import words

PAGE = "page_id long, url string, html string"


def article_text(page):
    """The given pages mark their article and use p, b, br and headings in it."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h\d)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
    return "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)


def test_pages_brute_force(spark, folder):
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = QUERIES["op8_site_style_tree"](spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article_text(pages[r.page_id].html)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize("page,want", [
    (None, []), ("", []), ("plain &amp; text", ["plain & text"]),
    ("<p>one<p>two<br>three</p>four", ["one", "two three", "four"]),
    ("<div class='cookie-notice'>no</div><p>yes <a href=x>link</a> and <b>bold</p><p>more", ["yes link and bold", "more"]),
    ("<body><header>top</header><main><h1>T&eacute;st</h1><header>in</header><aside>no</aside><p>a<!-- x --> b</p>"
     "<div id=comments><p>no</p></div></main><footer>no</footer>", ["Tést", "in", "a b"]),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><title>no</title><p>1 < 2</p>", ["1 < 2"]),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", ["a", "b", "c", "d"]),
    ("<p>in <span class=ad>buy</span> text</p>", ["in", "text"]),
    ("<form><input value=x><p>no</p></form><p hidden>no</p><p style='display: none'>no</p>&nbsp;", []),
    ("<p>caf&#233; &lt;b&gt; &copy;</p><p>x" + "y" * 50_000, ["café <b> ©", "x" + "y" * 50_000]),
])
def test_blocks(page, want):
    assert sitetree.main_blocks(page, set()) == want


def test_tree_removes_what_a_host_repeats(spark):
    page = "<html><body><div class=x1><span>Menu one</span></div><div class=x2><p>{}</p></div><div class=x3>All rights</div>"
    rows = [(i, f"http://a.b:80/{i}", page.format(f"story number {i}")) for i in range(8)]
    rows += [(100, "http://c.d/", page.format("alone")), (101, None, None), (102, "", ""), (0, "http://a.b/0", page.format("again"))]
    rows += [(200 + i, "http://same.x/", page.format("copy")) for i in range(6)]
    df = spark.createDataFrame(rows, PAGE).selectExpr("*", "url AS host", "1 AS low", "2 AS doc")
    got = [(r.doc.page_id, r.main_text) for r in sitetree.extract(df).collect()]
    texts = dict(got)
    assert len(got) == len(rows)
    assert all(texts[i] == f"story number {i}" for i in range(1, 8))
    assert texts[100] == "Menu one\nalone\nAll rights" and texts[101] == texts[102] == ""
    assert texts[200] == "Menu one\ncopy\nAll rights"  # all copies: nothing can be told apart
    assert sitetree.extract(df.limit(0)).count() == 0
    tree = sitetree.style_tree(df).where("host = 'a.b' AND importance IS NOT NULL").collect()
    assert len([t for t in tree if t.importance < sitetree.LOW]) == 2 and max(t.importance for t in tree) > 0.8


def test_copies_of_a_page_weigh_once(spark):
    page = "<html><body><div class=x1>Menu one</div><p class=x4>May {}</p><div class=x2><p>{}</p></div>"
    rows = [(i, f"http://a.b/{i}", page.format(1, "the copied story")) for i in range(90)]
    rows += [(i, f"http://a.b/{i}", page.format(i, f"story number {i}")) for i in range(90, 100)]
    got = {r.doc.page_id: r.main_text for r in sitetree.extract(spark.createDataFrame(rows, PAGE).repartition(4)).collect()}
    assert got[0] == "May 1\nthe copied story"
    assert all(got[i] == f"May {i}\nstory number {i}" for i in range(90, 100))


@pytest.mark.parametrize("page,want", [
    ("<div class='layout has-sidebar with-nav no-comments'><div class=sidebar>no</div><p>yes</p></div>", ["yes"]),
    ("<div class=sidebar-layout><div class=x>Menu</div><article><p>yes</p></article></div>", ["yes"]),
    ("<article><p>a</p></article><div class=related><article>teaser</article></div>", ["a"]),
    ("<article><p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p></article>", ["let x=1 be"]),
])
def test_names_are_a_first_guess(page, want):
    assert sitetree.main_blocks(page, set()) == want


def test_tree_judges_marked_pages_too(spark):
    page = "<html><body><main><div class=x1>Buy our paper</div><p>story number {}</p></main>"
    rows = [(i, f"http://a.b/{i}", page.format(i)) for i in range(8)]
    got = sitetree.extract(spark.createDataFrame(rows, PAGE).repartition(3)).collect()
    assert {r.doc.page_id: r.main_text for r in got} == {i: f"story number {i}" for i in range(8)}


def test_host():
    assert [sitetree.host_of(u) for u in ("HTTP://u:p@A.b:8/x", "//c.d?x", "e.f/g", None, "")] == ["a.b", "c.d", "", "", ""]


def test_suffix_array_and_search():
    rng = np.random.default_rng(0)
    for n in (1, 2, 30, 500):
        runs = [rng.integers(1, 4, int(m)) for m in rng.integers(1, n + 1, 4)] + [np.ones(n, np.int64)] * 3
        index = fmindex.FMIndex(runs, 3)
        text = np.concatenate([np.append(r, 0) for r in runs])
        for size in (1, 2, 5):
            patterns = rng.integers(1, 4, (20, size))
            low, high = index.search(patterns)
            rows, owner = fmindex._ranges(low, high)
            at = index.locate(rows)
            for p in range(20):
                want = [i for i in range(len(text) - size + 1) if (text[i:i + size] == patterns[p]).all()]
                assert sorted(at[owner == p].tolist()) == want


def hits(docs, benchmark, window=10):
    table = {}
    for item, text in benchmark:
        w = [x.decode() for x in fmindex.words_of(text)]
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            table.setdefault(tuple(w[i:i + size]), set()).add(item)
    out = {}
    for doc, text in docs:
        w = re.findall(fmindex.WORD_CHARS, (text or "").translate({c: c + 32 for c in range(65, 91)}))
        assert [x.encode() for x in w] == fmindex.words_of(text)
        hit, items = set(), set()
        for size in {len(k) for k in table}:
            for i in range(len(w) - size + 1):
                found = table.get(tuple(w[i:i + size]))
                if found:
                    hit |= set(range(i, i + size))
                    items |= found
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(items), digest, bool(hit))
    return out


BENCH = [(1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu"), (2, "tiny item"), (3, ""), (4, None),
         (5, "Ünï cödé tiny item here"), (10, "tiny item"), (11, "a a a a a a a a a a a a")]
DOCS = [(1, "so ALPHA beta gamma delta-epsilon zeta; eta theta iota kappa (lambda) mu nu end"), (2, None), (3, ""),
        (4, "the tiny item, tiny item tiny"), (5, "alpha beta gamma delta"), (6, "a " * 3000), (7, "tiny-item"),
        (8, "ÜNÏ cödé tiny item here"), (9, "filler " * 20_000 + "tiny item"), (1, "tiny item")]


@pytest.mark.parametrize("window", [10, 3])
def test_passages_brute_force(spark, documents, window):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    rows = documents([(*d, "en", "s") for d in DOCS[:-1]]).selectExpr("doc_id AS row", "text")
    want = hits(DOCS[:-1], BENCH, window)
    for options in ({}, {"block_bytes": 40}, {"shard_symbols": 5}):
        found = fmindex.find_passages(rows, F.col("text"), bench, window=window, **options)
        n = fmindex.hit_words(F.col("spans"))
        got = {r[0]: tuple(r)[1:] for r in found.select(
            "row", "n_words", n, F.size("items"), fmindex.items_sha256(F.col("items")), n > 0).collect()}
        assert got == want


def test_passages_of_the_tables(spark, folder):
    read = lambda name: [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(
        "item_id" if name == "benchmark" else "doc_id", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op10_fm_decontaminate"](spark, folder).collect()}
    want = hits(read("documents"), read("benchmark"))
    assert got == want and any(w[4] for w in want.values())


def test_decontaminate_cuts_spans(spark, documents):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = documents([(*d, "en", "s") for d in DOCS]).selectExpr("*", "1 AS spans", "2 AS new_text", "3 AS row")
    got = fmindex.decontaminate(docs, bench)
    assert got.columns == docs.columns
    texts = {(r.doc_id, r.n_chars): r.text for r in got.collect()}
    by_id = {i: t for (i, _), t in texts.items()}
    assert set(by_id) == {1, 2, 3, 4, 5, 8, 9}  # 6, 7 and the second 1 have no other word
    assert by_id[1] == "so  end" and by_id[5] == "alpha beta gamma delta" and by_id[2] is None and by_id[4] == "the  tiny"
    assert all(n is None or n == len(t) for (_, n), t in texts.items() if t is not None)
    assert fmindex.decontaminate(docs, bench.limit(0)).count() == len(DOCS)
    assert fmindex.decontaminate(docs.limit(0), bench).count() == 0


def unigram(docs):
    token = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    counts, end = {}, object()
    for i, text in docs:
        if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1:
            for x in [*token(text), end]:
                counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, text in docs:
        c = [counts.get(x, 0) for x in [*token(text), end]]
        out[i] = (zlib.crc32(str("" if i is None else i).encode()) % 5 == 1, len(c), sum(x > 0 for x in c), n,
                  sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c))
    return out


ODD = [(1, "a b a"), (2, None), (3, ""), (4, "zz " * 5000), (5, "A ünï"), (None, "b b b"), (7, "x" * 20_000), (8, "zz a\tb")]


@pytest.mark.parametrize("head", [2, 1 << 16])
def test_scores_brute_force(spark, documents, folder, table_folder, monkeypatch, head):
    monkeypatch.setattr(mixlm.train, "__defaults__", (head, 1 << 12, 50))
    for where in (table_folder(documents=documents([(*d, "en", "s") for d in ODD])), folder):
        docs = [tuple(r) for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()]
        want = unigram(docs)
        got = QUERIES["op7_context_mixing"](spark, where).collect()
        assert len(got) == len(docs)
        for r in got:
            held, n, known, total, base = want[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
            assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0 and r.bits_per_byte >= 0


def test_model_beats_unigrams_and_is_a_distribution(spark, folder):
    got = QUERIES["op7_context_mixing"](spark, folder).toPandas()
    held = got[got.held_out & (got.n_known == got.n_tokens)]
    assert held.score.sum() > held.base_score.sum()
    # the codes are complete: over all words of up to 2 letters and all texts of one word, mass stays below 1
    rng = np.random.default_rng(0)
    head = np.sort(words(["a b ab"]).hash)
    codes = mixlm.make_codes(head, np.array([5, 3, 2]), 4, 6, np.bincount([97, 98, 97, 256], minlength=257))
    odds = [rng.normal(size=s).astype(np.float32) for s in mixlm._table_sizes(codes, 64)]
    model = mixlm.Predictors(codes, 64, odds, rng.normal(0.4, 0.2, (mixlm.GATES, mixlm.CONTEXTS)).astype(np.float32))

    def score(texts, **options):
        symbols, first, _ = mixlm.symbols_of(words(texts), codes)
        bits = mixlm.decisions(symbols, first, codes)
        return mixlm.mix(model.inputs(bits), bits, model.weights, **options)

    # every first symbol: head words, the escape and the end share all mass
    n = len(codes.first) - 1
    mass = 0.0
    for s in range(codes.n_words):
        bits = mixlm.decisions(np.array([s]), np.array([0, 1]), codes)
        mass += math.exp(mixlm.mix(model.inputs(bits), bits, model.weights)[0])
    assert mass == pytest.approx(1, abs=1e-5) and n == codes.n_words + 257
    # no text sees another, and steps within a text do not depend on its neighbours
    texts = ["a b " * 300, "", "zz yy " * 500, "a", None, "ab c " * 40]
    together = score(texts, block=64)
    alone = [score([t], block=64)[0] for t in texts]
    assert together == pytest.approx(alone, rel=1e-5)


def test_training_on_nothing(spark, documents):
    rows = documents([]).selectExpr("doc_id AS row", "text")
    model = mixlm.train(rows, F.col("text"), F.col("row"), slots=1 << 10)
    assert model.n == 0 and mixlm.score_texts(rows, F.col("text"), model).count() == 0
    some = documents([(1, "a b", "en", "s"), (2, None, "en", "s")]).selectExpr("doc_id AS row", "text")
    got = mixlm.score_texts(some, F.col("text"), model).collect()
    assert {r.n_known for r in got} == {0} and all(r.score < 0 for r in got)
    clash = some.selectExpr("*", "'x' AS n_tokens", "1 AS rare", "2 AS Score", "3 AS more")
    again = mixlm.score_texts(clash, F.col("text"), model)
    assert again.columns == ["row", "more", *mixlm.RESULTS]
    assert {(r.row, r.n_tokens, r.score) for r in again.collect()} == {(r.row, r.n_tokens, r.score) for r in got}


def test_weights_and_bytes_come_from_all_training_texts(spark, documents):
    # texts longer than any that a sample would take; every third word stands once and is spelled
    long = [" ".join(f"the {w} of x{k}z{i}" for i, w in enumerate(["cat", "dog", "cow"] * 2500)) for k in range(2)]
    rows = documents([(k, t, "en", "s") for k, t in enumerate(long)]).selectExpr("doc_id AS row", "text")
    model, other = (mixlm.train(r, F.col("text"), F.col("row"), 5, 1 << 12).predictors
                    for r in (rows, rows.repartition(2, "row")))
    assert min(len(t) for t in long) > 50_000 and (np.abs(model.weights - 0.3) > 0.05).any()
    assert (model.weights == other.weights).all()
    size = np.diff(model.codes.first)[model.codes.n_words:]
    assert size[ord("z")] < size[ord("q")]  # z is in every spelled word, q in none
    # a bit is left out of its own counts: one that is alone in its slot is as if nothing was seen there
    seen = mixlm.seen_of(np.array([1, 0, 0, 1]))[0]
    assert seen.level[2 * seen.kind[0]] == seen.level[2 * seen.kind[1] + 1] == mixlm.seen_of(np.zeros(2))[0].level[0]
    counts = np.array([0, 255, 256, 70_000, 1 << 40, 0])
    assert all((mixlm.unpacked(mixlm.packed(counts[:k])) == counts[:k]).all() for k in range(7))


def test_items_that_repeat_an_id_count_once(documents, spark):
    text = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([("i1", text), ("i1", "alpha beta"), ("i2", "gamma")], "item_id string, text string")
    docs = documents([(1, f"x {text} alpha beta y", "en", "s"), (2, "alpha", "en", "s")]).withColumn("row", F.col("doc_id"))
    for size in (1, 1 << 20):  # a block for each item, and one for all
        got = fmindex.find_passages(docs, F.col("text"), bench, block_bytes=size).collect()
        assert sorted((r["n_words"], r["items"]) for r in got) == [(1, []), (14, ["i1"])]


def test_every_bit_moves_the_weights_of_its_gate():
    rng = np.random.default_rng(4)
    codes = mixlm.make_codes(np.sort(words(["a b ab"]).hash), np.array([5, 3, 2]), 4, 6,
                             np.bincount([97, 98, 97, 256], minlength=257))
    odds = [rng.normal(size=s).astype(np.float32) for s in mixlm._table_sizes(codes, 64)]
    model = mixlm.Predictors(codes, 64, odds, rng.normal(0.4, 0.2, (mixlm.GATES, mixlm.CONTEXTS)).astype(np.float32))
    texts = ["a b ab a", "", "zz yy " * 20, "b", "ab c " * 9]  # all of less than 2,048 bits
    bits = mixlm.decisions(*mixlm.symbols_of(words(texts), codes)[:2], codes)
    x, want = model.inputs(bits), []
    for p, q in zip(bits.borders[:-1], bits.borders[1:]):
        weights, cost = model.weights.astype(float), 0.0
        for i in range(p, q):
            own, sign = weights[bits.gate[i]], 2 * int(bits.bit[i]) - 1
            chance = 1 / (1 + math.exp(-sign * float(own @ x[:, i])))
            cost -= math.log(chance)
            own += mixlm.RATE * sign * (1 - chance) * x[:, i]
        want.append(-cost)
    assert mixlm.mix(x, bits, model.weights) == pytest.approx(want, rel=1e-4)
    assert mixlm.mix(x, bits, model.weights, rate=0) != pytest.approx(want, rel=1e-2)
    parts = [mixlm.decisions(*mixlm.symbols_of(words(texts[a:b]), codes)[:2], codes) for a, b in ((0, 2), (2, 5))]
    joined = mixlm.one_behind_the_other([p.mixed_only() for p in parts])
    assert mixlm.mix(np.concatenate([model.inputs(p) for p in parts], axis=1), joined, model.weights) == pytest.approx(want, rel=1e-4)
