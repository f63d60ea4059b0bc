"""The stages of the corpus pipeline against plain Python, on given and on odd tables."""

import re

import pytest

import corpus_pipeline
from test_models import hits
from test_words import grams_of

STAGE = dict(corpus_pipeline.STAGES)


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def test_stages_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, folder)
        assert state.columns == docs.columns
        after = {r.doc_id: r for r in state.collect()}
        texts = {i: r.text for i, r in before.items()}
        if name == "language_id":
            gone = set(before) - set(after)
            assert all(not re.search(r"[^\W\d_]", texts[i] or "") for i in gone)
        elif name == "exact_dedup":
            best = {}
            for i, t in texts.items():
                best[lowered(t)] = max(i, best.get(lowered(t), i))
            assert set(after) == set(best.values())
        elif name == "ngram_jaccard_join":
            grams = {i: grams_of(t) for i, t in texts.items()}
            near = lambda a, b: len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])
            ids = sorted(after)
            assert not any(near(a, b) for k, a in enumerate(ids) for b in ids[k + 1:])
            assert all(any(near(g, i) for i in before if i != g) for g in set(before) - set(after))
        else:
            want = hits([(i, r.text) for i, r in before.items()], bench)
            assert set(after) == {i for i, w in want.items() if not w[4] or w[1] < w[0]}
            left = hits([(i, r.text) for i, r in after.items()], bench)
            for i, r in after.items():
                assert (r == before[i]) if not want[i][4] else left[i][0] == want[i][0] - want[i][1]
        before = after
    mixed = STAGE["source_mix"](spark, state, folder).toPandas()
    assert (mixed.taken > 0).all() and (mixed.taken <= 2 * mixed["size"]).all()
    for _, part in mixed.groupby("source"):
        assert part.taken.sum() == round(part.target.iloc[0])


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and {"doc_id", "text", "taken"} <= set(out.columns)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_tables(spark, documents, table_folder, empty):
    rows = [(1, "the cat sat on the mat today", "en", "a"), (1, "the cat sat on the mat today", "en", "a"), (None, None, None, None),
            (3, "", "en", "b"), (4, "tiny item", "en", None), (5, "der Hund und die Katze gehen heim", "de", "b"),
            (6, "the cat sat on the mat TODAY", "en", "a"), (7, "12 34", None, "c"), (8, "the dog and a cow " * 4000, "en", "c")]
    docs = documents([] if empty else rows).selectExpr("*", "doc_id AS row", "text AS doc", "1 AS size", "2 AS taken", "3 AS kept", "4 AS label")
    folder = table_folder(documents=docs, benchmark=spark.createDataFrame([(1, "tiny item")], "item_id long, text string"))
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*docs.columns, "size_", "source_size", "target", "taken_", "first_slot"]
    got = sorted(r.doc_id for r in out.collect())
    assert set(got) <= {5, 6, 8} and len(got) == len(set(got)) and (empty or len(got) >= 2)
