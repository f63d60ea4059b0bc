"""Mixing and exact copies: SQL on given tables, brute force on odd ones."""

import hashlib
from collections import Counter, defaultdict

import pytest
from oracle_check import connect, differences

from ledgerlynx.llm import mixing, radix
from ledgerlynx.llm.queries import ORACLES, QUERIES

ODD = [
    (1, "Same Text here", "en", "b"), (2, "same text HERE", "en", "a"), (2, "same text HERE", "en", "a"),
    (3, None, None, None), (4, "", "en", None), (5, "Ärger", "de", "B"), (6, "ärger", "de", "b"),
    (None, "same text here", "en", "a"), (7, "x" * 3000 + "A", "en", "a"), (8, "x" * 3000 + "a", "en", "a"),
    (9, "x" * 3000 + "b", "en", "a"), (10, "x" * 3000, "en", "\U0001F600"), (11, " \t\n", "en", "a"),
    (12, "one two  three four", "en", "b"),
]


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, folder, name):
    assert differences(spark, connect(folder), folder, name, QUERIES[name], ORACLES[name]) is None


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize("first,growth", [(64, 16), (1, 1), (2, 2)])
def test_radix_brute_force(documents, first, growth):
    rows = [r for r in ODD if first > 2 or len(r[1] or "") < 50]
    docs = documents(rows)
    grouped = radix.radix_groups(docs.selectExpr("struct(doc_id, text) AS carry", "CAST(lower(text) AS BINARY) AS key"),
                                 first, growth)
    groups = defaultdict(list)
    for r in grouped.collect():
        groups[r.grp].append((r.carry.text or "").lower())
    single = groups.pop(None, [])
    counts = Counter((r[1] or "").lower() for r in rows)
    assert sorted(single) == sorted(t for t, n in counts.items() if n == 1)
    assert sorted(map(sorted, groups.values())) == sorted([t] * n for t, n in counts.items() if n > 1)


def test_dedup_of_odd_rows(documents, table_folder, spark):
    folder = table_folder(documents=documents(ODD))
    got = QUERIES["op4_radix_dedup"](spark, folder).collect()
    assert len(got) == len(ODD)
    size = Counter(lowered(r[1]) for r in ODD)
    best = {t: max((r[0] for r in ODD if lowered(r[1]) == t and r[0] is not None), default=None) for t in size}
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): t for t in size}
    kept = Counter()
    for r in got:
        text = by_hash[r.text_sha256]
        assert (r.group_size, r.keep_id) == (size[text], best[text])
        kept[text] += r.kept
    assert set(kept.values()) == {1}


def test_dedup_keeps_clashing_columns_and_empty_tables(documents):
    docs = documents(ODD).selectExpr("*", "doc_id AS carry", "text AS grp", "1 AS `key`", "2 AS kept")
    out = radix.exact_dedup(docs).where("kept").select("doc.*")
    assert out.columns == docs.columns and out.count() == len({lowered(r[1]) for r in ODD})
    assert radix.exact_dedup(docs.limit(0)).count() == 0


def test_targets_stop_and_share_again(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, "d": 400, None: 50}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    weight, full, total = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1])), set(), 1.5 * sum(sizes.values())
    while True:
        unit = (total - sum(2 * sizes[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in sizes if s not in full and unit * weight[s] > 2 * sizes[s]}
        if not more:
            break
        full |= more
    assert got == pytest.approx({s: 2.0 * n if s in full else unit * weight[s] for s, n in sizes.items()})


def test_mix_takes_the_targets(documents, spark):
    rows = ODD + [(100 + i, "w " * (i % 40), "en", "abc"[i % 3 if i % 5 else 0]) for i in range(400)]
    docs = documents(rows).selectExpr("*", "doc_id AS row", "n_chars AS size", "source AS taken")
    mix = mixing.mix_sources(docs, block_words=7)
    again = mixing.mix_sources(docs.repartition(7), block_words=7)
    got = mix.rows.selectExpr("row", "doc.source AS source", "doc.doc_id AS id").join(mix.taken, "row").toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    for _, part in got.groupby("source", dropna=False):
        assert part.taken.sum() == round(part.target.iloc[0])
        assert part["size"].sum() == part.source_size.iloc[0]
    other = again.rows.selectExpr("row", "doc.source AS source", "doc.doc_id AS id").join(again.taken, "row").toPandas()
    key = ["source", "id", "size", "taken", "first_slot"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, other[key].values.tolist()))
    # every prefix of the schedule is near the weights: low discrepancy
    plan = mix.schedule.groupBy("slot", "source_key").agg({"words": "sum"}).orderBy("slot").toPandas()
    share = plan.source_key.value_counts(normalize=True)
    for n in (len(plan) // 3, len(plan) // 2):
        part = plan.source_key[:n].value_counts()
        assert all(abs(part.get(k, 0) - n * s) <= 4 for k, s in share.items())


def test_mix_of_nothing(documents):
    for rows in ([], [(1, None, "en", "a"), (2, "", "en", None)]):
        mix = mixing.mix_sources(documents(rows))
        assert [r.taken for r in mix.taken.collect()] == [0] * len(rows) and mix.schedule.count() == 0
