"""The operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlynx.llm import alignment, bands, chains, edits, fmindex, forest, langid, mixing, mixlm, periodic, radix, secret_scan, sitetree
from ledgerlynx.llm.common import id_remainder, numbered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_mix_sources(spark, folder):
    docs = table(spark, folder, "documents")
    mix = mixing.mix_sources(docs, columns=["doc_id", "source"])
    return mix.rows.join(mix.taken, "row").select(
        "doc.doc_id", "size", "source_size", "target", "taken")


ORACLES["op1_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(concat(CAST(doc_id AS VARCHAR), ':mix')), 1, 10) AS BIGINT) AS place
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0e0 WHEN 1 THEN 1.0e0 ELSE 2.0e0 END AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 2.0e0 * source_size AS most,
    (1.5e0 * sum(source_size) OVER () - coalesce(sum(2.0e0 * source_size) OVER before, 0.0e0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0e0)) AS unit
  FROM sources
  WINDOW before AS (ORDER BY 2.0e0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(most, weight * (SELECT unit FROM levels WHERE weight * unit <= most ORDER BY 2.0e0 * source_size / weight, source LIMIT 1)) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS words,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id) - s.size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(start + size, words) - start)
     + greatest(0, least(start + source_size + size, words) - start - source_size) AS BIGINT) AS taken
FROM placed
"""


@query
def op4_radix_dedup(spark, folder):
    docs = table(spark, folder, "documents")
    found = radix.exact_dedup(docs, carry={"text_sha256": radix.text_sha256(docs["text"])})
    return found.select("doc.doc_id", "keep_id", "group_size", "kept", "doc.text_sha256")


ORACLES["op4_radix_dedup"] = """
WITH plain AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM plain
"""


@query
def op10_fm_decontaminate(spark, folder):
    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    hits = fmindex.find_passages(rows, F.col("text"), benchmark,
                                 keep=["row", "doc_id"])
    n_hit = fmindex.hit_words(F.col("spans"))
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       fmindex.items_sha256(F.col("items")).alias("items_sha256"),
                       (n_hit > 0).alias("contaminated"))


@query
def op2_secret_ledger(spark, folder):
    found = secret_scan.scan(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("findings", lambda f: f["kind"].isin([r.kind for r in secret_scan.BASE]))

    def count(kind: str):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(r.kind) for r in secret_scan.BASE],
                        F.sha2(secret_scan.span_text(base).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.span_text(F.col("findings")).alias("spans"))


@query
def op3_language_codes(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang") \
        .withColumn("held_out", id_remainder(F.col("doc_id"), 3) == 1)
    model = langid.train(docs.where("NOT held_out"))
    return langid.with_language(docs.select("doc_id", "held_out", "text"), F.col("text"), model) \
        .select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query
def op8_site_style_tree(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return sitetree.extract(pages).select("doc.page_id", "doc.url", F.col("main_text").alias("text"),
                                          F.length("main_text").cast("long").alias("n_chars"))


@query
def op5_lsh_forest_join(spark, folder):
    rows = numbered(table(spark, folder, "documents"), "op5-docs", ["doc_id", "text"])
    found = forest.jaccard_join(rows, F.col("doc.text"))
    ids = rows.select("row", "doc.doc_id")
    name = lambda column: ids.select(F.col("row").alias(f"{column}_row"), F.col("doc_id").alias(f"{column}_id"))
    return found.join(ids, "row").join(name("class"), "class_row").join(name("text"), "text_row") \
        .select("doc_id", "class_id", "text_id", "n_links", "n_texts")


@query
def op7_context_mixing(spark, folder):
    rows = numbered(table(spark, folder, "documents"), "op7-docs", ["doc_id", "text"]) \
        .select("row", "doc.doc_id", "doc.text") \
        .withColumn("held_out", id_remainder(F.col("doc_id"), 5) == 1)
    model = mixlm.train(rows.where("NOT held_out"), F.col("text"), F.xxhash64("doc_id"))
    return mixlm.score_texts(rows, F.col("text"), model).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"),
        "base_score", "score", "bits_per_byte")


def revisions(text):
    """The edits of the count query: a deletion, a replacement and an insertion in each text,
    at places that depend on its length."""
    n = F.coalesce(F.length(text), F.lit(0))
    third, half, end = F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int"), F.floor(n * 5 / 6).cast("int")
    change = lambda a, b, t: F.struct(a.alias("start"), b.alias("end"), t.alias("text"))
    return F.array(change(third, F.least(third + 7, half), F.lit("")),
                   change(half, F.least(half + 5, end), F.concat(F.lit("revised "), F.substring(text, 1, 20))),
                   change(end, end, F.lit("\n\nAdded: it's 2024's note.")))


@query
def op6_edit_counts(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    trees = edits.with_trees(docs, F.col("text"))
    out = edits.apply_edits(trees, F.col("text"), revisions(F.col("text")))
    return out.select("doc_id", F.col("tree.sums")[1].alias("n_tokens"),
                      F.col("edited.tree.sums")[1].alias("n_tokens_edited"),
                      F.length("edited.text").cast("long").alias("n_chars_edited"),
                      F.col("edited.encoded_anew").cast("long").alias("n_chars_encoded_anew"))


@query
def op9_collinear_chains(spark, folder):
    rows = numbered(table(spark, folder, "documents"), "op9-docs", ["doc_id", "text"])
    found = chains.repeated_passages(rows, F.col("doc.text"))
    ids = rows.select("row", "doc.doc_id")
    pairs = found.where("size(others) > 0").select("row", F.explode("others").alias("other")) \
        .join(ids.select(F.col("row").alias("other"), F.col("doc_id").alias("other_id")), "other") \
        .groupBy("row").agg(F.array_sort(F.collect_set("other_id")).alias("other_ids"))
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    spans = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])))
    return found.join(ids, "row").join(pairs, "row", "left").select(
        "doc_id", "n_words", n.alias("n_repeated"), spans.alias("spans"),
        F.coalesce("other_ids", F.array().cast("array<bigint>")).alias("other_ids"))


def planted_period(text, doc_id):
    """The text; one in ten (by crc32 of its id) repeats a piece of itself up to its end."""

    @F.pandas_udf("string")
    def plant(texts: pd.Series, ids: pd.Series) -> pd.Series:
        out = texts.tolist()
        for i, key in enumerate(ids):
            h = zlib.crc32((key or "").encode())
            words = out[i].encode().split() if h % 10 == 0 and out[i] else []
            if words:
                n, g = len(words), h // 10
                a = g % n
                period = 1 + (n - a) // (3 + g % 8)
                out[i] = b" ".join(words[:a] + [words[a + k % period] for k in range(n - a)]).decode()
        return pd.Series(out, dtype=object)

    return plant(text, doc_id.cast("string"))  # as text: a null would turn whole numbers into doubles


@query
def op11_periodic_runs(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = periodic.with_runs(docs, planted_period(F.col("text"), F.col("doc_id")))
    runs = F.col("periodic.runs")
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    every = F.when(F.size(runs) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    best = found.withColumn("best", periodic.strongest(runs))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return best.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), sha(every).alias("runs_sha256"),
        sha(F.col("periodic.collapsed")).alias("collapsed_sha256"), F.col("periodic.n_words").alias("n_words"))


@query
def op12_tokenizer_spans(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = alignment.aligned(docs, F.col("text"), with_ends=False)
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    short = found.select("doc.doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "pairs", "times")
    return alignment.with_link_counts(short)


@query
def op13_compression_bands(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = bands.with_bands(bands.with_counts(docs, F.col("text")), F.col("text")).select("doc_id", "counts.*", "bands.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("verdict") == "keep")).alias("kept"),
        F.round("ratio", 6).alias("ratio"), "band", "n_chunks", "n_repetitive_chunks", "n_incompressible_chunks", "verdict")
