"""Documents to a training mix: language, exact and near copies, benchmark passages, weights.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows of its predecessor
and returns a table; ``run`` writes each as Parquet in the shared folder and reads
it back for the next one, so a lost executor costs at most one stage. All stages
but the last return the columns of ``docs``; the last adds the mix's columns.
Null or empty texts have no letter and go in the first stage; an empty table
passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlynx.llm import fmindex, forest, langid, mixing, radix
from ledgerlynx.llm.common import as_rows, doc_field, dropped, id_remainder, numbered, written


#: Rows that go to a Python worker at once: texts can be long, and a batch stands in
#: memory on both sides.
BATCH_ROWS = 1000


def _bounded_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: ``und`` and ambiguous ones go. Where no row has a label
    nothing can be learned and all stay."""
    _bounded_batches(spark)
    model = langid.train(docs.where(id_remainder(F.col("doc_id"), 3) != 1))
    if not model.langs:
        return docs
    found = langid.with_language(as_rows(docs), doc_field("text"), model)
    return found.where("lang_pred <> 'und' AND NOT ambiguous").select("doc.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z as a-z) the document with the largest id."""
    return radix.exact_dedup(docs).where("kept").select("doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 or more the first document."""
    _bounded_batches(spark)
    rows = numbered(docs, "near-docs")
    found = forest.jaccard_join(rows, doc_field("text"))
    drop = written(found.where("row <> class_row").select("row"), "near-drop")
    return rows.join(drop, "row", "left_anti").select("doc.*")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; documents of which no word is left go."""
    _bounded_batches(spark)
    return fmindex.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``size, source_size, target, taken`` (words, repeats
    counted) and ``first_slot``, the place in the schedule where each begins."""
    mix = mixing.mix_sources(docs)
    names = {}
    for name in ("size", "source_size", "target", "taken", "first_slot"):
        free = name
        while free in docs.columns:
            free += "_"
        names[name] = free
    return mix.rows.join(mix.taken.where("taken > 0"), "row").select(
        *[doc_field(c).alias(c) for c in docs.columns], *[F.col(n).alias(a) for n, a in names.items()])


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_passages),
    ("source_mix", mixed_sources),
]
#: Trained classifiers, hashed signatures and suffix indexes have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return docs
