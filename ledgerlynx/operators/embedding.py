"""Texts of invoices and the vectors made from them.

An *embedder* is a function ``(df, text_col, out_col) -> df`` that adds an
array-of-double column. ``hash_embedder`` is built in; ``model_embedder`` wraps
a user-supplied model.
"""

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlynx.functions.skew import attach_by_key
from ledgerlynx.functions.text import float_text, or_blank
from ledgerlynx.functions.vectors import hash_vector
from ledgerlynx.session import drop_path, move_path, path_exists

Embedder = Callable[[DataFrame, str, str], DataFrame]

VECTOR = T.ArrayType(T.DoubleType())


def embed_text_pipe(invoices: DataFrame, out: str = "text") -> DataFrame:
    """``vendor | description | category | amount``."""
    return invoices.withColumn(out, F.concat_ws(
        " | ",
        or_blank(F.col("vendor_id")), or_blank(F.col("description")),
        or_blank(F.col("category")), or_blank(float_text(F.col("amount"))),
    ))


def embed_text_labelled(invoices: DataFrame, out: str = "semantic_text") -> DataFrame:
    """The same fields, each with its label."""
    return invoices.withColumn(out, F.concat(
        F.lit("Vendor: "), or_blank(F.col("vendor_id")),
        F.lit(". Description: "), or_blank(F.col("description")),
        F.lit(". Category: "), or_blank(F.col("category")),
        F.lit(". Amount: $"), or_blank(float_text(F.col("amount"))),
    ))


def hash_embedder(df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
    """Placeholder vectors from a digest; needs no model and no Python worker."""
    return df.withColumn(out, hash_vector(F.col(text_col)))


def model_embedder(load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]]) -> Embedder:
    """An embedder around a model.

    ``load`` runs once per Python worker and returns a function from a list of
    texts to a list of vectors.
    """

    def embed(df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
        @F.pandas_udf(VECTOR)
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                vectors = model(texts.fillna("").tolist())
                yield pd.Series([[float(x) for x in v] for v in vectors], index=texts.index)

        return df.withColumn(out, encode(F.col(text_col)))

    return embed


def lexical_embedder(num_features: int = 256) -> Embedder:
    """Hashed word counts, weighed by how few rows hold a word, of unit length;
    compares wording, not meaning. The weights are fitted on the rows given."""

    def embed(df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
        from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
        from pyspark.ml.functions import vector_to_array

        words = RegexTokenizer(inputCol=text_col, outputCol="__words", pattern=r"\W+")
        counts = HashingTF(inputCol="__words", outputCol="__counts", numFeatures=num_features)
        unit = Normalizer(inputCol="__weighed", outputCol="__unit")
        counted = counts.transform(words.transform(df.fillna("", subset=[text_col])))
        if counted.isEmpty():
            return df.withColumn(out, F.lit(None).cast(VECTOR))
        weighed = IDF(inputCol="__counts", outputCol="__weighed").fit(counted).transform(counted)
        vectors = unit.transform(weighed)
        return vectors.withColumn(out, vector_to_array("__unit")) \
            .drop("__words", "__counts", "__weighed", "__unit")

    return embed


def embedder_named(embedder: str | Embedder) -> Embedder:
    if callable(embedder):
        return embedder
    named = {"hash": hash_embedder, "lexical": lexical_embedder()}
    if embedder not in named:
        raise ValueError(f"embedder must be one of {sorted(named)} or a function")
    return named[embedder]


def compute_embeddings(invoices: DataFrame, embedder: str | Embedder = "hash") -> DataFrame:
    """Invoices with ``text`` and its ``embedding``."""
    return embed_once(embed_text_pipe(invoices), "text", embedder)


def embed_distinct(
    df: DataFrame,
    text_col: str,
    embedder: str | Embedder = "hash",
    out: str = "embedding",
) -> DataFrame:
    """Each distinct text once, with its vector and the number of rows that hold it.

    ``EmbeddingCache`` stores the vectors of an expensive model over runs.
    """
    distinct = df.groupBy(text_col).agg(F.count(F.lit(1)).alias("n_rows"))
    return embedder_named(embedder)(distinct, text_col, out)


def embed_once(
    df: DataFrame,
    text_col: str,
    embedder: str | Embedder = "hash",
    out: str = "embedding",
) -> DataFrame:
    """``df`` with the vector of its text; a model sees each distinct text once.

    Vectors are joined back by text, and a text that very many rows share is
    spread over several tasks. The digest is an expression of the row and cheaper
    than a join.
    """
    if embedder == "hash":
        return hash_embedder(df, text_col, out)
    vectors = embed_distinct(df, text_col, embedder, out)
    numbered = df.withColumn("__spread", F.monotonically_increasing_id())
    return attach_by_key(numbered, vectors, [text_col], "n_rows", "__spread", null_safe=True,
                         sizes=df.groupBy(text_col).agg(F.count(F.lit(1)).alias("n_rows"))) \
        .drop("__spread", "n_rows")


class EmbeddingCache:
    """An embedder that stores its vectors and embeds only texts it has never seen.

    ``folder`` holds one table for one model: each text with its digest and vector, in one folder
    per run that found new texts. A run's folder is written beside the table and
    renamed into it when complete, so a failed run leaves nothing half stored and two runs at
    once at worst embed a text twice. Texts are compared as texts; the digest only finds them.
    """

    SCHEMA = T.StructType([T.StructField("digest", T.StringType()), T.StructField("text", T.StringType()),
                           T.StructField("vector", VECTOR)])

    def __init__(self, folder: str, embedder: str | Embedder):
        self.folder, self.embedder = folder.rstrip("/"), embedder

    def known(self, spark: SparkSession) -> DataFrame:
        """The stored texts, each once."""
        if not path_exists(spark, f"{self.folder}/runs"):
            return spark.createDataFrame([], self.SCHEMA)
        rows = spark.read.schema(self.SCHEMA).option("recursiveFileLookup", True).parquet(f"{self.folder}/runs")
        return rows.groupBy("digest", "text").agg(F.any_value("vector").alias("vector"))

    def store(self, df: DataFrame, text_col: str) -> None:
        """Embed and store the texts of ``df`` that are not known yet."""
        spark = df.sparkSession
        texts = df.select(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"),
                          F.col(text_col).alias("text")).distinct()
        known = self.known(spark).select(F.col("digest").alias("__digest"), F.col("text").alias("__text"))
        unseen = texts.join(known, (F.col("digest") == F.col("__digest")) & F.col("text").eqNullSafe(F.col("__text")),
                            "left_anti")
        # written before the model runs: a retried task asks it again for its own rows only
        path = f"{self.folder}/new-{uuid.uuid4().hex}"
        unseen.write.parquet(f"{path}/texts")
        new = spark.read.schema(unseen.schema).parquet(f"{path}/texts")
        if not new.isEmpty():
            embedder_named(self.embedder)(new, "text", "vector").select("digest", "text", "vector") \
                .write.parquet(f"{path}/vectors")
            move_path(spark, f"{path}/vectors", f"{self.folder}/runs/{uuid.uuid4().hex}")
        drop_path(spark, path)

    def __call__(self, df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
        """``df`` with the vectors; only unknown texts meet the model."""
        self.store(df, text_col)
        sizes = df.groupBy(F.col(text_col).alias("__text")).agg(F.count(F.lit(1)).alias("__rows"))
        vectors = self.known(df.sparkSession).select(F.col("text").alias("__text"), F.col("vector").alias(out))
        rows = df.withColumns({"__text": F.col(text_col), "__spread": F.monotonically_increasing_id()})
        return attach_by_key(rows, vectors, ["__text"], "__rows", "__spread", null_safe=True, sizes=sizes) \
            .drop("__text", "__spread")
