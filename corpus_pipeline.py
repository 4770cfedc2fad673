"""The training-data pipeline over ``documents``: classify, deduplicate, redact, mix, pack.

A stage is called with (spark, docs, sf_dir) and its rows are written as Parquet
before the next one reads them. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import minhash, mixing, packing, quality, secrets
from corpusloom.llm.common import stage, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word near copies."""
    return minhash.deduplicated(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mark, ``n_chars`` counted anew where the text changed."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    sized = docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    chosen = mixing.mix(sized).select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "copies"
    )
    # Rows equal in id, source and words are taken equally often: one row of the choice serves them all.
    times = chosen.where("copies > 0").groupBy("__id", "__source", "__size").agg(F.first("copies").alias("__copies"))
    marked = docs.withColumn("__words", mixing.words(F.col("text")))
    same = (
        F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id"))
        & F.col("source").eqNullSafe(F.col("__source"))
        & (F.col("__words") == F.col("__size"))
    )
    taken = marked.join(times, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return taken.select(*(docs[name] for name in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token ids of every document and their places in sequences."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_classifier", classify),
    ("minhash_near_dedup", deduplicate),
    ("secret_scans", redact),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]

#: The stages train, sketch, draw and tokenise, which SQL cannot repeat; tests check them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
