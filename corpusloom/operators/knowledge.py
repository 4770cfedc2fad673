"""Text questions answered with ranked context from an embedded corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import search
from corpusloom.operators.embed import Embedder
from corpusloom.session import stage

# What a failed search answers; a question may name one file to search, as file:<name>:<question>.
SEARCH_FAILED = "Error searching knowledge base: "
FILE_QUESTION = r"(?s)\Afile:([^:]+):(.*)\z"


def read_questions(questions: DataFrame, text: str = "text") -> DataFrame:
    """Add ``scope`` (the file a question names, else NULL) and ``question``."""
    named = F.nullif(F.regexp_extract(text, FILE_QUESTION, 1), F.lit(""))
    asked = F.when(named.isNull(), F.col(text)).otherwise(F.regexp_extract(text, FILE_QUESTION, 2))
    return questions.withColumn("scope", named).withColumn("question", F.trim(asked))


def find(
    questions: DataFrame,
    index: DataFrame,
    embedder: Embedder,
    k: int = search.DEFAULT_K,
    metric: str = "cosine",
) -> DataFrame:
    """The k best rows of ``index(vec_id, embedding, source)`` per question.

    ``questions`` holds ``query_id, text``. A question that names a file is
    scored against that file only, so it gets k rows whenever the file has them.
    """
    return _find(_asked(questions, embedder), index, k, metric)


def _asked(questions: DataFrame, embedder: Embedder) -> DataFrame:
    """Questions with their vector, made once, and why one has none."""
    asked = embedder(read_questions(questions), "question", "query_vector")
    if "query_vector_error" not in asked.columns:
        asked = asked.withColumn("query_vector_error", F.lit(None).cast("string"))
    return stage(asked, "questions")


def _find(asked: DataFrame, index: DataFrame, k: int, metric: str) -> DataFrame:
    everywhere = search.nearest(index, asked.filter("scope IS NULL"), metric, k)
    scoped = search.search_own_source(index, asked.filter("scope IS NOT NULL"), metric, k)
    return everywhere.unionByName(scoped)


def contexts(
    questions: DataFrame,
    index: DataFrame,
    documents: DataFrame,
    embedder: Embedder,
    k: int = search.DEFAULT_K,
    metric: str = "cosine",
) -> DataFrame:
    """One assembled context per question; the fixed message when nothing is found, or when the search failed."""
    return answers(questions, index, documents, embedder, k, metric).select("query_id", "hits", "context")


def answers(
    questions: DataFrame,
    index: DataFrame,
    documents: DataFrame,
    embedder: Embedder,
    k: int = search.DEFAULT_K,
    metric: str = "cosine",
) -> DataFrame:
    """``query_id, query, hits, context, success, error`` per question.

    A question whose embedding fails (see :func:`embed.guarded_embedder`) is a failure row with the fixed message and the
    reason; the others are answered.
    """
    asked = _asked(questions, embedder)
    hits = search.with_documents(_find(asked, index, k, metric), documents, ["source", "text"])
    found = search.assemble_context(hits, asked)
    failed = F.col("query_vector_error").isNotNull()
    return asked.select("query_id", F.col("question").alias("query"), "query_vector_error").join(found, "query_id").select(
        "query_id",
        "query",
        "hits",
        F.when(failed, F.concat(F.lit(SEARCH_FAILED), "query_vector_error")).otherwise(F.col("context")).alias("context"),
        (~failed).alias("success"),
        F.col("query_vector_error").alias("error"),
    )


def runs(
    questions: DataFrame,
    index: DataFrame,
    documents: DataFrame,
    models: dict[str, Embedder | Exception],
    ks: tuple[int, ...] = search.K_CHOICES,
    algorithm: str = "faiss_l2",
    metric: str = "l2",
) -> DataFrame:
    """A row per question, embedding model and number of chunks in the form of the run table, failures among them.

    ``index`` maps a model to its rows by the column ``embedding_model``. A model that could not be made, given as its
    error, fails for every question. Times are measured by the caller and stay NULL.
    """
    parts = []
    for name, embedder in models.items():
        if isinstance(embedder, Exception):
            reason = str(embedder) or type(embedder).__name__
            asked = questions.select("query_id", F.col("text").alias("query"), F.lit(0).cast("bigint").alias("hits"), F.lit("").alias("context"))
            asked = asked.select("*", F.lit(False).alias("success"), F.lit(reason).alias("error"))
            found = [(k, asked) for k in ks]
        else:
            own = index.filter(F.col("embedding_model") == name)
            found = [(k, answers(questions, own, documents, embedder, k, metric)) for k in ks]
        parts += [
            rows.select(
                "query_id", F.lit(name).alias("embedding_model"), F.lit(algorithm).alias("search_algorithm"),
                F.lit(k).alias("chunk_size"), "query", F.col("hits").alias("chunks_retrieved"),
                F.when(F.col("success"), F.length("context").cast("bigint")).otherwise(F.lit(0)).alias("response_length"),
                "success", "error",
            )
            for k, rows in found
        ]
    return reduce(DataFrame.unionByName, parts)
