"""Text columns to vector columns; the embedder is a parameter."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


DIMENSIONS = 256
TOKEN_PATTERN = r"(?U)[^\p{L}\p{N}]+"

Embedder = Callable[[DataFrame, str, str], DataFrame]


@dataclass
class HashedTfIdf:
    """Default embedder: hashed term weights, normalised.

    Fitting makes one pass whose result has ``dimensions`` numbers; embedding
    is a projection without a shuffle. Use one fitted model for both sides.
    """

    model: PipelineModel

    @staticmethod
    def fit(texts: DataFrame, text: str, dimensions: int = DIMENSIONS) -> HashedTfIdf:
        stages = [
            RegexTokenizer(inputCol="_text", outputCol="_tokens", pattern=TOKEN_PATTERN),
            HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimensions),
            IDF(inputCol="_tf", outputCol="_weights"),
            Normalizer(inputCol="_weights", outputCol="_unit", p=2.0),
        ]
        held = texts.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
        return HashedTfIdf(Pipeline(stages=stages).fit(held))

    def __call__(self, df: DataFrame, text: str, output: str) -> DataFrame:
        held = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
        embedded = self.model.transform(held).withColumn(output, vector_to_array("_unit", "float32"))
        return embedded.drop("_text", "_tokens", "_tf", "_weights", "_unit")


def model_embedder(load: Callable[[], Callable], batch: int = 256) -> Embedder:
    """Embedder around a model: ``load()`` runs once per task and returns a
    function from a list of texts to a list of vectors."""

    def embed(df: DataFrame, text: str, output: str) -> DataFrame:
        @F.pandas_udf("array<float>")
        def run(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = load()
            for texts in chunks:
                vectors = []
                for at in range(0, len(texts), batch):
                    vectors.extend(encode(texts.iloc[at : at + batch].fillna("").tolist()))
                yield pd.Series(vectors)
        return df.withColumn(output, run(F.col(text)))

    return embed


def guarded_embedder(load: Callable[[], Callable], batch: int = 256) -> Embedder:
    """:func:`model_embedder` whose failures are rows: a text that the model cannot embed has a NULL vector and the reason in
    ``<output>_error``. A batch that fails is tried text by text, so one text does not cost the others."""

    def embed(df: DataFrame, text: str, output: str) -> DataFrame:
        @F.pandas_udf("vector array<float>, error string")
        def run(chunks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model, broken = None, None
            try:
                model = load()
            except Exception as failure:  # noqa: BLE001
                broken = _reason(failure)
            for texts in chunks:
                held = texts.fillna("").tolist()
                vectors, errors = [None] * len(held), [broken] * len(held)
                for at in range(0, len(held) if model else 0, batch):
                    part = held[at : at + batch]
                    try:
                        found = list(model(part))
                        if len(found) != len(part):
                            raise ValueError(f"{len(found)} vectors for {len(part)} texts")
                        vectors[at : at + len(part)] = found
                    except Exception:  # noqa: BLE001
                        for place, one in enumerate(part, at):
                            try:
                                vectors[place] = list(model([one]))[0]
                            except Exception as failure:  # noqa: BLE001
                                errors[place] = _reason(failure)
                yield pd.DataFrame({"vector": vectors, "error": errors})

        held = df.withColumn("_embedded", run(F.col(text)))
        return held.select(*df.columns, F.col("_embedded.vector").alias(output), F.col("_embedded.error").alias(f"{output}_error"))

    return embed


def _reason(failure: Exception) -> str:
    return str(failure) or type(failure).__name__


EMBEDDERS: dict[str, Callable[..., Embedder]] = {}


def register_embedder(name: str, make: Callable[..., Embedder]) -> None:
    """Let ``make(texts, text, **options)`` answer to ``name``; ``texts`` are what a fitted embedder learns from."""
    EMBEDDERS[name] = make


def embedder_named(name: str, texts: DataFrame, text: str = "text", **options) -> Embedder:
    """The embedder registered under ``name``; an unknown name is an error."""
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedding model: {name}")
    return EMBEDDERS[name](texts, text, **options)


register_embedder("hashed-tfidf", HashedTfIdf.fit)


def embed_documents(documents: DataFrame, embedder: Embedder, text: str = "text", output: str = "embedding") -> DataFrame:
    return embedder(documents, text, output)
