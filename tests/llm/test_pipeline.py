"""The pipeline stage by stage, each against its own input."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from corpusloom.llm import minhash, mixing, secrets

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    frames = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for number, (_, function) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(number))
        function(spark, frames[-1], FOLDER).write.parquet(path)
        frames.append(spark.read.parquet(path))
    return frames


def test_registered():
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} == {
        name.split("_")[0] for name in entry.queries() if name == "pipeline" or name.startswith("op") and name[2].isdigit()
    }


def test_stages(staged):
    docs, good, single, clean, mixed, packed = staged
    for before, after in zip(staged[:4], staged[1:5], strict=True):
        assert before.columns == after.columns and before.schema.simpleString() == after.schema.simpleString()
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{FOLDER}/labels.parquet'").fetchall())
    kept = {row["doc_id"] for row in good.select("doc_id").collect()}
    every = {row["doc_id"] for row in docs.select("doc_id").collect()}
    right = [(d in kept) == bool(labels[d]) for d in every if d in labels]
    assert sum(right) / len(right) > 0.95
    groups = minhash.groups(good).where("one").count()
    assert single.count() == groups < good.count()
    texts = {row["doc_id"]: row["text"] for row in single.collect()}
    for row in clean.collect():
        spans = secrets.all_spans(texts[row["doc_id"]])
        assert row["text"] == secrets.blank(texts[row["doc_id"]], spans) and row["n_chars"] == len(row["text"])
        assert not [s for s in secrets.all_spans(row["text"]) if s[0] != "assign"]
    chosen = mixing.mix(clean.select("doc_id", "source", mixing.words(F.col("text")).alias("size")))
    wanted = {row["doc_id"]: row["copies"] for row in chosen.collect() if row["copies"]}
    assert wanted == {row["doc_id"]: row["count"] for row in mixed.groupBy("doc_id").count().collect()}
    assert packed.where("piece = 0").count() == mixed.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_stages_take_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", None, None, "x"), (2, "", None, "a", 0, None), (2, "", None, "a", 0, None), (None, "a b " * 9, "en", "a", 36, "x")],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id string",
    )
    for rows in (docs, docs.where("doc_id > 9")):
        for name, function in corpus_pipeline.STAGES[:-1]:
            assert function(spark, rows, FOLDER).columns == docs.columns, name
            function(spark, rows, FOLDER).collect()
        corpus_pipeline.pack(spark, rows, FOLDER).collect()
