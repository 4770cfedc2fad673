import pytest
from pyspark.sql import functions as F

from corpusloom.operators import knowledge as K
from corpusloom.operators.embed import HashedTfIdf, embedder_named, guarded_embedder, model_embedder, register_embedder

DOCS = [
    (0, "road.pdf", "speed limit on the highway"), (1, "road.pdf", "parking rules downtown"),
    (2, "bike.pdf", "motorcycle helmet rules"), (3, "bike.pdf", "speed of a motorcycle"),
]
ASKED = [
    (1, "highway speed limit"), (2, "file:bike.pdf:speed limit on the highway"), (3, "file:none.pdf:speed"),
    (4, "file: not scoped"),
]


def test_questions(spark):
    got = K.read_questions(spark.createDataFrame(ASKED, "query_id bigint, text string")).orderBy("query_id").collect()
    assert [(r["scope"], r["question"]) for r in got] == [
        (None, "highway speed limit"), ("bike.pdf", "speed limit on the highway"), ("none.pdf", "speed"),
        (None, "file: not scoped"),
    ]


def test_contexts(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, source string, text string")
    embedder = HashedTfIdf.fit(docs, "text", 4096)
    index = embedder(docs, "text", "embedding").withColumnRenamed("doc_id", "vec_id").drop("text")
    asked = spark.createDataFrame(ASKED, "query_id bigint, text string")
    hits = {}
    for r in K.find(asked, index, embedder, 2).orderBy("query_id", "rank").collect():
        hits.setdefault(r["query_id"], []).append(r["vec_id"])
    assert hits[1][0] == 0 and hits[2] == [3, 2] and 3 not in hits
    found = {r["query_id"]: r["context"] for r in K.contexts(asked, index, docs, embedder, 1).collect()}
    assert found[1] == "[Document 1] (Source: road.pdf):\nspeed limit on the highway"
    assert found[3] == "No relevant information found in the knowledge base."


def test_a_failing_question_is_a_row_and_the_others_are_answered(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, source string, text string")

    def load():
        def model(texts):
            if any("boom" in text for text in texts):
                raise RuntimeError("no vector for boom")
            return [[float("speed" in text), float("rules" in text), 1.0] for text in texts]

        return model

    embedder = guarded_embedder(load, batch=8)
    held = embedder(docs, "text", "embedding")
    index = held.withColumnRenamed("doc_id", "vec_id").drop("text", "embedding_error")
    asked = spark.createDataFrame([(1, "speed"), (2, "boom"), (3, "file:none.pdf:rules"), (4, None)], "query_id bigint, text string")
    found = {r["query_id"]: r for r in K.answers(asked, index, docs, embedder, 1, "l2").collect()}
    assert found[2]["context"] == "Error searching knowledge base: no vector for boom"
    assert (found[2]["success"], found[2]["error"], found[2]["hits"]) == (False, "no vector for boom", 0)
    assert found[1]["success"] and found[1]["context"].startswith("[Document 1]")
    assert found[3]["context"] == "No relevant information found in the knowledge base." and found[3]["success"]
    assert found[4]["success"] and len(found) == 4

    def missing():
        raise OSError("no such model")

    rows = {r["query_id"]: r for r in K.answers(asked, index, docs, guarded_embedder(missing), 1, "l2").collect()}
    assert all(not r["success"] and r["error"] == "no such model" for r in rows.values()) and len(rows) == 4
    models = {"good": embedder, "bad": ValueError("unknown embedding model: bad")}
    own = index.withColumn("embedding_model", F.lit("good"))
    runs = K.runs(asked, own, docs, models, (1, 2)).collect()
    assert len(runs) == 16 and {(r["embedding_model"], r["success"]) for r in runs} == {("good", True), ("good", False), ("bad", False)}
    assert all(r["error"] == "unknown embedding model: bad" for r in runs if r["embedding_model"] == "bad")


def test_embedders_by_name(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, source string, text string")
    vectors = embedder_named("hashed-tfidf", docs, "text", dimensions=16)(docs, "text", "v").collect()
    assert {len(r["v"]) for r in vectors} == {16}
    with pytest.raises(ValueError, match="unknown embedding model: nosuch"):
        embedder_named("nosuch", docs)
    register_embedder("lengths", lambda texts, text: model_embedder(lambda: lambda held: [[float(len(t))] for t in held]))
    assert sorted(r["v"][0] for r in embedder_named("lengths", docs)(docs, "text", "v").collect()) == [21.0, 22.0, 23.0, 26.0]
