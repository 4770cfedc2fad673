import math
import random
import re
from collections import Counter

import pytest

from corpusloom.operators.embed import HashedTfIdf, embed_documents, model_embedder
from corpusloom.operators.textsearch import _Searcher, build_index, search_index, tfidf_search

DOCS = ["the cat sat", "the dog sat on the cat", "", "Élan vital the", "dog dog dog", "the the the", "the cat sat"]
ASKED = ["cat sat", "DOG", "nothing known here", "élan"]


def brute(docs, asked, k):
    tokens = [[t for t in re.split(r"[\W_]+", d.lower()) if t] for d in docs]
    df = Counter(t for own in tokens for t in set(own))
    idf = {t: math.log((len(docs) + 1) / (n + 1)) for t, n in df.items()}

    def weights(own):
        return {t: n * idf[t] for t, n in Counter(own).items() if t in idf}

    held = [weights(own) for own in tokens]
    found = {}
    for q, text in enumerate(asked):
        query = weights([t for t in re.split(r"[\W_]+", text.lower()) if t])
        scores = []
        for d, doc in enumerate(held):
            dot = sum(w * doc[t] for t, w in query.items() if t in doc)
            norms = math.sqrt(sum(w * w for w in query.values()) * sum(w * w for w in doc.values()))
            if norms and round(dot / norms, 6) > 0:
                scores.append((-round(dot / norms, 6), d))
        if scores:
            found[q] = [d for _, d in sorted(scores)[:k]]
    return found


@pytest.mark.parametrize("bound", [200_000, 2])
def test_agrees_with_brute_force(spark, bound):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id bigint, text string")
    asked = spark.createDataFrame(list(enumerate(ASKED)), "item_id bigint, text string")
    got = {}
    for r in tfidf_search(docs, asked, 3, max_broadcast_terms=bound).orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append(r["doc_id"])
    assert got == brute(DOCS, ASKED, 3)


def test_default_embedder(spark):
    docs = spark.createDataFrame(list(enumerate([*DOCS, None])), "doc_id bigint, text string")
    embedder = HashedTfIdf.fit(docs, "text", 64)
    rows = {r["doc_id"]: r["embedding"] for r in embed_documents(docs, embedder).collect()}
    assert {len(v) for v in rows.values()} == {64}
    assert rows[0] == rows[6] and rows[0] != rows[1]
    assert sum(x * x for x in rows[1]) == pytest.approx(1.0, abs=1e-5)
    assert not any(rows[2]) and not any(rows[7])


def test_own_model(spark):
    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id bigint, text string")
    rows = {r["doc_id"]: r["v"] for r in embed_documents(docs, model_embedder(load, 1), output="v").collect()}
    assert rows == {1: [3.0, 1.0], 2: [0.0, 1.0]}


def test_terms_of_any_script_and_digits(spark):
    docs = spark.createDataFrame([(1, "привет мир"), (2, "2024 東京"), (3, "other words")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "ПРИВЕТ"), (2, "東京 2024")], "item_id bigint, text string")
    found = {r["item_id"]: r["doc_id"] for r in tfidf_search(docs, asked, 1).collect()}
    assert found == {1: 1, 2: 2}


def many_texts(count):
    pick = random.Random(3)
    rare = [f"w{n}" for n in range(300)]
    return [" ".join(["the"] * pick.randrange(9) + [pick.choice(rare) for _ in range(pick.randrange(12))]) for _ in range(count)]


def test_shards_and_passes_change_nothing(spark):
    texts = many_texts(900)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    asked = [texts[at] + " the" for at in range(0, 900, 60)] + ["the", "absent", ""]
    queries = spark.createDataFrame(list(enumerate(asked)), "item_id int, text string")
    wanted = brute(texts, asked, 5)
    for size, bound in ((1 << 24, 200_000), (2000, 20)):
        index, idf = build_index(docs, shard_bytes=size)
        got = {}
        for r in search_index(index, idf, queries, 5, max_broadcast_terms=bound).orderBy("item_id", "rank").collect():
            got.setdefault(r["item_id"], []).append(r["doc_id"])
        assert got == wanted


def test_blocks_below_the_last_score_are_not_looked_up(spark):
    texts = [f"the the the r{n % 200}" for n in range(4000)] + ["the rare"]
    index, _ = build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1))
    row = index.filter("array_contains(ids, 4000)").first().asDict()
    opened = _Searcher({name: value if name in ("shard", "ids") else bytes(value) for name, value in row.items()})
    places, scores = opened.search([("rare", 0.99), ("r7", 0.1), ("the", 0.01)], 1, 0.0)
    assert [row["ids"][at] for at in places] == [4000] and opened.looked_up <= 2 < len(row["ids"]) // 64


def test_an_empty_table_has_no_hits(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "a"), (2, None)], "item_id bigint, text string")
    assert tfidf_search(docs.limit(0), queries).collect() == []
    assert tfidf_search(docs, queries.limit(0)).collect() == []
    assert [tuple(r)[:2] for r in tfidf_search(docs, queries).collect()] == [(1, 1)]
