import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import ann, search
from corpusloom.plans import retrieval

DIM = 16


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    matrix = rng.normal(size=(300, DIM)).astype(np.float32)
    matrix[100:150] = matrix[7]  # a group of copies
    matrix[299] = 0.0
    rows = [(n, [float(x) for x in v], ("hot" if n % 3 else f"s{n % 4}")) for n, v in enumerate(matrix)]
    corpus = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, source string").repartition(5).cache()
    asked = [(n, [float(x) for x in v]) for n, v in enumerate([matrix[7], matrix[3] * 2, rng.normal(size=DIM), np.zeros(DIM)])]
    queries = spark.createDataFrame(asked, "query_id bigint, query_vector array<double>")
    return corpus, queries, matrix.astype(np.float64), np.array([v for _, v in asked]), [r[2] for r in rows]


def brute(matrix, queries, metric, k, allowed=None):
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n == 0, 1, n)

    found = {}
    for q, query in enumerate(queries):
        if metric == "l2":
            cost = ((matrix - query) ** 2).sum(1)
        elif metric == "ip":
            cost = -(matrix @ query)
        else:
            cost = -(unit(matrix) @ unit(query[None])[0])
        cost = np.round(cost, 6) + 0.0
        ids = [n for n in np.lexsort((np.arange(len(matrix)), cost)) if allowed is None or allowed(n, q)]
        found[q] = [(int(n), round(float(abs(cost[n])), 6)) for n in ids[:k]]
    return found


def result(hits):
    found = {}
    for r in sorted(hits.collect(), key=lambda r: (r["query_id"], r["rank"])):
        own = found.setdefault(r["query_id"], [])
        assert r["rank"] == len(own) + 1
        own.append((r["vec_id"], round(abs(r["score"]), 6)))
    return found


def same(got, expected):
    assert {q: [n for n, _ in hits] for q, hits in got.items()} == {
        q: [n for n, _ in hits] for q, hits in expected.items() if hits
    }
    for q, hits in got.items():
        assert [c for _, c in hits] == pytest.approx([c for _, c in expected[q]], abs=2e-6)


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
@pytest.mark.parametrize("k", [1, 5, 60])
def test_exact_search(data, metric, k):
    corpus, queries, matrix, asked, _ = data
    same(result(search.nearest(corpus, queries, metric, k)), brute(matrix, asked, metric, k))


def test_k_of_zero_and_beyond_the_corpus(data):
    corpus, queries, matrix, asked, _ = data
    assert search.nearest(corpus, queries, "l2", 0).count() == 0
    same(result(search.nearest(corpus, queries, "l2", 1000)), brute(matrix, asked, "l2", 1000))


def test_no_queries_and_no_corpus(data):
    corpus, queries, *_ = data
    assert search.nearest(corpus, queries.filter("query_id < 0")).count() == 0
    assert search.nearest(corpus.filter("vec_id < 0"), queries).count() == 0


def test_unknown_metric_and_strategy(data):
    corpus, queries, *_ = data
    with pytest.raises(ValueError):
        search.nearest(corpus, queries, "hamming")
    with pytest.raises(ValueError):
        search.search("nosuch", corpus, queries)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_tiles_give_the_same_rows(data, metric):
    corpus, queries, matrix, asked, _ = data
    tiled = search.nearest_tiled(corpus, queries, metric, 5, query_rows=2, corpus_rows=80)
    same(result(tiled), brute(matrix, asked, metric, 5))
    beyond = search.nearest(corpus, queries, metric, 5, max_query_rows=2)
    same(result(beyond), brute(matrix, asked, metric, 5))


def test_scoped_search(data):
    corpus, queries, matrix, asked, sources = data
    wanted = ["hot", "s0", "s1", "nosuch"]
    expected = brute(matrix, asked, "l2", 5, lambda n, q: sources[n] == wanted[q])
    scoped = queries.withColumn("scope", F.element_at(F.array(*[F.lit(w) for w in wanted]), (F.col("query_id") + 1).cast("int")))
    same(result(search.search_own_source(corpus, scoped)), expected)
    only = brute(matrix, asked, "l2", 5, lambda n, q: sources[n] == "s1")
    same(result(search.search_by_source(corpus, queries, "s1")), only)
    tiled = search.nearest(
        corpus, scoped.withColumn("keys_", F.array("scope")), "l2", 5, "source", "keys_", max_query_rows=1
    )
    same(result(tiled), expected)


def test_string_query_ids(data):
    corpus, queries, *_ = data
    named = queries.withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    rows = search.nearest(corpus, named, "l2", 2).collect()
    assert {r["query_id"] for r in rows} == {"q0", "q1", "q2", "q3"}


def test_expressions_agree_with_numpy(data):
    corpus, _, matrix, *_ = data
    other = F.array(*[F.lit(float(n)) for n in range(DIM)])
    rows = corpus.select(
        "vec_id",
        V.squared_l2("embedding", other).alias("l2"),
        V.inner_product("embedding", other).alias("ip"),
        V.normalized("embedding").alias("unit"),
    ).collect()
    for r in rows:
        v = matrix[r["vec_id"]]
        assert r["l2"] == pytest.approx(((v - np.arange(DIM)) ** 2).sum())
        assert r["ip"] == pytest.approx(v @ np.arange(DIM))
        norm = np.linalg.norm(v)
        assert r["unit"] == pytest.approx(list(v / norm if norm else v))


def test_cells_with_all_probes_are_exact(data):
    corpus, queries, matrix, asked, _ = data
    hits = search.search("ivf_flat", corpus, queries, 5, cells=6, probes=6)
    same(result(hits), brute(matrix, asked, "l2", 5))


def test_probing_fewer_cells_loses_little(data):
    corpus, queries, *_ = data
    exact = search.search("flat_l2", corpus, queries, 5)
    some = search.search("ivf_flat", corpus, queries, 5, cells=6, probes=3)
    got = ann.recall(some, exact).agg(F.avg("recall")).first()[0]
    assert 0.3 <= got <= 1.0


@pytest.mark.parametrize("kind", ["ivf_flat", "ivf_pq", "hnsw"])
def test_recall_of_the_registered_settings(spark, kind):
    corpus = retrieval.vectors(spark, "/root/testdata/sf0.1")
    queries = corpus.where("vec_id % 20 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vector")
    )
    exact = search.search("flat_l2", corpus, queries)
    some = search.search(kind, corpus, queries, **retrieval.OPTIONS.get(kind, {}))
    got = ann.recall(some, exact).agg(F.count("*"), F.avg("recall")).first()
    assert got[0] == 100 and got[1] >= 0.9


def test_codes_with_reranking(data):
    corpus, queries, matrix, asked, _ = data
    full = search.search("ivf_pq", corpus, queries, 5, cells=2, probes=2, bits=2, rerank=300)
    same(result(full), brute(matrix, asked, "l2", 5))
    with pytest.raises(ValueError):
        ann.build_codes(corpus, parts=5)


def test_buckets_score_each_pair_once(data):
    corpus, queries, matrix, asked, _ = data
    wide = search.search("hnsw", corpus, queries, 5, tables=3, length=1000.0)
    # Buckets so wide that only the sign of a projection parts the rows.
    expected = brute(matrix, asked, "l2", 300)
    costs = {q: dict(hits) for q, hits in expected.items()}
    for q, hits in result(wide).items():
        assert len({n for n, _ in hits}) == len(hits) == 5
        assert all(c == pytest.approx(costs[q][n], abs=2e-6) for n, c in hits)


def test_cell_count():
    assert [ann.cell_count(n) for n in (0, 9, 10, 500, 5000)] == [1, 1, 1, 50, 100]


def test_contexts(spark):
    hits = spark.createDataFrame(
        [(1, 2, "b.md", " second \n"), (1, 1, None, "first"), (2, 1, "c.md", "x" * 600)],
        "query_id bigint, rank int, source string, text string",
    )
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id bigint")
    full = {r["query_id"]: r for r in search.assemble_context(hits, queries).collect()}
    assert full[1]["context"] == "[Document 1] (Source: Unknown):\nfirst\n\n[Document 2] (Source: b.md):\nsecond"
    assert full[3]["context"] == "No relevant information found in the knowledge base." and full[3]["hits"] == 0
    short = {r["query_id"]: r["context"] for r in search.assemble_short_context(hits, queries, 500).collect()}
    assert short == {1: "first\n\n second \n", 2: "x" * 500, 3: ""}


def test_preview_lines(spark):
    hits = spark.createDataFrame([(1, 1, 9, None, "a\nb")], "query_id int, rank int, vec_id int, source string, text string")
    assert search.previews(hits).first()["line"] == "1. [unknown] a b..."


def test_many_queries_go_through_tiles_for_approximate_search_too(data, monkeypatch):
    corpus, queries, matrix, asked, _ = data
    expected = brute(matrix, asked, "l2", 5)
    monkeypatch.setattr(search, "MAX_QUERY_ROWS", 2)
    monkeypatch.setattr(ann, "small_queries", lambda q, keys: search.small_queries(q, keys, 2))
    monkeypatch.setattr(ann, "nearest", lambda *a, **o: search.nearest(*a, **o, max_query_rows=2))
    same(result(ann.ivf_flat(corpus, queries, 5, cells=4, probes=4)), expected)
    # Two bits tell too little for a short list of 50 rows to hold the exact hits, so all rows are compared anew.
    same(result(ann.ivf_pq(corpus, queries, 5, cells=4, probes=4, bits=2, rerank=300)), expected)
    assert set(result(ann.hash_tables(corpus, queries, 5, tables=2, length=1000.0))) <= set(expected)


def test_ragged_vectors_are_refused(spark):
    corpus = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0, 4.0])], "vec_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "query_id bigint, query_vector array<double>")
    with pytest.raises(Exception, match="dimensions"):
        search.nearest(corpus, queries).collect()


def test_codes_do_not_depend_on_the_number_of_queries(spark, data):
    corpus, _, matrix, _, _ = data
    asked = spark.createDataFrame([(n, [float(x) for x in matrix[n]]) for n in range(20)], "query_id bigint, query_vector array<double>")
    index = ann.build_codes(corpus, cells=4, parts=4, bits=4)
    index.rows.cache()
    whole = ann.search_codes(index, corpus, asked, k=3, probes=2)
    blocks = ann.search_codes(index, corpus, asked, k=3, probes=2, max_rows=7)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, blocks.collect()))


def test_documents_are_looked_up_without_a_shuffle(spark, data):
    corpus, queries, *_ = data
    path = "/root/testdata/sf0.001/documents.parquet"
    hits = search.nearest(corpus.filter("vec_id < 200"), queries, "l2", 3)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        docs = spark.read.parquet(path)
        found = search.with_documents(hits, docs, ["source", "text"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        assert "In(doc_id" in plan or "InSet" in plan
        plain = hits.join(docs.select(F.col("doc_id").alias("vec_id"), "source", "text"), "vec_id").select(*found.columns)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) and found.count() == 12
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_documents_of_many_hits(spark, monkeypatch):
    docs = spark.createDataFrame([(n, f"t{n}") for n in range(50)], "doc_id bigint, text string")
    hits = spark.createDataFrame([(q, r, 3 * q + r) for q in range(15) for r in range(3)] + [(99, 1, None)], "query_id int, rank int, vec_id bigint")
    wanted = sorted((q, r, 3 * q + r, f"t{3 * q + r}") for q in range(15) for r in range(3))
    for ids, rows in ((10_000, 10**6), (5, 10**6), (5, 10)):
        monkeypatch.setattr(search, "LOOKUP_IDS", ids)
        monkeypatch.setattr(search, "LOOKUP_ROWS", rows)
        assert sorted(map(tuple, search.with_documents(hits, docs, ["text"]).collect())) == wanted


def test_ten_thousand_queries_are_one_scan(spark):
    rng = np.random.default_rng(5)
    matrix, asked = rng.normal(size=(400, 8)).round(3), rng.normal(size=(10_000, 8)).round(3)
    corpus = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(matrix)], "vec_id bigint, embedding array<double>")
    frame = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(asked)], "query_id bigint, query_vector array<double>")
    hits = search.nearest(corpus, frame, "l2", 2)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "Union" not in plan and plan.count("MapInArrow") == 1
    wanted = brute(matrix, asked[:300], "l2", 2)
    same(result(hits.filter("query_id < 300")), wanted)
    passes = search.nearest(corpus, frame, "l2", 2, max_query_rows=3000)
    assert sorted(map(tuple, passes.collect())) == sorted(map(tuple, hits.collect()))


def test_copies_in_several_cells_are_compared_once(data):
    corpus, queries, matrix, asked, _ = data
    index = ann.build_cells(corpus, 6, copies=3)
    assert index.rows.count() == 900
    counter = Observation("scored")
    hits = ann.search_cells(index, queries, 5, probes=6, counter=counter)
    same(result(hits), brute(matrix, asked, "l2", 5))
    assert counter.get["scored"] == 300 * 4
    codes = ann.build_codes(corpus, 6, parts=4, bits=3, copies=2)
    same(result(ann.search_codes(codes, corpus, queries, 5, probes=6, rerank=300)), brute(matrix, asked, "l2", 5))


def test_training_is_one_pass_a_round(spark, data):
    corpus, *_ = data
    centroids, books = ann.train(corpus, 5, parts=4, bits=2)
    assert centroids.shape == (5, DIM) and [len(book) for book in books] == [4] * 4 and books[0].shape[1] == DIM // 4
    few, _ = ann.train(corpus.limit(3), 5)
    assert few.shape == (3, DIM)
    sampled, _ = ann.train(corpus, 5, sample_rows=150)
    assert sampled.shape == (5, DIM)


@pytest.mark.parametrize("kind", ["ivf_flat", "ivf_pq", "lsh"])
def test_a_stored_index_gives_the_same_hits(spark, data, tmp_path, kind):
    corpus, queries, *_ = data
    if kind == "lsh":
        built = ann.build_buckets(corpus, 4)
    else:
        built = ann.build_codes(corpus, 6, parts=4, bits=3, copies=2) if kind == "ivf_pq" else ann.build_cells(corpus, 6, copies=2)
    ann.save_index(built, str(tmp_path))
    # Nothing but the folder is known in the other session.
    opened = ann.load_index(spark.newSession(), str(tmp_path))
    assert type(opened) is type(built) and getattr(opened, "copies", 2) == 2
    options = {"rerank": 20} if kind == "ivf_pq" else {}
    wanted = search.search(kind, corpus, queries, 5, index=built, probes=2, **options)
    found = search.search(kind, corpus, queries, 5, index=opened, probes=2, **options)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*(cell|bucket)#", plan)


def test_all_buckets_are_exact_and_a_share_finds_most(spark, data):
    corpus, queries, matrix, asked, _ = data
    index = ann.build_buckets(corpus, 5)
    same(result(ann.search_probed(index, queries, 5, probes=32)), brute(matrix, asked, "l2", 5))
    selves = corpus.filter("vec_id < 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    own = {r["query_id"]: r["asked"] for r in ann.with_buckets(selves, index, 1).collect()}
    assert own == {r["vec_id"]: [r["bucket"]] for r in index.rows.filter("vec_id < 7").collect()}
    assert search.search("lsh", corpus.limit(0), queries).count() == 0
    for folder in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        table, rows = retrieval.vectors(spark, folder), retrieval.row_queries(spark, folder)
        counter = Observation("scored")
        found = search.search("lsh", table, rows, counter=counter)
        got = ann.recall(found, search.search("flat_l2", table, rows)).agg(F.avg("recall")).first()[0]
        assert got >= 0.9 and counter.get["scored"] < 0.7 * table.count() * rows.count()


def test_comparison_counts_what_is_compared(data):
    corpus, queries, *_ = data
    rows = {r["index_type"]: r for r in ann.compare_indexes(corpus, queries, 5, {"ivf_flat": {"probes": 3}, "ivf_pq": {"bits": 3, "probes": 30}}).collect()}
    assert set(rows) == {"flat_l2", "flat_ip", "ivf_flat", "ivf_pq", "hash_tables"}
    assert rows["flat_l2"]["scored"] == rows["flat_ip"]["scored"] == rows["ivf_pq"]["scored"] == 300 * 4
    assert 0 < rows["ivf_flat"]["scored"] < 300 * 4 and rows["flat_l2"]["recall_at_k"] == 1.0


def test_many_small_offers_are_sorted_together(monkeypatch):
    draw = np.random.default_rng(7)
    costs, sorts = draw.random((600, 40)).round(3), []
    lexsort = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorts.append(1) or lexsort(keys))
    best = search.Best(40, 3)
    for at in range(0, 600, 2):  # two rows at a time meet some of the queries
        who = np.sort(draw.choice(40, 15, replace=False))
        met = np.isin(np.arange(40), who)
        costs[at : at + 2, ~met] = np.inf
        best.offer(costs[at : at + 2][:, who], np.arange(at, at + 2), who)
    found = best.batch(list(range(40)), pa.int64(), True).to_pydict()
    wanted = [(q, row) for q in range(40) for row in lexsort((np.arange(600), costs[:, q]))[:3].tolist()]
    assert list(zip(found["query_id"], found["vec_id"], strict=True)) == wanted
    assert sum(found["scored"]) == np.isfinite(costs).sum()
    assert len(sorts) <= 3


def test_rows_that_share_keys_look_each_key_up_once(monkeypatch):
    meetings = search.Meetings([[1, 2], [2], None, [3]])
    lookers = dict(meetings.lookers)

    class Counted(dict):
        asked: list = []

        def __getitem__(self, key):
            self.asked.append(key)
            return dict.__getitem__(self, key)

    meetings.lookers = Counted(lookers)
    got = meetings.asked([[1, 9], [2], [], [2, 1]] * 100, np.array([0, 1, 3]))
    assert got.tolist() == [[True, False, False], [True, True, False], [False] * 3, [True, True, False]] * 100
    assert len(Counted.asked) <= 4


def test_short_lists_are_compared_a_batch_at_a_time(monkeypatch):
    draw = np.random.default_rng(8)
    rows, asked = draw.random((50, 4)), draw.random((30, 4))
    who, names = np.repeat(np.arange(30), 20), np.concatenate([draw.choice(50, 20, replace=False) for _ in range(30)])
    vectors = pa.array(rows[names].tolist(), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(names), vectors, pa.array(who.astype(np.int32))], names=["vec_id", "embedding", "position"])
    adds, add = [], search.Best.add
    monkeypatch.setattr(search.Best, "add", lambda self, *pairs: adds.append(1) or add(self, *pairs))
    queries = search.QuerySet(list(range(100, 130)), asked, None, "bigint")
    found = [b.to_pydict() for b in search._pair_scanner(queries, 5)([batch.slice(0, 300), batch.slice(300)])][0]
    cost = ((rows[None] - asked[:, None]) ** 2).sum(axis=2).round(6)
    wanted = [(100 + q, row) for q in range(30) for row in sorted(names[who == q].tolist(), key=lambda row: (cost[q, row], row))[:5]]
    assert list(zip(found["query_id"], found["vec_id"], strict=True)) == wanted
    assert sum(found["scored"]) == 600 and len(adds) == 2


def test_codes_of_the_row_queries_are_fine_enough_for_larger_tables():
    assert retrieval.ROWS_OPTIONS["ivf_pq"]["parts"] == retrieval.ROWS_PARTS == 16
    assert {name: value for name, value in retrieval.ROWS_OPTIONS["ivf_pq"].items() if name != "parts"} == retrieval.OPTIONS["ivf_pq"]


def test_cells_and_codes_are_trained_once_whatever_the_codes(data, monkeypatch):
    corpus, queries, *_ = data
    built, build = [], ann.build_codes
    monkeypatch.setattr(ann, "build_codes", lambda corpus, **own: built.append(own) or build(corpus, **own))
    same_cells = {"cells": 4, "probes": 4}
    rows = ann.compare_indexes(corpus, queries, 5, {"ivf_flat": same_cells, "ivf_pq": {**same_cells, "parts": 4, "bits": 3}}).collect()
    assert built == [{"cells": 4, "parts": 4, "bits": 3}] and len(rows) == 5
