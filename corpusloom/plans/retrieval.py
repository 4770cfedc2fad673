"""Queries over vectors and text search. The mean direction of every label (or of
every source) asks the questions, so each query reads the whole vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import ann, knowledge, search
from corpusloom.operators.embed import HashedTfIdf
from corpusloom.operators.evaluation import index_footprint as footprint
from corpusloom.operators.textsearch import tfidf_search as text_search
from corpusloom.plans.registry import query, strip, table
from corpusloom.session import fresh_path

#: On the test vectors, which have no clusters, the rows with vec_id % 20 = 0 find 0.9 and more of their five nearest in a
#: fifth of the cells, with every vector stored in its three nearest.
PROBES, COPIES, RERANK = 0.2, 3, 200
OPTIONS = {"ivf_flat": {"probes": PROBES, "copies": COPIES}, "ivf_pq": {"probes": PROBES, "copies": COPIES, "rerank": RERANK}}
#: The larger the table, the more rows lie close to a query: with 16 sub-vectors the short list of 200 holds 0.98 of the five
#: nearest of 615,384 vectors, with 8 it held 0.73 (all cells probed).
ROWS_PARTS = 16
ROWS_OPTIONS = {**OPTIONS, "ivf_pq": {**OPTIONS["ivf_pq"], "parts": ROWS_PARTS}}


def _means(rows: str, group: str) -> str:
    return f"""
    parts AS (
      SELECT {group} AS query_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM {rows}),
    means AS (SELECT query_id, i, avg(x) AS x FROM parts GROUP BY query_id, i),
    asked AS (
      SELECT query_id, list(x / norm ORDER BY i) AS v
      FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS norm FROM means) GROUP BY query_id)
"""


_LABELS = _means("embeddings", "label::BIGINT")
_L2 = "round(pow(list_distance(e.embedding::DOUBLE[], a.v), 2), 6)"
_IP = "round(list_inner_product(e.embedding::DOUBLE[], a.v), 6) + 0.0::DOUBLE"
_COSINE = "round(list_cosine_similarity(e.embedding::DOUBLE[], a.v), 6) + 0.0::DOUBLE"


def _hits(score: str, order: str, means: str = _LABELS, rows: str = "embeddings e, asked a", k: int = 5) -> str:
    return f"""{means},
    scored AS (SELECT a.query_id, e.vec_id, {score} AS score FROM {rows}),
    hits AS (
      SELECT * FROM (SELECT query_id, vec_id, score,
        row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id)::INTEGER AS rank FROM scored)
      WHERE rank <= {k})"""


_L2_HITS = _hits(_L2, "ASC")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "embedding")


def label_queries(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("label").cast("bigint").alias("label"), "embedding")
    return search.group_directions(rows, "label")


def row_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every row whose id is divisible by 20 asks, so the query side grows with the table."""
    rows = table(spark, folder, "embeddings").where("vec_id % 20 = 0")
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vector"))


def _knn(spark, folder, metric):
    return search.nearest(vectors(spark, folder), label_queries(spark, folder), metric)


@query("knn_l2", f"WITH {_L2_HITS} SELECT query_id, rank, vec_id, score FROM hits")
def knn_l2(spark, folder):
    return _knn(spark, folder, "l2")


@query("knn_ip", f"WITH {_hits(_IP, 'DESC')} SELECT query_id, rank, vec_id, score FROM hits")
def knn_ip(spark, folder):
    return _knn(spark, folder, "ip")


@query("knn_cosine", f"WITH {_hits(_COSINE, 'DESC')} SELECT query_id, rank, vec_id, score FROM hits")
def knn_cosine(spark, folder):
    return _knn(spark, folder, "cosine")


_ROWS = "asked AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0)"


@query("knn_l2_rows", f"WITH {_hits(_L2, 'ASC', _ROWS)} SELECT query_id, rank, vec_id, score FROM hits")
def knn_l2_rows(spark, folder):
    return search.nearest(vectors(spark, folder), row_queries(spark, folder), "l2")


@query("knn_cosine_rows", f"WITH {_hits(_COSINE, 'DESC', _ROWS)} SELECT query_id, rank, vec_id, score FROM hits")
def knn_cosine_rows(spark, folder):
    return search.nearest(vectors(spark, folder), row_queries(spark, folder), "cosine")


_SOURCED = """sourced AS (
      SELECT e.vec_id, e.embedding, d.source FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id),"""


@query(
    "knn_by_source",
    f"""WITH {_SOURCED} {_hits(_L2, "ASC", _means("sourced", "source"), "sourced e JOIN asked a ON e.source = a.query_id")}
    SELECT query_id, rank, vec_id, score FROM hits""",
)
def knn_by_source(spark, folder):
    sources = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    sourced = vectors(spark, folder).join(sources, "vec_id")
    asked = search.group_directions(sourced, "source").withColumn("scope", F.col("query_id"))
    return search.search_own_source(sourced, asked)


@query(
    "knn_documents",
    f"""WITH {_L2_HITS} SELECT query_id, rank, h.vec_id, source,
      concat(rank, '. [', source, '] ', replace(substr(text, 1, 200), chr(10), ' '), '...') AS line
      FROM hits h JOIN documents d ON h.vec_id = d.doc_id""",
)
def knn_documents(spark, folder):
    found = search.with_documents(knn_l2(spark, folder), table(spark, folder, "documents"), ["source", "text"])
    return search.previews(found)


_BLOCKS = f"""concat('[Document ', rank, '] (Source: ', coalesce(source, 'Unknown'), '):', chr(10), {strip("text")})"""


@query(
    "rag_context",
    f"""WITH {_L2_HITS}, joined AS (
      SELECT query_id, count(*) AS hits, string_agg({_BLOCKS}, chr(10) || chr(10) ORDER BY rank) AS context
      FROM hits h JOIN documents d ON h.vec_id = d.doc_id GROUP BY query_id)
    SELECT query_id, coalesce(j.hits, 0) AS hits,
      coalesce(context, 'No relevant information found in the knowledge base.') AS context
    FROM asked LEFT JOIN joined j USING (query_id)""",
)
def rag_context(spark, folder):
    asked = label_queries(spark, folder)
    found = search.nearest(vectors(spark, folder), asked, "l2")
    found = search.with_documents(found, table(spark, folder, "documents"), ["source", "text"])
    return search.assemble_context(found, asked)


@query(
    "rag_context_trunc",
    f"""WITH {_L2_HITS}, joined AS (
      SELECT query_id, count(*) AS hits,
        string_agg(substr(text, 1, 500), chr(10) || chr(10) ORDER BY rank) AS long_context,
        string_agg(substr(text, 1, 400), chr(10) || chr(10) ORDER BY rank) AS context
      FROM hits h JOIN documents d ON h.vec_id = d.doc_id GROUP BY query_id)
    SELECT query_id, coalesce(j.hits, 0) AS hits, coalesce(long_context, '') AS long_context,
      coalesce(context, '') AS context
    FROM asked LEFT JOIN joined j USING (query_id)""",
)
def rag_context_trunc(spark, folder):
    asked = label_queries(spark, folder)
    found = search.nearest(vectors(spark, folder), asked, "l2")
    found = search.with_documents(found, table(spark, folder, "documents"), ["text"])
    long = search.assemble_short_context(found, asked, 500).withColumnRenamed("context", "long_context")
    return long.join(search.assemble_short_context(found, asked, 400).drop("hits"), "query_id")


_TERMS = r"""
    n AS (SELECT count(*) AS n FROM documents),
    doc_terms AS (
      SELECT doc_id, term, count(*) AS tf FROM (
        SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents)
      WHERE term <> '' GROUP BY doc_id, term),
    asked_terms AS (
      SELECT item_id, term, count(*) AS tf FROM (
        SELECT item_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM benchmark)
      WHERE term <> '' GROUP BY item_id, term),
    idf AS (SELECT term, ln((n + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) AS idf FROM doc_terms, n GROUP BY term, n),
    dw AS (SELECT doc_id, term, tf * idf AS w FROM doc_terms JOIN idf USING (term)),
    qw AS (SELECT item_id, term, tf * idf AS w FROM asked_terms JOIN idf USING (term)),
    dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY doc_id),
    qn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY item_id),
    text_scores AS (
      SELECT item_id, doc_id, round(dot / qn.norm / dn.norm, 6) AS score
      FROM (SELECT item_id, doc_id, sum(qw.w * dw.w) AS dot FROM qw JOIN dw USING (term) GROUP BY item_id, doc_id)
      JOIN qn USING (item_id) JOIN dn USING (doc_id)),
    text_hits AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
        FROM text_scores WHERE score > 0) WHERE rank <= 3)
"""


@query("tfidf_search", f"WITH {_TERMS} SELECT item_id, doc_id, score, rank FROM text_hits")
def tfidf_search(spark, folder):
    return text_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(
    "build_prompts",
    f"""WITH {_TERMS}, joined AS (
      SELECT item_id, count(*) AS hits, string_agg(substr(text, 1, 500), chr(10) || chr(10) ORDER BY rank) AS context
      FROM text_hits JOIN documents USING (doc_id) GROUP BY item_id)
    SELECT item_id AS query_id, coalesce(hits, 0) AS hits,
      concat('Based on the following context, answer the question:', chr(10), chr(10), 'Context:', chr(10),
        coalesce(context, ''), chr(10), chr(10), 'Question: ', text, chr(10), chr(10), 'Answer:') AS prompt
    FROM benchmark LEFT JOIN joined USING (item_id)""",
)
def build_prompts(spark, folder):
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    found = tfidf_search(spark, folder).withColumnRenamed("item_id", "query_id")
    found = search.with_documents(found, table(spark, folder, "documents"), ["text"], "doc_id")
    contexts = search.assemble_short_context(found, asked, 500)
    return search.build_prompts(contexts.join(asked, "query_id"), "question").select("query_id", "hits", "prompt")


@query("knowledge_search")
def knowledge_search(spark, folder):
    """Every benchmark passage is asked, against the embedded documents."""
    documents = table(spark, folder, "documents").select("doc_id", "source", "text")
    embedder = HashedTfIdf.fit(documents, "text")
    index = embedder(documents, "text", "embedding").select(F.col("doc_id").alias("vec_id"), "embedding", "source")
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return knowledge.contexts(asked, index, documents, embedder)


@query(
    "normalize_vectors",
    """SELECT vec_id, i::INTEGER AS position,
      round(x / CASE WHEN norm = 0 THEN 1 ELSE norm END, 6) + 0.0::DOUBLE AS value
    FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i,
            sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)""",
)
def normalize_vectors(spark, folder):
    unit = vectors(spark, folder).select("vec_id", V.normalized("embedding").alias("unit"))
    return unit.select("vec_id", F.posexplode("unit").alias("position", "value")).withColumn(
        "value", F.round("value", 6) + F.lit(0.0)
    )


@query(
    "index_footprint",
    """SELECT count(*) AS num_vectors, max(len(embedding))::INTEGER AS vector_dimension,
      round(count(*) * max(len(embedding)) * 4 / 1048576.0::DOUBLE, 6) AS memory_usage_mb FROM embeddings""",
)
def index_footprint(spark, folder):
    return footprint(vectors(spark, folder))


@query("ann_ivf")
def ann_ivf(spark, folder):
    return search.search("ivf_flat", vectors(spark, folder), label_queries(spark, folder), **OPTIONS["ivf_flat"])


@query("ann_ivfpq")
def ann_ivfpq(spark, folder):
    return search.search("ivf_pq", vectors(spark, folder), label_queries(spark, folder), **OPTIONS["ivf_pq"])


@query("ann_lsh")
def ann_lsh(spark, folder):
    return search.search("hnsw", vectors(spark, folder), label_queries(spark, folder))


@query("index_comparison")
def index_comparison(spark, folder):
    return ann.compare_indexes(vectors(spark, folder), label_queries(spark, folder), options=OPTIONS)


@query("index_comparison_rows")
def index_comparison_rows(spark, folder):
    """Recall and compared pairs of every strategy for a query set that grows with the table."""
    return ann.compare_indexes(vectors(spark, folder), row_queries(spark, folder), options=ROWS_OPTIONS)


def stored_index(spark: SparkSession, folder: str, kind: str) -> ann.CellIndex | ann.CodeIndex | ann.BucketIndex:
    """An index over the whole table, written to the shared folder and opened again."""
    corpus = vectors(spark, folder)
    if kind == "lsh":
        built = ann.build_buckets(corpus)
    elif kind == "ivf_pq":
        built = ann.build_codes(corpus, parts=ROWS_PARTS, copies=COPIES)
    else:
        built = ann.build_cells(corpus, copies=COPIES)
    path = fresh_path(spark, "index")
    ann.save_index(built, path)
    return ann.load_index(spark, path)


def _stored(spark, folder, kind, probes=PROBES, **options):
    corpus, asked = vectors(spark, folder), row_queries(spark, folder)
    found = search.search(kind, corpus, asked, index=stored_index(spark, folder, kind), probes=probes, **options)
    exact = search.search("flat_l2", corpus, asked)
    return found.join(ann.recall(found, exact), "query_id").select("query_id", "rank", "vec_id", "score", "recall")


@query("stored_ivf_rows")
def stored_ivf_rows(spark, folder):
    """Hits of a stored index of cells, each query with its recall."""
    return _stored(spark, folder, "ivf_flat")


@query("stored_ivfpq_rows")
def stored_ivfpq_rows(spark, folder):
    """Hits of a stored index of product codes, each query with its recall."""
    return _stored(spark, folder, "ivf_pq", rerank=RERANK)


@query("stored_lsh_rows")
def stored_lsh_rows(spark, folder):
    """Hits of a stored index of buckets, each query with its recall; less than the whole table is read."""
    return _stored(spark, folder, "lsh", ann.BUCKET_PROBES)
