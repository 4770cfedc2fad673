"""Registered queries of the operators, each over its whole table, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    fingerprints, lexical, lmscore, minhash, mixing, packing, phrases, quality, secrets, suffixes, tokenids, toxicity,
    vectors,
)
from corpusloom.llm.common import table

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size")))
    return mixed.select(
        "doc_id", "size", "source", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def op2_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.groups(table(spark, sf_dir, "embeddings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.groups(table(spark, sf_dir, "documents"), width=4)
    return found.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), BYTE_TOKENIZER))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = tokenids.write(table(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=2)
    return tokenids.gather(folder, manifest)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.best(table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.removed(table(spark, sf_dir, "documents"))
    return found.select(*suffixes.digest_columns(found))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_mix_sources, op2_vector_near_dedup, op3_secret_scan, op4_quality, op5_fingerprints, op6_minhash_near_dedup,
        op7_lm_score, op8_toxicity, op9_best_fit_packing, op10_token_ids, op11_phrases, op12_suffix_dedup,
        op13_lexical_search,
    )
}
# The first ten operators draw, train, sketch or tokenise: SQL cannot repeat their rows. tests/llm checks them by brute force.
ORACLES: dict[str, str] = {
    "op11_phrases": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        ),
        pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM docs),
        totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
        sizes AS (SELECT unnest(range(1, 6)) AS m),
        grams AS (
            SELECT lang, m, unnest([array_to_string(w[i : i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS p
            FROM pieces, sizes WHERE len(w) >= m
        ),
        f AS (SELECT lang, m, p, count(*)::HUGEINT AS f FROM grams GROUP BY lang, m, p HAVING count(*) >= 100),
        cuts AS (
            SELECT lang, m, p, f AS a, unnest(range(1, m)) AS k, string_split(p, ' ') AS w FROM f WHERE m >= 2
        ),
        weighed AS (
            SELECT c.lang, c.m, c.p, c.a, c.k, x.f AS l, y.f AS r, n, (1000 * c.a * n) // (x.f * y.f) AS score
            FROM cuts c JOIN totals USING (lang)
            JOIN f x ON x.lang = c.lang AND x.m = c.k AND x.p = array_to_string(c.w[1 : c.k], ' ')
            JOIN f y ON y.lang = c.lang AND y.m = c.m - c.k AND y.p = array_to_string(c.w[c.k + 1 : c.m], ' ')
        ),
        weakest AS (
            SELECT * FROM weighed QUALIFY row_number() OVER (PARTITION BY lang, m, p ORDER BY score, k) = 1
        ),
        dropped AS (
            SELECT DISTINCT c.lang, c.m, c.p FROM weakest c JOIN f g
            ON g.lang = c.lang AND g.m > c.m AND g.f >= c.a AND contains(' ' || g.p || ' ', ' ' || c.p || ' ')
        )
        SELECT lang, row_number() OVER best AS rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
            n::BIGINT AS n, score::BIGINT AS score
        FROM weakest ANTI JOIN dropped USING (lang, m, p)
        WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, p)
        QUALIFY row_number() OVER best <= 2000
    """,
    "op12_suffix_dedup": """
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS body FROM documents
        ),
        starts AS (SELECT r, body, unnest(range(0, octet_length(body) - 199)) AS p FROM docs WHERE octet_length(body) >= 200),
        keyed AS (SELECT r, p, md5(body[p + 1 : p + 200]) AS k FROM starts),
        repeated AS (SELECT r, p FROM keyed QUALIFY count(*) OVER (PARTITION BY k) > 1),
        stepped AS (
            SELECT r, p, CASE WHEN p > lag(p) OVER w + 200 THEN 1 ELSE 0 END AS fresh
            FROM repeated WINDOW w AS (PARTITION BY r ORDER BY p)
        ),
        islands AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS island FROM stepped),
        spans AS (SELECT r, min(p) AS s, max(p) + 200 AS e FROM islands GROUP BY r, island),
        gaps AS (
            SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS a, s AS b FROM spans
            UNION ALL
            SELECT r, coalesce(max(e), 0), any_value(octet_length(body)) FROM docs LEFT JOIN spans USING (r) GROUP BY r
        ),
        kept AS (
            SELECT r, string_agg(hex(body[a + 1 : b]), '' ORDER BY a) AS rest FROM gaps JOIN docs USING (r) GROUP BY r
        ),
        counts AS (SELECT r, sum(e - s) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
        SELECT doc_id, octet_length(body)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
            coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256
        FROM docs JOIN kept USING (r) LEFT JOIN counts USING (r)
    """,
    "op13_lexical_search": r"""
        WITH terms AS (
            SELECT d, doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)
        ),
        lengths AS (SELECT d, any_value(doc_id) AS doc_id, count(*) AS n FROM terms GROUP BY d),
        totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
        tf AS (SELECT d, term, count(*) AS tf FROM terms GROUP BY d, term),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        weights AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, totals
        ),
        asked AS (
            SELECT item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ),
        wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term),
        m AS (SELECT d, doc_id, 100 - 25 + (25 * n * n_docs) // n_terms AS m FROM lengths, totals),
        scores AS (
            SELECT item_id, d, any_value(doc_id) AS doc_id,
                sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
            FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN m USING (d) GROUP BY item_id, d
        )
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
        FROM scores WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
    """,
}
