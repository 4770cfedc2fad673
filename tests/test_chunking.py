import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking as C


def brute_chunks(text, size=1000, minimum=100):
    words = text.split()
    total = -(-len(words) // size)
    pieces = [(at // size, words[at : at + size]) for at in range(0, len(words), size)]
    return [(i, " ".join(w), len(w), total) for i, w in pieces if len(" ".join(w)) >= minimum]


@pytest.mark.parametrize("count", [0, 1, 14, 15, 999, 1000, 1001, 1014, 1015, 2000, 2500])
def test_word_chunks(spark, count):
    text = "\n ".join(["wordy1"] * count)
    docs = spark.createDataFrame([(1, "s", text)], "doc_id bigint, source string, text string")
    got = C.chunk_documents(docs).orderBy("chunk_index").collect()
    rows = [(r["chunk_index"], r["plain_content"], r["word_count"], r["total_chunks_for_page"]) for r in got]
    assert rows == brute_chunks(text)
    assert all(r["char_count"] == len(r["plain_content"]) for r in got)


@pytest.mark.parametrize("chars, kept", [(99, 0), (100, 1)])
def test_short_tail(spark, chars, kept):
    docs = spark.createDataFrame([(1, "s", "x" * chars)], "doc_id bigint, source string, text string")
    assert C.chunk_documents(docs).count() == kept


def test_page_chunk_ids_are_dense_in_page_order(spark):
    rng = random.Random(3)
    rows = []
    for page in range(60):
        source = "hot" if page % 3 else f"cold{page % 2}"
        words = rng.choice([0, 1, 30, 1000, 1003, 2400])
        rows.append((page, f"http://{source}/{page}", f"t{page}", source, "w" * 5 + " " + "abcdef " * words))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, title string, domain string, content string")
    pages = pages.withColumn("scraped_at", F.lit("2025-01-01 00:00:00").cast("timestamp"))
    got = C.chunk_pages(pages).collect()
    expected = {}
    for page, url, _title, source, content in rows:
        for index, text, words, total in brute_chunks(content):
            held = expected.setdefault(source, [])
            held.append((len(held), url, index, words, total, f"chunks/chunk_{len(held)}.md"))
    ours = {}
    for r in sorted(got, key=lambda r: r["chunk_id"]):
        ours.setdefault(r["source"], []).append(
            (r["chunk_id"], r["source_url"], r["chunk_index"], r["word_count"], r["total_chunks_for_page"], r["file_path"])
        )
    assert ours == expected


def greedy(counts, budget):
    chunks, used = [], None
    for at, n in enumerate(counts):
        if used is None or used + n > budget:
            chunks.append([at])
            used = n
        else:
            chunks[-1].append(at)
            used += n
    return chunks


def test_packing_is_greedy_and_lossless(spark):
    rng = random.Random(5)
    texts = ["", "\n\n", "one", "w " * 50]
    for _ in range(40):
        texts.append("\n".join("w " * rng.choice([0, 0, 1, 3, 7, 10, 11, 25]) for _ in range(rng.randint(1, 30))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = C.pack_segments(docs, ["doc_id"], F.split("text", "\n"), budget=10).collect()
    for doc, text in enumerate(texts):
        rows = sorted((r for r in got if r["doc_id"] == doc), key=lambda r: r["chunk_id"])
        lines = text.split("\n")
        expected = greedy([len(line.split()) for line in lines], 10)
        assert "\n".join(r["content"] for r in rows) == text
        assert [r["segment_count"] for r in rows] == [len(c) for c in expected]
        assert all(r["token_count"] <= 10 or r["segment_count"] == 1 for r in rows)
        assert [r["chunk_id"] for r in rows] == list(range(len(rows)))


def test_packing_with_own_token_count(spark):
    docs = spark.createDataFrame([(1, "aa\nbb\ncc")], "doc_id bigint, text string")
    got = C.pack_segments(docs, ["doc_id"], F.split("text", "\n"), budget=4, tokens=F.length).orderBy("chunk_id")
    assert [r["content"] for r in got.collect()] == ["aa\nbb", "cc"]


SEGMENTS = "source string, chunk_id bigint, embed string, segments array<struct<segment_type:string,content:string>>"


def test_layout_chunks_and_counts(spark):
    types = ["PageHeader", "Title", "Text", "Table", "ListItem", "SectionHeader", "Picture", "PageFooter"]
    rows = [
        ("a", 0, "some words here", [(t, t.lower()) for t in types]),
        ("a", 1, "", []),
        ("b", 0, "x", [("Table", "|"), ("Table", "|")]),
    ]
    chunks = spark.createDataFrame(rows, SEGMENTS)
    got = {(r["source"], r["chunk_id"]): r for r in C.layout_chunks(chunks).collect()}
    first = got["a", 0]
    assert first["segment_types"] == types and first["has_tables"] and first["segment_count"] == 8
    assert first["token_count"] == 3 and first["file_path"] == "chunks/chunk_0.md"
    assert not got["a", 1]["has_tables"] and got["a", 1]["segment_count"] == 0
    counts = {r["source"]: tuple(r)[1:] for r in C.segment_counts(chunks, ["source"]).collect()}
    assert counts == {"a": (4, 1), "b": (0, 2)}
    kept = chunks.select(C.without_margins("segments").alias("s")).first()["s"]
    assert [s["segment_type"] for s in kept] == types[1:-1]


def test_packing_with_a_real_tokenizer(spark):
    """Chunks by the counts of a public tokenizer equal greedy packing in plain Python."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")

    def load():
        tokenizer = tokenizers.Tokenizer.from_file(path)
        return lambda texts: [len(one.ids) for one in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], (r["text"] or "").split("\n")) for r in rows] + [(-1, None), (-2, []), (-3, ["a", None, "b " * 400])]
    frame = spark.createDataFrame(rows, "doc_id bigint, segments array<string>")
    found = {}
    for r in C.pack_segments(frame, ["doc_id"], "segments", 128, counts=C.tokenizer_counts(load)).collect():
        found.setdefault(r["doc_id"], []).append((r["chunk_id"], r["segment_count"], r["token_count"]))
    count = load()
    for doc_id, segments in rows:
        wanted, used, held = [], 0, 0
        for size in count([s or "" for s in segments]) if segments else []:
            if held and used + size > 128:
                wanted.append((len(wanted), held, used))
                used = held = 0
            used, held = used + size, held + 1
        if held:
            wanted.append((len(wanted), held, used))
        assert sorted(found.get(doc_id, [])) == wanted
