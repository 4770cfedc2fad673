import csv
import glob
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from corpusloom import schemas, sinks, sources
from corpusloom.operators import chunking, search
from corpusloom.operators import evaluation as E
from corpusloom.operators.ann import build_cells, search_cells
from corpusloom.operators.pages import extract_pages
from tests.test_evaluation import run


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def lines_of(folder):
    return [line for part in sorted(glob.glob(f"{folder}/part-*")) for line in open(part, encoding="utf-8").read().splitlines()]


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    put(root / "Driver's Manual" / "chunks" / "chunk_0.md", "first\nchunk")
    put(root / "Driver's Manual" / "chunks" / "deep" / "chunk_1.md", "second")
    put(root / "Driver's Manual" / "chunks" / "note.txt", "no")
    put(root / "a+b%" / "chunks" / "chunk_0.md", "plus")
    put(root / "a+b%" / "page_summary.md", "not a chunk")
    put(root / "bare" / "other" / "chunk_0.md", "not below chunks")
    return str(root)


def test_chunk_corpus(spark, corpus):
    rows = sorted(sources.read_chunk_corpus(spark, corpus).collect(), key=lambda r: r["content"])
    assert [(r["source_type"], r["content"]) for r in rows] == [
        ("Driver's Manual", "first\nchunk"), ("a+b%", "plus"), ("Driver's Manual", "second"),
    ]
    assert rows[0]["path"] == f"{corpus}/Driver's Manual/chunks/chunk_0.md"
    assert rows[0]["content_source"] == f"{corpus}/Driver's Manual"
    assert rows[0]["metadata"]["source_type"] == "Driver's Manual"


def test_source_discovery(spark, corpus):
    assert [r["source"] for r in sources.sources_without_chunks(spark, corpus).collect()] == ["bare"]
    assert [tuple(r) for r in sources.summary_files(spark, corpus).collect()] == [("a+b%", "page_summary.md")]
    for read in (sources.read_chunk_corpus, sources.sources_without_chunks, sources.read_urls):
        assert read(spark, corpus + "-absent").count() == 0


def test_document_files(spark, tmp_path):
    folder = tmp_path / "docs"
    put(folder / "a b.pdf", "x" * 1048576)
    put(folder / "B.PDF", "x")
    put(folder / "c.txt", "x")
    put(folder / "year=1" / "d.pdf", "x")
    rows = sources.document_files(spark, str(folder)).collect()
    assert [(r["stem"], r["size_mb"]) for r in rows] == [("a b", 1.0)]
    assert sources.document_files(spark, str(folder / "B.PDF")).first()["stem"] == "B"
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        sources.document_files(spark, str(tmp_path / "none"))


def test_url_list(spark, tmp_path):
    path = tmp_path / "urls.txt"
    path.write_text("# comment\n\n  https://a \n#x\nftp://b\nhttps://a\n\t# indented\n")
    rows = sources.read_urls(spark, str(path)).orderBy("position").collect()
    assert [r["url"] for r in rows] == ["https://a", "ftp://b", "https://a"]
    assert sources.inline_urls(spark, ["x", "y"]).orderBy("position").first()["url"] == "x"


def test_parse_tasks(spark, tmp_path):
    good = {
        "task_id": "1", "status": "Succeeded", "message": "ok",
        "output": {"chunks": [
            {"embed": "a b", "segments": [{"segment_type": "Table", "content": "|"}, {"segment_type": "Text"}]},
            {"embed": "c", "segments": []},
        ], "page_count": 2},
    }
    failed = {"task_id": "2", "status": "Failed", "message": "Page limit exceeded", "output": {"chunks": []}}
    put(tmp_path / "Good One" / "chunks.json", json.dumps(good, indent=2))
    put(tmp_path / "failed" / "chunks.json", json.dumps(failed))
    put(tmp_path / "broken" / "chunks.json", "{not json")
    tasks = sources.read_parse_tasks(spark, f"{tmp_path}/*/chunks.json").cache()
    bad = {r["source"]: r["message"] for r in sources.failed_tasks(tasks).collect()}
    assert bad == {"failed": "Page limit exceeded", "broken": "unreadable JSON"}
    rows = chunking.layout_chunks(sources.layout_rows(tasks)).orderBy("chunk_id").collect()
    assert [(r["source"], r["chunk_id"], r["content"], r["has_tables"]) for r in rows] == [
        ("Good One", 0, "a b", True), ("Good One", 1, "c", False),
    ]


@pytest.fixture
def web(spark):
    html = "<title>Tïtle</title><body>" + "word " * 30 + "</body>"
    rows = [(n, f"https://h{n % 2}.example/{n}", html) for n in range(4)]
    clean = extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"), "2025-01-01 00:00:00")
    return clean, chunking.chunk_pages(clean)


def test_web_artifacts(spark, web, tmp_path):
    clean, chunks = web
    sinks.write_pages_json(clean.drop("page_id"), f"{tmp_path}/pages")
    back = sources.read_pages_json(spark, f"{tmp_path}/pages/*.json")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, clean.select(back.columns).collect()))
    sinks.write_chunk_json(chunks, f"{tmp_path}/chunks")
    text = "".join(open(p, encoding="utf-8").read() for p in glob.glob(f"{tmp_path}/chunks/source=*/*.json"))
    assert "Tïtle" in text and text.count("\n") == 4
    array = tmp_path / "array.json"
    array.write_text("[" + ",".join(text.strip().split("\n")) + "]", encoding="utf-8")
    rows = sources.read_web_chunks_json(spark, str(array), lines=False).collect()
    assert len(rows) == 4 and all(r["scraped_at"] is not None for r in rows)


def test_chunk_table_and_files(spark, web, tmp_path):
    _, chunks = web
    sinks.write_table(chunks, f"{tmp_path}/table")
    back = spark.read.parquet(f"{tmp_path}/table").select(chunks.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, chunks.collect()))
    sinks.write_chunk_files(chunks, f"{tmp_path}/files")
    written = glob.glob(f"{tmp_path}/files/source=*/chunk_id=*/*.txt")
    assert len(written) == 4
    texts = sorted(open(p, encoding="utf-8").read() for p in written)
    assert texts == sorted(r["content"] for r in chunks.collect())


def test_summaries(spark, web, tmp_path):
    clean, chunks = web
    sinks.write_scrape_summary(clean, chunks, f"{tmp_path}/scrape", "today")
    lines = lines_of(f"{tmp_path}/scrape")
    assert lines[0] == "# Web Scraping Summary" and "**Total Word Count:** 120" in lines
    assert lines[9:] == [f"- [Tïtle](https://h{n % 2}.example/{n}) (30 words)" for n in range(4)]
    summary = spark.createDataFrame([("b", 2, None), ("a", 1, "s.md")], "source string, chunks bigint, summary_file string")
    sinks.write_content_summary(summary, f"{tmp_path}/content", "idx", "today")
    assert lines_of(f"{tmp_path}/content")[5:] == [
        "## Content Sources", "", "### a", "- **Chunks:** 1", "- **Summary:** s.md", "", "### b", "- **Chunks:** 2", "",
    ]


def test_unified_export(spark, tmp_path):
    rows = [("b", 0, "b zero"), ("a", 1, "a one"), ("a", 0, "a zero")]
    sinks.write_corpus_text(spark.createDataFrame(rows, "source string, chunk_id bigint, content string"), str(tmp_path))
    assert lines_of(f"{tmp_path}/unified_documents") == ["# a", "a zero", "a one", "# b", "b zero"]
    assert lines_of(f"{tmp_path}/unified_chunks")[:4] == ["[Source: a, chunk 0]", "a zero", "[Source: a, chunk 1]", "a one"]


def test_index_round_trip(spark, tmp_path):
    vectors = spark.createDataFrame([(n, [float(n % 7), float(n % 11)]) for n in range(60)], "vec_id bigint, embedding array<float>")
    docs = vectors.select(F.col("vec_id").alias("doc_id"), F.lit("t").alias("text"))
    index = build_cells(vectors, 4)
    sinks.write_index(index.rows, docs, str(tmp_path))
    rows, stored = sources.read_index(spark, str(tmp_path))
    assert stored.count() == 60
    queries = spark.createDataFrame([(0, [1.0, 1.0])], "query_id bigint, query_vector array<double>")
    index.rows = rows
    hits = search_cells(index, queries, 3, probes=4)
    assert hits.collect() == search.nearest(vectors, queries, "l2", 3).collect()
    pruned = search_cells(index, queries, 3, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#", pruned)


def test_results(spark, tmp_path):
    runs = spark.createDataFrame([run(1), run(2, ok=False)], schemas.RUNS)
    sinks.write_results(runs, str(tmp_path), "t")
    raw = [json.loads(line) for line in lines_of(f"{tmp_path}/t_results.json")]
    assert {r["run_id"]: (r["success"], r["error"]) for r in raw} == {1: (True, None), 2: (False, "boom")}
    table = [row for part in glob.glob(f"{tmp_path}/t_results.csv/part-*") for row in csv.DictReader(open(part))]
    assert [r["run_id"] for r in table] == ["1"] and table[0]["relevance_scores"] == "[0.0]"
    assert os.path.isdir(f"{tmp_path}/t_analysis/summary")
    sinks.write_report(runs, f"{tmp_path}/report")
    assert lines_of(f"{tmp_path}/report")[1:3] == ["## Test Summary", "- **Total Tests:** 2"]
    assert E.run_summary(runs).first()["total_tests"] == 2


def test_json_lines_keep_every_record(spark, web, tmp_path):
    clean, _ = web
    sinks.write_pages_json(clean.drop("page_id").coalesce(1), f"{tmp_path}/pages")
    parts = glob.glob(f"{tmp_path}/pages/*.json")
    assert len(parts) == 1 and sources.read_pages_json(spark, parts[0]).count() == clean.count() == 4
    broken = tmp_path / "broken.json"
    broken.write_text('{"url": "u"}\n{"url"\n', encoding="utf-8")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        sources.read_pages_json(spark, str(broken)).collect()


def test_unreadable_chunks(spark, corpus):
    assert sources.unreadable_chunks(spark, corpus).count() == 0


def test_broken_files_and_bare_folders_are_failures(spark, corpus):
    bad = os.path.join(corpus, "a+b%", "chunks", "chunk_1.md")
    with open(bad, "wb") as out:
        out.write(b"caf\xe9 \xff")
    chunks, failures = sources.load_chunk_corpus(spark, corpus)
    assert sorted(r["content"] for r in chunks.collect()) == ["first\nchunk", "plus", "second"]
    assert sorted(map(tuple, failures.collect()), key=str) == [
        ("a+b%", bad, "Error loading from a+b%: unreadable or not UTF-8"), ("bare", None, "No chunks directory found in bare"),
    ]
    assert [r["path"] for r in sources.unreadable_chunks(spark, corpus).collect()] == [bad]
    assert [f.count() for f in sources.load_chunk_corpus(spark, corpus + "-absent")] == [0, 0]


@pytest.mark.parametrize("lines", [True, False])
def test_one_bad_record_is_one_failure(spark, tmp_path, lines):
    path = tmp_path / "in.json"
    good = [{"url": "u1", "word_count": 3, "scraped_at": "2025-01-01T00:00:00"}, {"url": "u2"}]
    if lines:
        bad = ['{"url"', "[1, 2]", '"text"', '{"url": "u", "word_count": "many"}', "null"]
        path.write_text("\n".join([json.dumps(good[0]), *bad, "", json.dumps(good[1])]) + "\n", encoding="utf-8")
        files = [str(path)]
    else:
        path.write_text(json.dumps(good, indent=1), encoding="utf-8")
        broken = tmp_path / "broken.json"
        bad = ['[{"url": "u"},\n {"url"']
        broken.write_text(bad[0], encoding="utf-8")
        files = [str(path), str(broken)]
    rows, rejects = sources.load_pages_json(spark, files, lines)
    assert sorted((r["url"], r["word_count"]) for r in rows.collect()) == [("u1", 3), ("u2", None)]
    assert sorted(r["record"] for r in rejects.collect()) == sorted(bad)
    assert {r["error"] for r in rejects.collect()} == {"unreadable JSON"}
    assert rows.columns == sources.read_pages_json(spark, str(path), lines).columns


def test_results_come_with_their_report_and_index_runs_with_failures(spark, tmp_path):
    runs = spark.createDataFrame([run(1), run(2, ok=False), run(3, ok=False)], schemas.RUNS)
    sinks.write_results(runs, str(tmp_path), "t")
    lines = lines_of(f"{tmp_path}/t_summary")
    assert lines[0] == "# RAG Agent Performance Test Results" and lines[1].startswith("**Generated:** 20")
    assert "- **Failed:** 2 x boom" in lines and lines[-6] == "## Recommendations"
    assert lines.index("## Top Performing Configurations") < lines.index("### Fastest Overall Configuration") < lines.index("## Model Performance Comparison")
    none = [r["line"] for r in E.full_report_lines(runs.filter("NOT success"), "now").collect()]
    assert "## Model Performance Comparison" not in none and "- **Success Rate:** 0.0%" in none
    rows = [
        (0, "Flat L2", "flat_l2", True, None, 1.0, 0.5, 0.5, 2.0, 3.0, 1.0, 4.0, 0.5, 10, 4),
        (1, "IVF PQ", "ivf_pq", False, "too few vectors", None, None, None, None, None, None, None, None, None, None),
    ]
    sinks.write_index_runs(spark.createDataFrame(rows, schemas.INDEX_RUNS), str(tmp_path), "v")
    written = {r["index_name"]: r for r in map(json.loads, lines_of(f"{tmp_path}/v.json"))}
    assert written["IVF PQ"]["error"] == "too few vectors" and written["Flat L2"]["num_vectors"] == 10
    assert [json.loads(line)["index_name"] for line in lines_of(f"{tmp_path}/v_ranking")] == ["Flat L2"]


def test_exported_chunk_files_are_read_again(spark, tmp_path):
    rows = [("a b%", 0, "zero\n\nline"), ("a b%", 1, "x\n"), ("c", 7, "ü"), ("2024", 12, "digits")]
    sinks.write_chunk_files(spark.createDataFrame(rows, "source string, chunk_id bigint, content string"), f"{tmp_path}/out")
    found = sources.read_chunk_export(spark, f"{tmp_path}/out").collect()
    assert sorted((r["source_type"], r["chunk_id"], r["content"]) for r in found) == sorted(
        (s, n, c.removesuffix("\n")) for s, n, c in rows
    )
    assert all(r["metadata"]["source_type"] == r["source_type"] and r["path"].startswith(f"{tmp_path}/out/source=") for r in found)
    assert sources.read_chunk_export(spark, f"{tmp_path}/absent").count() == 0
