import glob
import os
import shutil

from pyspark.sql import functions as F

from corpusloom import streaming as S
from corpusloom.plans import QUERIES
from corpusloom.streaming.pages import _versions, append_stream

PAGES = "page_id bigint, url string, html string, at timestamp"


def pages(spark, rows):
    df = spark.createDataFrame([(*r, None) for r in rows], PAGES)
    return df.withColumn("at", F.timestamp_seconds(F.col("page_id")))


def feed(spark, tmp_path, batches):
    for at, rows in enumerate(batches):
        pages(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b={at}")


def done(query):
    query.awaitTermination()
    assert query.exception() is None


def test_pages_are_stored_once_and_failures_can_return(spark, tmp_path):
    feed(spark, tmp_path, [[(1, "a", "x"), (2, "b", None), (3, "a", "x")], [(4, "a", "x"), (5, "b", "y")]])
    stream = S.stream_table(spark, f"{tmp_path}/in", files_per_trigger=1)
    done(append_stream(S.dedup_pages(stream), f"{tmp_path}/out", f"{tmp_path}/cp"))
    assert sorted((r["url"], r["html"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", "x"), ("b", "y")]
    # What was seen survives a restart.
    feed(spark, tmp_path, [[], [], [(6, "a", "x"), (7, "c", "z")]])
    stream = S.stream_table(spark, f"{tmp_path}/in", files_per_trigger=1)
    done(append_stream(S.dedup_pages(stream), f"{tmp_path}/out", f"{tmp_path}/cp"))
    assert sorted(r["url"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]


def test_dedup_within_watermark(spark, tmp_path):
    feed(spark, tmp_path, [[(n, "hot", "x") for n in range(1, 200)] + [(3, "b", "y")]])
    stream = S.stream_table(spark, f"{tmp_path}/in")
    done(append_stream(S.dedup_pages(stream, event_time="at"), f"{tmp_path}/out", f"{tmp_path}/cp"))
    assert sorted(r["url"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["b", "hot"]


def test_latest_version_is_read(spark, tmp_path):
    feed(spark, tmp_path, [[(1, "a", "old"), (2, "a", "newer"), (3, "b", "b")], [(9, "a", "newest")], [(4, "b", "b2")]])
    for _ in range(2):
        stream = S.stream_table(spark, f"{tmp_path}/in", files_per_trigger=1)
        done(S.upsert_pages(stream, f"{tmp_path}/out", f"{tmp_path}/cp", version="at"))
        got = {r["url"]: r["html"] for r in S.read_latest(spark, f"{tmp_path}/out", version="at").collect()}
        assert got == {"a": "newest", "b": "b2"}


def test_threads(spark, tmp_path):
    rows = [(c, t, "user", f"{c}-{t}") for c in (1, 2) for t in range(5)]
    schema = "conv_id bigint, turn bigint, role string, text string"
    for part in (rows[:6], rows[4:]):  # two messages come twice
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = S.stream_table(spark, f"{tmp_path}/in", files_per_trigger=1)
    done(S.append_threads(stream, f"{tmp_path}/out", f"{tmp_path}/cp"))
    log = S.thread_log(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, log.select("conv_id", "turn", "role", "text").collect())) == rows
    sizes = S.thread_sizes(log).orderBy("conv_id").collect()
    assert [tuple(r) for r in sizes] == [(1, 5, 4), (2, 5, 4)]


def test_the_snapshot_is_merged_and_a_replay_changes_nothing(spark, tmp_path):
    feed(spark, tmp_path, [[(n, f"u{n}", "old") for n in range(1, 40)], [(100, "u3", "new"), (2, "u4", "late")], [(101, "u3", "newer"), (102, "z", "z")]])

    def run(checkpoint):
        stream = S.stream_table(spark, f"{tmp_path}/in", files_per_trigger=1)
        done(S.upsert_pages(stream, f"{tmp_path}/out", f"{tmp_path}/{checkpoint}", version="at", buckets=8))
        return sorted((r["url"], r["html"]) for r in S.read_latest(spark, f"{tmp_path}/out", version="at").collect())

    first = run("cp")
    wanted = {f"u{n}": "old" for n in range(1, 40)} | {"u3": "newer", "z": "z"}
    assert first == sorted(wanted.items())
    # The last batch again, as after a failure before its commit was written.
    shutil.rmtree(f"{tmp_path}/out/batch=2")
    os.remove(f"{tmp_path}/cp/commits/2")
    for crc in glob.glob(f"{tmp_path}/cp/commits/.2.crc"):
        os.remove(crc)
    assert run("cp") == first
    # Each key is one row of one bucket, and no bucket keeps more than two versions.
    held = _versions(spark, f"{tmp_path}/out")
    assert max(map(len, held.values())) <= 2
    rows = S.read_latest(spark, f"{tmp_path}/out", version="at")
    assert rows.count() == rows.select("url").distinct().count() == 40


def test_remembered_messages_go_after_their_time(spark, tmp_path):
    schema = "conv_id bigint, turn bigint, role string, text string, at timestamp"

    def put(rows):
        frame = spark.createDataFrame([(c, t, "user", f"{c}-{t}", None) for c, t, _ in rows], schema)
        times = spark.createDataFrame([(c, t, s + 5000) for c, t, s in rows], "conv_id bigint, turn bigint, s bigint")
        joined = frame.drop("at").join(times, ["conv_id", "turn"]).select("conv_id", "turn", "role", "text", F.timestamp_seconds("s").alias("at"))
        joined.distinct().coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = S.stream_table(spark, f"{tmp_path}/in", files_per_trigger=1)
        query = S.append_threads(stream, f"{tmp_path}/out", f"{tmp_path}/cp", event_time="at", keep="1 minute")
        done(query)
        # Batches without data, which move the watermark on, come at the end of a run too.
        operators = [o for p in query.recentProgress for o in p["stateOperators"]]
        return operators[-1]["numRowsTotal"], sum(o["numRowsDroppedByWatermark"] for o in operators)

    put([(1, n, n) for n in range(20)])
    held, late = put([(1, 5, 6), (2, 1, 30)])  # a copy within the time, and a new message
    assert held == 21 and late == 0
    held, _ = put([(3, 1, 10_000)])
    held, late = put([(1, 7, 7), (3, 2, 10_001)])  # far too late, and one in time
    assert held == 2 and late == 1
    log = S.thread_log(spark, f"{tmp_path}/out").collect()
    assert len(log) == 23 and len({(r["conv_id"], r["turn"]) for r in log}) == 23


def tables(spark, folder):
    """Tables that are folders of several files, two pages sharing a URL."""
    rows = [(n, f"http://h/{n // 2 if n < 2 else n}", f"<p>{n}</p>") for n in range(12)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3).write.parquet(f"{folder}/pages.parquet")
    said = [(c, t, "user", f"{c}-{t}") for c in range(3) for t in range(4)]
    frame = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string")
    frame.repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return rows, said


def test_tables_of_several_files_are_deduplicated(spark, tmp_path):
    rows, _ = tables(spark, tmp_path)
    assert sorted(map(tuple, QUERIES["stream_dedup_pages"](spark, str(tmp_path)).collect())) == rows


def test_messages_of_several_files_are_appended(spark, tmp_path):
    _, said = tables(spark, tmp_path)
    assert sorted(map(tuple, QUERIES["stream_threads"](spark, str(tmp_path)).collect())) == said


def test_pages_of_several_files_are_versioned(spark, tmp_path):
    rows, _ = tables(spark, tmp_path)
    got = sorted(map(tuple, QUERIES["stream_upsert_pages"](spark, str(tmp_path)).collect()))
    assert got == [(page, url, "2025-02-01 00:00:00", html) for page, url, html in rows]


def test_a_glob_takes_files_and_folders(spark, tmp_path):
    rows, _ = tables(spark, tmp_path)
    spark.createDataFrame([(99, "z", "z")], "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/one")
    shutil.copy(glob.glob(f"{tmp_path}/one/part-*.parquet")[0], f"{tmp_path}/pages-single.parquet")
    for name, wanted in (("pages*.parquet", [*rows, (99, "z", "z")]), ("pages-*.parquet", [(99, "z", "z")])):
        out = f"{tmp_path}/out-{len(wanted)}"
        done(append_stream(S.stream_table(spark, str(tmp_path), name), f"{out}/table", f"{out}/cp"))
        assert sorted(map(tuple, spark.read.parquet(f"{out}/table").collect())) == wanted
