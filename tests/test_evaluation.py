import statistics

import pytest
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.operators import evaluation as E


def run(n, model="m", algorithm="s", chat="c", k=5, retrieval=1.0, generation=2.0, ok=True):
    total = retrieval + generation if ok else None
    return (
        n, model, algorithm, chat, k, "q", retrieval if ok else None, generation if ok else None, total,
        k if ok else 0, 10, [0.0], "r", ok, None if ok else "boom",
    )


def runs(spark, rows):
    return spark.createDataFrame(rows, schemas.RUNS)


def test_summary_counts_failures_but_times_only_successes(spark):
    df = runs(spark, [run(1), run(2, retrieval=3.0), run(3, ok=False)])
    row = E.run_summary(df).first()
    assert (row["total_tests"], row["successful_tests"], row["success_rate"]) == (3, 2, round(200 / 3, 6))
    assert (row["avg_retrieval_time"], row["avg_total_time"]) == (2.0, 4.0)
    assert (row["fastest_total_time"], row["slowest_total_time"], row["error"]) == (3.0, 5.0, None)


def test_all_failed(spark):
    df = runs(spark, [run(1, ok=False)])
    row = E.run_summary(df).first()
    assert row["error"] == "No successful test results" and row["avg_total_time"] is None
    assert E.best_configs(df).count() == 0 and E.runs_by_dimension(df).count() == 0
    assert E.report_lines(df).count() == 5


def test_by_dimension(spark):
    df = runs(spark, [run(1, model="a", k=3), run(2, model="b", k=3, generation=4.0), run(3, model="b", k=10, ok=False)])
    got = {(r["dimension"], r["value"]): tuple(r)[2:] for r in E.runs_by_dimension(df).collect()}
    assert got == {
        ("embedding_model", "a"): (3.0, 3.0, 3.0), ("embedding_model", "b"): (5.0, 5.0, 5.0),
        ("search_algorithm", "s"): (4.0, 3.0, 5.0), ("llm_model", "c"): (4.0, 3.0, 5.0),
        ("chunk_size", "3"): (4.0, 3.0, 5.0),
    }


def test_best_configs_take_the_first_on_ties(spark):
    df = runs(spark, [run(5, retrieval=2.0), run(2), run(3), run(4, retrieval=3.0, generation=0.5), run(1, ok=False)])
    got = {r["metric"]: r["run_id"] for r in E.best_configs(df).collect()}
    assert got == {"fastest_retrieval": 2, "fastest_generation": 4, "fastest_overall": 2}


def test_latency_uses_the_population_deviation(spark):
    times = [0.001, 0.002, 0.004]
    df = spark.createDataFrame([("i", t) for t in times] + [("one", 0.5)], "g string, t double")
    got = {r["g"]: r for r in E.latency_stats(df, "g", "t").collect()}
    assert got["i"]["std_search_time_ms"] == pytest.approx(statistics.pstdev(times) * 1000, abs=1e-6)
    assert got["one"]["std_search_time_ms"] == 0.0 and got["i"]["total_queries"] == 3


def test_run_ranking_keeps_input_order_on_ties(spark):
    df = runs(spark, [run(n, generation=float(n % 2)) for n in range(20)] + [run(99, ok=False)])
    got = [r["run_id"] for r in E.run_ranking(df).orderBy("position").collect()]
    assert got == [*range(0, 20, 2), *range(1, 20, 2)]


def test_index_ranking(spark):
    rows = [("a", 3.0, 1.0), ("b", 1.0, 3.0), ("c", 2.0, 2.0)]
    df = spark.createDataFrame(
        [(at, n, s, c, 7.0, True) for at, (n, s, c) in enumerate(rows)] + [(9, "bad", 0.0, 0.0, 0.0, False)],
        "input_order int, index_name string, avg_search_time_ms double, creation_time double, memory_usage_mb double, success boolean",
    )
    got = {r["index_name"]: tuple(r)[1:] for r in E.index_ranking(df).collect()}
    assert got == {"a": (3, 1, 1, 2.0, False), "b": (1, 3, 2, 1.8, True), "c": (2, 2, 3, 2.2, False)}


def test_cost_model(spark):
    names = ["Fast & Cheap", "Balanced", "High Quality", "Custom", "Balanced"]
    df = spark.createDataFrame([(n,) for n in names], "config_name string")
    got = {r["config_name"]: (r["runs"], r["cost_per_1000"]) for r in E.cost_by_config(df, E.preset_table(spark), E.price_table(spark)).collect()}
    assert got == {"Fast & Cheap": (1, 0.76), "Balanced": (2, 0.29), "High Quality": (1, 7.565), "Custom": (1, 0.76)}


def test_grid(spark):
    queries = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "query string")
    grid = E.experiment_grid(queries)
    assert grid.count() == 324 and grid.distinct().count() == 324
    assert E.sample_first(queries, "query", 2).count() == 2


def test_total_time_with_setup(one):
    assert one(E.total_time("r", "g", "s"), r=1.0, g=2.0, s=4.0) == 7.0


def test_report(spark):
    df = runs(spark, [run(1), run(2, model="b", generation=4.0), run(3, ok=False)])
    lines = [r["line"] for r in E.report_lines(df).orderBy("section", "line_no").collect()]
    assert "- **Success Rate:** 66.7%" in lines and "- **Average Total Time:** 4.000s" in lines
    assert "| b | 5.000 | 5.000 | 5.000 |" in lines and "- **Chunk Size:** 5" in lines


def test_footprint(spark):
    df = spark.createDataFrame([(n, [0.0] * 8) for n in range(3)], "vec_id bigint, embedding array<float>")
    assert tuple(E.index_footprint(df).first()) == (3, 8, round(96 / 1048576, 6))
    assert E.index_footprint(df.filter(F.lit(False))).first()["memory_usage_mb"] is None


def test_a_missing_timing_never_wins(spark):
    df = runs(spark, [run(1, retrieval=2.0), run(2, retrieval=3.0)]).withColumn(
        "retrieval_time", F.expr("CASE WHEN run_id = 2 THEN NULL ELSE retrieval_time END")
    )
    best = {r["metric"]: r["run_id"] for r in E.best_configs(df).collect()}
    assert best["fastest_retrieval"] == 1
