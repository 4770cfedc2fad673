"""Experiment analysis over the event table read as a log of runs.

The kind of event names the algorithm, the user picks models and k, the value
is the total time of the run, and an error event is a failed run without
timings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import evaluation as E
from corpusloom.plans.registry import RUN_DATE_ISO, query, table


def runs(spark: SparkSession, folder: str) -> DataFrame:
    def choose(values, by):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))

    user = F.col("user_id")
    ok = F.col("event_type") != "error"
    time = F.when(ok, F.col("value"))
    return table(spark, folder, "events").select(
        F.col("event_id").alias("run_id"),
        choose(E.EMBEDDING_MODELS, user).alias("embedding_model"),
        F.col("event_type").alias("search_algorithm"),
        choose(E.CHAT_MODELS, F.floor(user / 3)).alias("llm_model"),
        choose(E.CHUNK_COUNTS, user).alias("chunk_size"),
        (time / 4).alias("retrieval_time"),
        (time * 3 / 4).alias("generation_time"),
        (time / 4 + time * 3 / 4).alias("total_time"),
        ok.alias("success"),
        F.when(~ok, F.lit("error event")).alias("error"),
    )


_RUNS = """
    runs AS (
      SELECT event_id AS run_id,
        ['text-embedding-3-small', 'text-embedding-3-large', 'text-embedding-ada-002'][user_id % 3 + 1] AS embedding_model,
        event_type AS search_algorithm,
        ['gpt-4o-mini', 'gpt-4o', 'gpt-3.5-turbo'][(user_id // 3) % 3 + 1] AS llm_model,
        [3, 5, 7, 10][user_id % 4 + 1] AS chunk_size,
        CASE WHEN event_type <> 'error' THEN value / 4 END AS retrieval_time,
        CASE WHEN event_type <> 'error' THEN value * 3 / 4 END AS generation_time,
        CASE WHEN event_type <> 'error' THEN value / 4 + value * 3 / 4 END AS total_time,
        event_type <> 'error' AS success
      FROM events)
"""
_SUMMARY = """
    summary AS (
      SELECT count(*) AS total_tests, count(*) FILTER (WHERE success) AS successful_tests,
        round(100.0::DOUBLE * count(*) FILTER (WHERE success) / count(*), 6) AS success_rate,
        round(avg(retrieval_time) FILTER (WHERE success), 6) AS avg_retrieval_time,
        round(avg(generation_time) FILTER (WHERE success), 6) AS avg_generation_time,
        round(avg(total_time) FILTER (WHERE success), 6) AS avg_total_time,
        round(min(total_time) FILTER (WHERE success), 6) AS fastest_total_time,
        round(max(total_time) FILTER (WHERE success), 6) AS slowest_total_time
      FROM runs)
"""
_BY_DIMENSION = """
    by_dimension AS (
      SELECT CASE WHEN grouping(embedding_model) = 0 THEN 'embedding_model'
                  WHEN grouping(search_algorithm) = 0 THEN 'search_algorithm'
                  WHEN grouping(llm_model) = 0 THEN 'llm_model' ELSE 'chunk_size' END AS dimension,
        coalesce(embedding_model, search_algorithm, llm_model, chunk_size::VARCHAR) AS value,
        round(avg(total_time), 6) AS mean_time, round(min(total_time), 6) AS min_time,
        round(max(total_time), 6) AS max_time
      FROM runs WHERE success
      GROUP BY GROUPING SETS ((embedding_model), (search_algorithm), (llm_model), (chunk_size)))
"""


@query("run_summary", f"WITH {_RUNS}, {_SUMMARY} SELECT * FROM summary")
def run_summary(spark, folder):
    return E.run_summary(runs(spark, folder)).drop("error")


@query("runs_by_dimension", f"WITH {_RUNS}, {_BY_DIMENSION} SELECT * FROM by_dimension")
def runs_by_dimension(spark, folder):
    return E.runs_by_dimension(runs(spark, folder))


@query(
    "best_configs",
    f"""WITH {_RUNS}, ordered AS (
      SELECT *, row_number() OVER (ORDER BY retrieval_time, run_id) AS r,
        row_number() OVER (ORDER BY generation_time, run_id) AS g,
        row_number() OVER (ORDER BY total_time, run_id) AS t FROM runs WHERE success)
    SELECT metric, run_id, embedding_model, search_algorithm, llm_model, chunk_size, round(total_time, 6) AS total_time
    FROM (SELECT 'fastest_retrieval' AS metric, * FROM ordered WHERE r = 1
      UNION ALL SELECT 'fastest_generation', * FROM ordered WHERE g = 1
      UNION ALL SELECT 'fastest_overall', * FROM ordered WHERE t = 1)""",
)
def best_configs(spark, folder):
    return E.best_configs(runs(spark, folder)).select(
        "metric", "run_id", "embedding_model", "search_algorithm", "llm_model", "chunk_size",
        F.round("total_time", 6).alias("total_time"),
    )


@query(
    "latency_stats",
    """SELECT event_type, round(avg(value * 1000), 6) AS avg_search_time_ms, round(min(value * 1000), 6) AS min_search_time_ms,
      round(max(value * 1000), 6) AS max_search_time_ms, round(stddev_pop(value * 1000), 6) AS std_search_time_ms,
      count(value) AS total_queries FROM events GROUP BY event_type""",
)
def latency_stats(spark, folder):
    return E.latency_stats(table(spark, folder, "events"), "event_type", "value")


@query(
    "run_ranking",
    f"""WITH {_RUNS} SELECT run_id, total_time, row_number() OVER (ORDER BY total_time, run_id) AS position
      FROM runs WHERE success""",
)
def run_ranking(spark, folder):
    return E.run_ranking(runs(spark, folder))


_REPORT = f"""WITH {_RUNS}, {_SUMMARY}, {_BY_DIMENSION}, best AS (
      SELECT * FROM runs WHERE success ORDER BY total_time, run_id LIMIT 1)
    SELECT 1 AS section, unnest(range(5))::INTEGER AS line_no, unnest(['# RAG Agent Performance Test Results',
      '## Test Summary', concat('- **Total Tests:** ', total_tests),
      concat('- **Successful Tests:** ', successful_tests),
      printf('- **Success Rate:** %.1f%%', success_rate)]) AS line FROM summary
    UNION ALL
    SELECT 2, unnest(range(6))::INTEGER, unnest(['## Performance Metrics',
      printf('- **Average Retrieval Time:** %.3fs', avg_retrieval_time),
      printf('- **Average Generation Time:** %.3fs', avg_generation_time),
      printf('- **Average Total Time:** %.3fs', avg_total_time),
      printf('- **Fastest Response:** %.3fs', fastest_total_time),
      printf('- **Slowest Response:** %.3fs', slowest_total_time)]) FROM summary
    UNION ALL
    SELECT 3, unnest(range(6))::INTEGER, unnest(['### Fastest Overall Configuration',
      concat('- **Embedding Model:** ', embedding_model), concat('- **Search Algorithm:** ', search_algorithm),
      concat('- **LLM Model:** ', llm_model), concat('- **Chunk Size:** ', chunk_size),
      printf('- **Total Time:** %.3fs', total_time)]) FROM best
    UNION ALL
    SELECT (4 + i)::INTEGER, unnest(range(3))::INTEGER,
      unnest([concat('### By ', ['Embedding Model', 'Search Algorithm', 'Llm Model', 'Chunk Size'][i + 1]),
        '| Model | Avg Time (s) | Min Time (s) | Max Time (s) |',
        '|-------|--------------|--------------|---------------|'])
    FROM summary, unnest(range(4)) AS u(i)
    UNION ALL
    SELECT (3 + list_position(['embedding_model', 'search_algorithm', 'llm_model', 'chunk_size'], dimension))::INTEGER,
      2 + row_number() OVER (PARTITION BY dimension ORDER BY value)::INTEGER,
      printf('| %s | %.3f | %.3f | %.3f |', value, mean_time, min_time, max_time) FROM by_dimension"""


@query("run_report", _REPORT)
def run_report(spark, folder):
    return E.report_lines(runs(spark, folder))


# Headings and closing lines of the report.
_ADVICE = """VALUES (99, 0, '## Recommendations'), (99, 1, 'Based on the test results:'),
      (99, 2, '1. **For fastest response times**, use the configuration listed above'),
      (99, 3, '2. **For cost optimization**, consider using smaller embedding models'),
      (99, 4, '3. **For accuracy**, experiment with different chunk sizes'),
      (99, 5, '4. **Monitor rate limits** when using OpenAI models in production')"""


@query(
    "run_report_full",
    f"""WITH report AS ({_REPORT}), {_RUNS},
    failed AS (SELECT 'error event' AS error, count(*) AS n FROM runs WHERE NOT success HAVING count(*) > 0)
    SELECT section, line_no * 2 AS line_no, line FROM report
    UNION ALL SELECT 1, 1, '**Generated:** {RUN_DATE_ISO}'
    UNION ALL SELECT * FROM (VALUES (3, -1, '## Top Performing Configurations'), (4, -1, '## Model Performance Comparison'))
      WHERE (SELECT count(*) FROM runs WHERE success) > 0
    UNION ALL SELECT 2, 100 + row_number() OVER (ORDER BY n DESC, error)::INTEGER, concat('- **Failed:** ', n, ' x ', error)
      FROM failed QUALIFY row_number() OVER (ORDER BY n DESC, error) <= 20
    UNION ALL ({_ADVICE})""",
)
def run_report_full(spark, folder):
    """The report with its time, headings, reasons of failures and recommendations."""
    return E.full_report_lines(runs(spark, folder), RUN_DATE_ISO)


@query(
    "experiment_grid",
    """SELECT item_id, text AS query, embedding_model, search_algorithm, llm_model, chunk_size
    FROM benchmark,
      (VALUES ('text-embedding-3-small'), ('text-embedding-3-large'), ('text-embedding-ada-002')) e(embedding_model),
      (VALUES ('faiss_l2'), ('faiss_cosine'), ('basic_cosine')) s(search_algorithm),
      (VALUES ('gpt-4o-mini'), ('gpt-4o'), ('gpt-3.5-turbo')) l(llm_model),
      (VALUES (3), (5), (7), (10)) k(chunk_size)""",
)
def experiment_grid(spark, folder):
    return E.experiment_grid(table(spark, folder, "benchmark").select("item_id", F.col("text").alias("query")))


@query(
    "cost_model",
    """WITH named AS (
      SELECT ['Fast & Cheap', 'Balanced', 'High Quality', 'Custom'][user_id % 4 + 1] AS config_name FROM events),
    counts AS (SELECT config_name, count(*) AS runs FROM named GROUP BY config_name),
    presets(config_name, embedding, llm) AS (VALUES ('Fast & Cheap', 'text-embedding-3-small', 'gpt-3.5-turbo'),
      ('Balanced', 'text-embedding-3-large', 'gpt-4o-mini'), ('High Quality', 'text-embedding-3-large', 'gpt-4o')),
    e(embedding, price) AS (VALUES ('text-embedding-3-small', 0.02), ('text-embedding-3-large', 0.13),
      ('text-embedding-ada-002', 0.10)),
    l(llm, price) AS (VALUES ('gpt-3.5-turbo', 0.50), ('gpt-4o-mini', 0.15), ('gpt-4o', 5.00))
    SELECT config_name, coalesce(embedding, '') AS embedding, coalesce(llm, '') AS llm, runs,
      round((500 / 1e6::DOUBLE * coalesce(e.price, 0.02)::DOUBLE + 1500 / 1e6::DOUBLE * coalesce(l.price, 0.50)::DOUBLE)
        * 1000, 6) AS cost_per_1000
    FROM counts LEFT JOIN presets USING (config_name) LEFT JOIN e USING (embedding) LEFT JOIN l USING (llm)""",
)
def cost_model(spark, folder):
    names = F.array(*[F.lit(n) for n in (*[p[0] for p in E.PRESETS], "Custom")])
    named = table(spark, folder, "events").select(
        F.element_at(names, (F.col("user_id") % 4 + 1).cast("int")).alias("config_name")
    )
    return E.cost_by_config(named, E.preset_table(spark), E.price_table(spark)).fillna("", ["embedding", "llm"])


def index_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One run per index type: events of a kind are its searches, the vector
    table gives the memory estimate that is equal for all."""
    kinds = ("click", "view", "error", "purchase", "signup")
    details = F.create_map(
        *[
            x
            for at, (kind, (name, index_type)) in enumerate(zip(kinds, E.INDEX_TYPES.items()))
            for x in (
                F.lit(kind),
                F.struct(F.lit(at).alias("input_order"), F.lit(name).alias("index_name"), F.lit(index_type).alias("index_type")),
            )
        ]
    )
    memory = E.index_footprint(table(spark, folder, "embeddings")).select("memory_usage_mb").scalar()
    timed = table(spark, folder, "events").groupBy("event_type").agg(
        F.round(F.avg(F.col("value") * 1000), 6).alias("avg_search_time_ms"),
        F.round(F.sum("value"), 6).alias("creation_time"),
    )
    return timed.select(
        F.inline(F.array(details[F.col("event_type")])),
        F.lit(True).alias("success"),
        "creation_time",
        memory.alias("memory_usage_mb"),
        "avg_search_time_ms",
    )


@query(
    "index_ranking",
    """WITH kinds(event_type, input_order, index_name) AS (VALUES ('click', 0, 'Flat L2'), ('view', 1, 'Flat IP'),
      ('error', 2, 'IVF Flat'), ('purchase', 3, 'IVF PQ'), ('signup', 4, 'HNSW')),
    memory AS (SELECT round(count(*) * max(len(embedding)) * 4 / 1048576.0::DOUBLE, 6) AS mb FROM embeddings),
    timed AS (SELECT event_type, round(avg(value * 1000), 6) AS ms, round(sum(value), 6) AS creation
      FROM events GROUP BY event_type),
    ranked AS (SELECT index_name, input_order,
        row_number() OVER (ORDER BY ms, input_order)::INTEGER AS search_rank,
        row_number() OVER (ORDER BY creation, input_order)::INTEGER AS creation_rank,
        row_number() OVER (ORDER BY mb, input_order)::INTEGER AS memory_rank
      FROM timed JOIN kinds USING (event_type), memory),
    scored AS (SELECT *, round(search_rank * 0.5::DOUBLE + creation_rank * 0.3::DOUBLE + memory_rank * 0.2::DOUBLE, 6)
      AS overall_score FROM ranked)
    SELECT index_name, search_rank, creation_rank, memory_rank, overall_score,
      row_number() OVER (ORDER BY overall_score, input_order) = 1 AS best_overall FROM scored""",
)
def index_ranking(spark, folder):
    return E.index_ranking(index_runs(spark, folder))
