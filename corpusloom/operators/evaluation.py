"""Analysis of experiment runs and index runs, cost model, experiment grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.numbering import running_start

# Configuration names, prices in USD per million tokens, token
# estimates, default prices, and the weights of the overall index score.
EMBEDDING_MODELS = ("text-embedding-3-small", "text-embedding-3-large", "text-embedding-ada-002")
SEARCH_ALGORITHMS = ("faiss_l2", "faiss_cosine", "basic_cosine")
CHAT_MODELS = ("gpt-4o-mini", "gpt-4o", "gpt-3.5-turbo")
CHUNK_COUNTS = (3, 5, 7, 10)
PRICES = (
    ("text-embedding-3-small", "embedding", 0.02),
    ("text-embedding-3-large", "embedding", 0.13),
    ("text-embedding-ada-002", "embedding", 0.10),
    ("gpt-3.5-turbo", "chat", 0.50),
    ("gpt-4o-mini", "chat", 0.15),
    ("gpt-4o", "chat", 5.00),
)
DEFAULT_EMBEDDING_PRICE = 0.02
DEFAULT_CHAT_PRICE = 0.50
EMBEDDING_TOKENS = 500
CHAT_TOKENS = 1500
TOKENS_PER_PRICE = 1_000_000
QUERIES_PER_COST = 1000
PRESETS = (
    ("Fast & Cheap", "text-embedding-3-small", "gpt-3.5-turbo", 3),
    ("Balanced", "text-embedding-3-large", "gpt-4o-mini", 5),
    ("High Quality", "text-embedding-3-large", "gpt-4o", 7),
)
INDEX_TYPES = {
    "Flat L2": "flat_l2",
    "Flat IP": "flat_ip",
    "IVF Flat": "ivf_flat",
    "IVF PQ": "ivf_pq",
    "HNSW": "hnsw",
}
SEARCH_WEIGHT, CREATION_WEIGHT, MEMORY_WEIGHT = 0.5, 0.3, 0.2
BYTES_PER_VALUE = 4
NO_SUCCESS = "No successful test results"
UNKNOWN_ERROR = "Unknown error"
# Headings and closing lines of the report.
REPORT_TITLE = "# RAG Agent Performance Test Results"
REPORT_SUMMARY = "## Test Summary"
REPORT_METRICS = "## Performance Metrics"
REPORT_BEST = "## Top Performing Configurations"
REPORT_FASTEST = "### Fastest Overall Configuration"
REPORT_COMPARISON = "## Model Performance Comparison"
REPORT_TABLE = ("| Model | Avg Time (s) | Min Time (s) | Max Time (s) |", "|-------|--------------|--------------|---------------|")
REPORT_ADVICE = (
    "## Recommendations",
    "Based on the test results:",
    "1. **For fastest response times**, use the configuration listed above",
    "2. **For cost optimization**, consider using smaller embedding models",
    "3. **For accuracy**, experiment with different chunk sizes",
    "4. **Monitor rate limits** when using OpenAI models in production",
)
REPORT_REASONS = 20
DIMENSIONS = ("embedding_model", "search_algorithm", "llm_model", "chunk_size")


def literal_table(spark: SparkSession, names: tuple, rows) -> DataFrame:
    """A few fixed rows as a table that needs no data from the driver at run time."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def price_table(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ("model", "kind", "usd_per_million"), PRICES)


def preset_table(spark: SparkSession) -> DataFrame:
    rows = [(at, *preset) for at, preset in enumerate(PRESETS)]
    return literal_table(spark, ("position", "name", "embedding", "llm", "chunks"), rows)


def experiment_grid(
    queries: DataFrame,
    embedding_models=EMBEDDING_MODELS,
    algorithms=SEARCH_ALGORITHMS,
    chat_models=CHAT_MODELS,
    chunk_counts=CHUNK_COUNTS,
) -> DataFrame:
    """Every configuration for every query: the query row is exploded by the
    fixed configuration lists, without a join."""
    grid = queries
    for name, values in (
        ("embedding_model", embedding_models),
        ("search_algorithm", algorithms),
        ("llm_model", chat_models),
        ("chunk_size", chunk_counts),
    ):
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return grid


def sample_first(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows in the order of an explicit key."""
    return rows.orderBy(order).limit(n)


def total_time(retrieval="retrieval_time", generation="generation_time", setup=None) -> Column:
    total = T.col(retrieval) + T.col(generation)
    return total if setup is None else T.col(setup) + total


def run_summary(runs: DataFrame) -> DataFrame:
    """Totals over all runs, timings over the successful ones."""
    ok = F.col("success")

    def metric(fn, column):
        return F.round(fn(F.when(ok, F.col(column))), 6)

    return runs.agg(
        F.count("*").alias("total_tests"),
        F.count_if(ok).alias("successful_tests"),
        F.round(F.lit(100.0) * F.count_if(ok) / F.nullif(F.count("*"), F.lit(0)), 6).alias("success_rate"),
        metric(F.avg, "retrieval_time").alias("avg_retrieval_time"),
        metric(F.avg, "generation_time").alias("avg_generation_time"),
        metric(F.avg, "total_time").alias("avg_total_time"),
        metric(F.min, "total_time").alias("fastest_total_time"),
        metric(F.max, "total_time").alias("slowest_total_time"),
    ).withColumn("error", F.when(F.col("successful_tests") == 0, F.lit(NO_SUCCESS)))


def runs_by_dimension(runs: DataFrame, dimensions=DIMENSIONS) -> DataFrame:
    """Mean, least and most total time by each dimension on its own, in one pass."""
    ok = runs.filter("success").select("total_time", *[F.col(d).cast("string").alias(d) for d in dimensions])
    grouped = ok.groupingSets([[d] for d in dimensions], *dimensions).agg(
        F.grouping_id().alias("_set"),
        F.round(F.avg("total_time"), 6).alias("mean_time"),
        F.round(F.min("total_time"), 6).alias("min_time"),
        F.round(F.max("total_time"), 6).alias("max_time"),
    )
    # grouping_id has a 0 bit at the dimension that is kept.
    full = 2 ** len(dimensions) - 1
    kept = {full - 2 ** (len(dimensions) - 1 - at): name for at, name in enumerate(dimensions)}
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for code, dimension in kept.items():
        name = F.when(F.col("_set") == code, F.lit(dimension)).otherwise(name)
        value = F.when(F.col("_set") == code, F.col(dimension)).otherwise(value)
    return grouped.select(name.alias("dimension"), value.alias("value"), "mean_time", "min_time", "max_time")


def best_configs(runs: DataFrame, order: str = "run_id") -> DataFrame:
    """The whole run that is fastest by each of three timings, first on ties."""
    ok = runs.filter("success")
    whole = F.struct(*[F.col(c) for c in ok.columns])
    titles = {
        "fastest_retrieval": "retrieval_time",
        "fastest_generation": "generation_time",
        "fastest_overall": "total_time",
    }
    found = ok.agg(
        *[
            F.min_by(F.when(F.col(metric).isNotNull(), whole), F.when(F.col(metric).isNotNull(), F.struct(metric, order))).alias(title)
            for title, metric in titles.items()
        ]
    )
    rows = F.array(*[F.struct(F.lit(t).alias("metric"), F.col(t).alias("run")) for t in titles])
    return found.select(F.inline(rows)).filter("run is not null").select("metric", "run.*")


def latency_stats(timings: DataFrame, group: str, seconds: str) -> DataFrame:
    """Search time statistics in milliseconds; the deviation is the population one."""
    ms = F.col(seconds) * 1000

    def rounded(column):
        return F.round(column, 6)

    return timings.groupBy(group).agg(
        rounded(F.avg(ms)).alias("avg_search_time_ms"),
        rounded(F.min(ms)).alias("min_search_time_ms"),
        rounded(F.max(ms)).alias("max_search_time_ms"),
        rounded(F.stddev_pop(ms)).alias("std_search_time_ms"),
        F.count(ms).alias("total_queries"),
    )


def run_ranking(runs: DataFrame, time: str = "total_time", order: str = "run_id") -> DataFrame:
    """Successful runs with their position by time, 1 being the fastest.

    Equal times keep their input order. Sorted over the cluster; no task sees
    all runs.
    """
    ok = runs.filter("success").select(order, time)
    placed = running_start(ok, [time, order], name="_before")
    return placed.select(order, time, (F.col("_before") + 1).alias("position"))


def index_footprint(vectors: DataFrame) -> DataFrame:
    """Vectors, dimension and the size estimate in MB, the same for every index type."""
    counted = vectors.agg(
        F.count("*").alias("num_vectors"), F.max(F.size("embedding")).alias("vector_dimension")
    )
    size = F.col("num_vectors") * F.col("vector_dimension") * BYTES_PER_VALUE
    return counted.withColumn("memory_usage_mb", F.round(T.megabytes(size), 6))


def index_ranking(index_runs: DataFrame) -> DataFrame:
    """Positions by search, creation and memory, weighted score and the best one.

    One row per index type comes in, so the unpartitioned windows sort a
    handful of rows. Ties keep the input order.
    """
    ok = index_runs.filter("success")

    def position(metric):
        return F.row_number().over(Window.orderBy(metric, "input_order"))

    ranked = (
        ok.withColumn("search_rank", position("avg_search_time_ms"))
        .withColumn("creation_rank", position("creation_time"))
        .withColumn("memory_rank", position("memory_usage_mb"))
    )
    score = (
        F.col("search_rank") * SEARCH_WEIGHT
        + F.col("creation_rank") * CREATION_WEIGHT
        + F.col("memory_rank") * MEMORY_WEIGHT
    )
    scored = ranked.withColumn("overall_score", F.round(score, 6))
    best = F.row_number().over(Window.orderBy("overall_score", "input_order")) == 1
    return scored.select(
        "index_name", "search_rank", "creation_rank", "memory_rank", "overall_score", best.alias("best_overall")
    )


def with_cost(configs: DataFrame, prices: DataFrame, embedding: str = "embedding", chat: str = "llm") -> DataFrame:
    """Add ``cost_per_1000``; a model without a price takes the default one."""

    def price(kind, key, name):
        return prices.filter(F.col("kind") == kind).groupBy(F.col("model").alias(key)).agg(
            F.min("usd_per_million").alias(name)
        )

    priced = configs.join(price("embedding", embedding, "_e"), embedding, "left").join(
        price("chat", chat, "_c"), chat, "left"
    )
    cost = (
        F.lit(EMBEDDING_TOKENS / TOKENS_PER_PRICE) * F.coalesce("_e", F.lit(DEFAULT_EMBEDDING_PRICE))
        + F.lit(CHAT_TOKENS / TOKENS_PER_PRICE) * F.coalesce("_c", F.lit(DEFAULT_CHAT_PRICE))
    ) * QUERIES_PER_COST
    return priced.withColumn("cost_per_1000", F.round(cost, 6)).drop("_e", "_c")


def cost_by_config(runs: DataFrame, presets: DataFrame, prices: DataFrame, name: str = "config_name") -> DataFrame:
    """Runs per configuration name with the cost estimate of its preset.

    Runs are counted first, so only one row per name meets the small tables;
    a name without a preset is priced by the defaults.
    """
    counts = runs.groupBy(name).agg(F.count("*").alias("runs"))
    first = Window.partitionBy("name").orderBy("position")
    unique = presets.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    known = unique.select(F.col("name").alias(name), "embedding", "llm")
    return with_cost(counts.join(known, name, "left"), prices)


def report_lines(runs: DataFrame) -> DataFrame:
    """The report as ordered lines: summary, metrics, best run, comparison.

    Every section is a small aggregate; ``section, line_no`` give the order.
    """
    summary = run_summary(runs)

    def number(column, digits=3):
        return F.format_string(f"%.{digits}f", F.col(column).cast("double"))

    def lines(df, section, *texts):
        rows = F.array(*texts)
        return df.select(F.lit(section).alias("section"), F.posexplode(rows).alias("line_no", "line"))

    head = (
        F.lit(REPORT_TITLE),
        F.lit(REPORT_SUMMARY),
        F.concat(F.lit("- **Total Tests:** "), F.col("total_tests").cast("string")),
        F.concat(F.lit("- **Successful Tests:** "), F.col("successful_tests").cast("string")),
        F.concat(F.lit("- **Success Rate:** "), number("success_rate", 1), F.lit("%")),
    )
    metrics = (
        F.lit(REPORT_METRICS),
        F.concat(F.lit("- **Average Retrieval Time:** "), number("avg_retrieval_time"), F.lit("s")),
        F.concat(F.lit("- **Average Generation Time:** "), number("avg_generation_time"), F.lit("s")),
        F.concat(F.lit("- **Average Total Time:** "), number("avg_total_time"), F.lit("s")),
        F.concat(F.lit("- **Fastest Response:** "), number("fastest_total_time"), F.lit("s")),
        F.concat(F.lit("- **Slowest Response:** "), number("slowest_total_time"), F.lit("s")),
    )
    titles = [
        (F.lit("### By " + dimension.replace("_", " ").title()), F.lit(REPORT_TABLE[0]), F.lit(REPORT_TABLE[1]))
        for dimension in DIMENSIONS
    ]
    # All that the one row of the summary says, in one pass; without a successful run only the head.
    said = F.array(
        *[
            F.struct(F.lit(section).alias("section"), F.lit(at).alias("line_no"), line.alias("line"))
            for section, texts in enumerate((head, metrics, (), *titles), 1)
            for at, line in enumerate(texts)
        ]
    )
    opening = summary.select("successful_tests", F.inline(said)).filter("section = 1 OR successful_tests > 0").drop("successful_tests")
    best = lines(
        best_configs(runs).filter("metric = 'fastest_overall'"),
        3,
        F.lit(REPORT_FASTEST),
        F.concat(F.lit("- **Embedding Model:** "), F.col("embedding_model")),
        F.concat(F.lit("- **Search Algorithm:** "), F.col("search_algorithm")),
        F.concat(F.lit("- **LLM Model:** "), F.col("llm_model")),
        F.concat(F.lit("- **Chunk Size:** "), F.col("chunk_size").cast("string")),
        F.concat(F.lit("- **Total Time:** "), number("total_time"), F.lit("s")),
    )
    compared = runs_by_dimension(runs)
    order = F.create_map(*[F.lit(x) for at, d in enumerate(DIMENSIONS) for x in (d, at)])
    cells = F.concat_ws(" | ", F.col("value"), number("mean_time"), number("min_time"), number("max_time"))
    by_value = Window.partitionBy("dimension").orderBy("value")
    table = compared.select(
        (order[F.col("dimension")] + 4).alias("section"),
        (F.row_number().over(by_value) + 2).alias("line_no"),
        F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"),
    )
    return reduce(DataFrame.unionByName, [opening, best, table])


def full_report_lines(runs: DataFrame, generated: str) -> DataFrame:
    """:func:`report_lines` with the time of the report, headings of its parts, the reasons of failures, recommendations.

    Lines of the plain report keep their order at even ``line_no``.
    """
    spark = runs.sparkSession
    base = report_lines(runs).withColumn("line_no", F.col("line_no") * 2)
    fixed = [(1, 1, f"**Generated:** {generated}")] + [(99, at, line) for at, line in enumerate(REPORT_ADVICE)]
    always = spark.createDataFrame(fixed, "section int, line_no int, line string")
    headings = F.array(
        *[
            F.struct(F.lit(section).alias("section"), F.lit(-1).alias("line_no"), F.lit(line).alias("line"))
            for section, line in ((3, REPORT_BEST), (4, REPORT_COMPARISON))
        ]
    )
    # Headings of parts that only successful runs fill.
    some = runs.agg(F.count_if("success").alias("n")).filter("n > 0").select(F.inline(headings))
    failed = runs.filter(~F.coalesce("success", F.lit(False))).groupBy(F.coalesce("error", F.lit(UNKNOWN_ERROR)).alias("error")).agg(
        F.count("*").alias("n")
    )
    first = Window.orderBy(F.col("n").desc(), "error")
    # The most frequent reasons; all are in the raw results.
    reasons = failed.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= REPORT_REASONS).select(
        F.lit(2).alias("section"), (F.col("at") + 100).alias("line_no"),
        F.concat(F.lit("- **Failed:** "), F.col("n").cast("string"), F.lit(" x "), F.col("error")).alias("line"),
    )
    return reduce(DataFrame.unionByName, [base, always, some, reasons])
