"""Time the registered queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores.
Besides seconds each query reports its output rows, the input rows and shuffle
bytes of its stages, and approximate searches their recall against exact ones.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusloom.plans import QUERIES  # noqa: E402
from corpusloom.session import build_session  # noqa: E402

HEADLINE_EXTRA = {"index_comparison": "recall_at_k"}


def stage_totals(spark, seen: int) -> tuple[dict, int]:
    """Input rows and shuffle bytes of the stages that ended since ``seen``."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    totals = {"input_rows": 0, "shuffle_bytes": 0}
    latest = seen
    stages = store.stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    for at in range(stages.size()):
        stage = stages.apply(at)
        if stage.stageId() <= seen:
            continue
        latest = max(latest, stage.stageId())
        totals["input_rows"] += stage.inputRecords()
        totals["shuffle_bytes"] += stage.shuffleWriteBytes()
    return totals, latest


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__ui__retainedStages=5000,
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:] or list(QUERIES)
    # One small scan before the clock runs.
    spark.read.parquet(f"{folder}/nation.parquet").count()
    seconds, details, seen = {}, {}, -1
    for name in only:
        start = time.perf_counter()
        result = QUERIES[name](spark, folder).toArrow()
        seconds[name] = round(time.perf_counter() - start, 3)
        totals, seen = stage_totals(spark, seen)
        details[name] = {"output_rows": result.num_rows, **totals}
        if name in HEADLINE_EXTRA:
            details[name]["recall_at_5"] = {r["index_type"]: r[HEADLINE_EXTRA[name]] for r in result.to_pylist()}
        print(f"{name}: {seconds[name]}s {details[name]}", file=sys.stderr)
        spark.catalog.clearCache()
    scale = re.search(r"sf([0-9.]+)$", folder)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
                "details": details,
            }
        )
    )


if __name__ == "__main__":
    main()
