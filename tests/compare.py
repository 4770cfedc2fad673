"""Compare registered queries with their SQL over a data folder.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusloom.plans import ORACLES, QUERIES  # noqa: E402
from corpusloom.session import build_session  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def plain(value):
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return repr(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    return sorted(tuple(plain(row[at]) for at in order) for row in rows)


def compare(spark, db, folder, name):
    """None when equal, else a short description of the difference."""
    frame = QUERIES[name](spark, folder)
    rows = [tuple(row) for row in frame.collect()]
    if name not in ORACLES:
        return None if rows else "no rows"
    wanted = db.execute(ORACLES[name])
    columns = [d[0] for d in wanted.description]
    expected = wanted.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    ours, theirs = canonical(frame.columns, rows), canonical(columns, expected)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    different = [pair for pair in zip(ours, theirs) if pair[0] != pair[1]]
    if different:
        a, b = different[0]
        parts = [(x[:300], y[:300]) for x, y in zip(a, b) if x != y]
        return f"{len(different)} rows differ, first: {parts}"
    return None


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="8g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, db, folder, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {time.time() - start:6.1f}s {name} {'' if name in ORACLES else '(rows only)'} {problem or ''}", flush=True)
