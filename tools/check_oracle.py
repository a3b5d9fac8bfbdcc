"""Compare the registered queries with their SQL, run by DuckDB on the same tables.

    python tools/check_oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import re
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cinderlog.catalog.registry import all_queries  # noqa: E402
from cinderlog.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(cells, key=repr)


# No Python in the row path, no pairing of all rows with all rows.
UNWANTED = re.compile(r"PythonUDF|EvalPython|MapInPandas|CartesianProduct|BroadcastNestedLoopJoin")


def compare(spark, con, query, sf_dir: str) -> tuple[str, int, float, float]:
    t0 = time.time()
    frame = query(spark, sf_dir)
    unwanted = UNWANTED.search(frame._jdf.queryExecution().executedPlan().toString())
    if unwanted:
        return f"PLAN {unwanted.group()}", 0, 0.0, 0.0
    mine = rows_of(frame.columns, frame.collect())
    t1 = time.time()
    if query.sql is None:
        return "rows only", len(mine[1]), t1 - t0, 0.0
    cursor = con.execute(query.sql)
    theirs = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    t2 = time.time()
    if mine[0] != theirs[0]:
        verdict = f"COLUMNS {mine[0]} / {theirs[0]}"
    elif mine[1] != theirs[1]:
        only = [r for r in mine[1] if r not in set(theirs[1])][:2], [r for r in theirs[1] if r not in set(mine[1])][:2]
        verdict = f"DIFFERENT {len(mine[1])} / {len(theirs[1])} rows: {only}"[:1500]
    else:
        types = [type(a) != type(b) for a, b in zip(*(max(r[1], default=(), key=lambda t: sum(x is not None for x in t)) for r in (mine, theirs)))]
        verdict = "TYPES" if any(types) else "ok"
    return verdict, len(mine[1]), t1 - t0, t2 - t1


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark, con = local_session("8"), oracle(sf_dir)
    bad = 0
    for name, query in all_queries().items():
        if names and name not in names:
            continue
        try:
            verdict, rows, spark_s, duck_s = compare(spark, con, query, sf_dir)
        except Exception as error:  # noqa: BLE001
            verdict, rows, spark_s, duck_s = f"ERROR {type(error).__name__}: {str(error)[:900]}", 0, 0.0, 0.0
        bad += verdict not in ("ok", "rows only")
        print(f"{name:28} {rows:8} rows  spark {spark_s:6.2f}s  sql {duck_s:6.2f}s  {verdict}", flush=True)
    print(f"{bad} not equal")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
