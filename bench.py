"""Time the headline queries and the ingest path; prints one JSON line.

BENCH_SF_DIR   folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS     cores (default 8)
BENCH_ROWS     generated rows for the ingest and stored-table figures (default 1,000,000)
BENCH_DENSE_ROWS   generated rows of one busy day, for roll-up against raw counts (default 4,000,000)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from datetime import datetime, timedelta
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from cinderlog.catalog.registry import all_queries  # noqa: E402
from cinderlog.functions.times import literal_like  # noqa: E402
from cinderlog.operators.aggregate import aggregate_raw, aggregate_rollup  # noqa: E402
from cinderlog.operators.alerts import alert_counts  # noqa: E402
from cinderlog.operators.rollup import build_rollup  # noqa: E402
from cinderlog.operators.search import search  # noqa: E402
from cinderlog.plans.spec import AggSpec, LogQuery  # noqa: E402
from cinderlog.schemas import RULES  # noqa: E402
from cinderlog.session import local_session  # noqa: E402
from cinderlog.sources.batches import open_batches  # noqa: E402
from cinderlog.sources.synthetic import as_bodies, synthetic_logs  # noqa: E402
from cinderlog.sources.tables import LogStore  # noqa: E402
from cinderlog.streaming.ingest import IngestJob  # noqa: E402

HEADLINE = (
    "agg_1m agg_1h_by_service agg_rollup_path agg_text_filter agg_attr_filter agg_exact_edges rollup_build search_latest "
    "search_combined search_text search_cursor overview level_distribution service_summary top_errors validate_accepted "
    "validate_rejected batch_result alert_counts alerts_firing alert_replay retention_chunks notification_feed"
).split()
NOW = datetime(2024, 1, 31)


def timed(run, repeats: int = 3) -> float:
    """Best of some runs; the first one also warms up."""
    best = None
    for _ in range(repeats):
        start = time.perf_counter()
        run()
        spent = time.perf_counter() - start
        best = spent if best is None else min(best, spent)
    return round(best, 3)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def ingest_figures(spark, rows: int, folder: str) -> tuple[dict[str, float], LogStore]:
    """JSON bodies to validated rows, a stored table and roll-up deltas, all through one micro-batch."""
    path = f"{folder}/bodies"
    bodies = as_bodies(synthetic_logs(spark, rows, NOW), 500)
    bodies.select(F.col("batch_id").cast("string").alias("source_file"), "body").repartition(32).write.parquet(path)
    store = LogStore(spark, f"{folder}/store")
    opened = open_batches(spark.read.parquet(path)).withColumn("as_of", literal_like(NOW, T.TimestampType()))
    spent = timed(lambda: IngestJob(store)(opened, 0), repeats=2)
    store.compact_rollup()
    return {"ingest_batch": spent}, store


def dense_store(spark, rows: int, folder: str) -> LogStore:
    """A busy day: many rows per minute, service and level, as a roll-up is meant for."""
    store = LogStore(spark, f"{folder}/dense")
    logs = synthetic_logs(spark, rows, NOW, days=1)
    store.append_logs(logs, 0)
    store.append_rollup(build_rollup(logs), 0)
    store.compact_rollup()
    return store


def stored_figures(spark, store: LogStore, dense: LogStore) -> dict[str, float]:
    logs, rollup = store.logs(), store.rollup()
    week = NOW - timedelta(days=7), NOW
    day = NOW - timedelta(days=1), NOW
    busy, counts = dense.logs(), dense.rollup()
    rules = spark.createDataFrame(
        [(i, None if i % 3 == 0 else "auth", 10, 60 * (i + 1), "http://example.invalid", None) for i in range(20)], RULES
    )
    runs = {
        "stored_agg_rollup_1h": lambda: aggregate_rollup(rollup, AggSpec(*week, "1h", group_by="service")).collect(),
        "stored_agg_levels_1d": lambda: store.aggregate(AggSpec(NOW - timedelta(days=28, hours=5, minutes=7), NOW, "1d", group_by="service")).collect(),
        "stored_agg_minutes_1d": lambda: aggregate_rollup(rollup, AggSpec(NOW - timedelta(days=28, hours=5, minutes=7), NOW, "1d", group_by="service")).collect(),
        "stored_page_500": lambda: store.page(LogQuery(limit=1000), 500).collect(),
        "stored_agg_raw_1h": lambda: aggregate_raw(logs, AggSpec(*week, "1h", group_by="service")).collect(),
        "dense_agg_rollup_1h": lambda: aggregate_rollup(counts, AggSpec(*day, "1h", group_by="service")).collect(),
        "dense_agg_raw_1h": lambda: aggregate_raw(busy, AggSpec(*day, "1h", group_by="service")).collect(),
        "stored_agg_text": lambda: aggregate_raw(logs, AggSpec(*week, "1h", q="timed out")).collect(),
        "stored_search_range": lambda: search(logs, LogQuery(service="auth", since=NOW - timedelta(hours=1), limit=1000)).collect(),
        "stored_search_attr": lambda: search(logs, LogQuery(attributes={"user_id": "42"}, limit=1000)).collect(),
        "stored_search_newest": lambda: store.newest(LogQuery()).collect(),
        "stored_alert_counts": lambda: alert_counts(logs, rules, NOW, rollup).collect(),
    }
    return {name: timed(run) for name, run in runs.items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    rows = int(os.environ.get("BENCH_ROWS", "1000000"))
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    spent = {}
    queries = all_queries()
    for name in HEADLINE:
        spent[name] = timed(lambda: drain(queries[name](spark, sf_dir)))
    folder = tempfile.mkdtemp(prefix="cinderlog-bench-")
    ingest, store = ingest_figures(spark, rows, folder)
    spent.update(ingest)
    dense_rows = int(os.environ.get("BENCH_DENSE_ROWS", "4000000"))
    spent.update(stored_figures(spark, store, dense_store(spark, dense_rows, folder)))
    print(json.dumps({
        "metric": "headline queries and one ingest batch, total", "value": round(sum(spent.values()), 3), "unit": "sec",
        "queries": spent, "sf": sf_dir.rsplit("sf", 1)[-1], "ingest_rows": rows,
        "ingest_rows_per_sec": round(rows / spent["ingest_batch"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
