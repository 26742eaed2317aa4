"""Times the headline queries, each under a limit; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import threading
import time

from oddspark.plans import load
from oddspark.session import build_session

HEADLINE = [
    "score_pairs",
    "score_pairs_molecule",
    "score_documents",
    "score_counts",
    "active_comparator",
    "bias_profile",
    "pair_severity",
    "pair_trend",
    "expectedness",
    "label_mentions",
    "mgps",
    "mgps_fit",
    "detect_changes",
    "drug_facts",
    "rolling_rate",
    "drug_lookup",
    "drug_profile",
    "list_panels",
    "worksheet_grid",
]


def timed(spark, make, limit: float) -> float | None:
    """Seconds of a query that is run to its last row; None if it fails or its jobs are cancelled at the limit."""
    start = time.perf_counter()
    timer = threading.Timer(limit, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        make().write.format("noop").mode("overwrite").save()
    except Exception as error:
        print(str(error)[:300], file=sys.stderr)
        return None
    finally:
        timer.cancel()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().QUERIES
    wanted = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    limit, whole = float(os.environ.get("BENCH_LIMIT_S", "120")), float(os.environ.get("BENCH_TOTAL_S", "1200"))
    begun = time.perf_counter()
    times: dict[str, float] = {}
    stopped: list[str] = []
    for name in wanted:
        left = min(limit, whole - (time.perf_counter() - begun))
        if left <= 0:
            stopped.append(name)
            continue
        seconds = timed(spark, lambda: queries[name](spark, sf_dir), left)
        if seconds is None:
            stopped.append(name)
        else:
            times[name] = round(seconds, 3)
        print(name, times.get(name, "stopped or failed"), file=sys.stderr, flush=True)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall-clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "stopped": stopped,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
                "line_rows_per_sec_score_pairs": round(lines / times["score_pairs"]) if "score_pairs" in times else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
