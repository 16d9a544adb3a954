"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (sum of query seconds), "unit",
"queries" {name: seconds}, "sf"}.  Each query runs to completion into the
``noop`` sink (full computation, nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import uuid
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from roadtrace.operators.network import synthetic_network  # noqa: E402
from roadtrace.plans.catalog import REGISTRY  # noqa: E402
from roadtrace.plans.pipeline import TEST_CUT_MINUTES, Pipeline  # noqa: E402
from roadtrace.session import build_session, checkpoint_dir  # noqa: E402

# The notebook's workloads (conflicts, multi-nationality, per-day counts,
# plate trace) plus the main analysis, clustering included.  The stages they
# read are timed apart.
HEADLINE = {
    "q_ingest": ["ingest_sightings"],
    "q_conflicts": ["spatial_conflicts", "top_conflicts", "conflicts_by_month"],
    "q_multinat": ["multinat_plates", "top_multinat", "multinat_by_num", "multinat_by_set",
                   "fixable_count"],
    "q_plate_day_counts": ["plate_day_counts"],
    "q_plate_trace": ["plate_trace"],
    "q_sessionize": ["sessionize_as_coded"],
    "q_arc_frequency": ["arc_frequency"],
    "q_trip_stats": ["trip_stats"],
    "q_plate_features": ["plate_features"],
    "q_window_analysis": ["window_analysis"],
    "q_kmeans_sweep": ["kmeans_wcss"],
    "q_kmeans_anomalies": ["anomalies"],
    "q_gmm_anomalies": ["gmm_anomalies"],
}

STAGES = ["raw", "conflicts", "multinat", "fixed", "windowed", "plate_features", "vectorized"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", app="roadtrace-bench",
                          shuffle_partitions=int(cpus),
                          extra={"spark.driver.memory": "8g"})
    times: dict[str, float] = {}

    # JVM warm-up (class loading, JIT, Parquet writer) on throw-away data, not timed
    spark.range(10_000).selectExpr("id % 7 AS k").groupBy("k").count().collect()
    spark.range(10).write.parquet(f"{checkpoint_dir(spark).rstrip('/')}/bench-warmup-{uuid.uuid4().hex}")

    # warm-up of the Parquet reader (not timed; builds no stage)
    spark.read.parquet(f"{sf_dir}/events.parquet").write.format("noop").mode("overwrite").save()

    def timed(name, f) -> None:
        t = time.perf_counter()
        f()
        times[name] = round(time.perf_counter() - t, 3)

    timed("network_closure", lambda: synthetic_network(spark))  # dimension set-up (closure rounds)

    # the stages, each written once; every query below reads them
    pipe = Pipeline(spark, sf_dir, cut_minutes=TEST_CUT_MINUTES, materialize_stages=True)
    for stage in STAGES:
        timed(f"stage_{stage}", lambda: getattr(pipe, stage))

    for name, keys in HEADLINE.items():
        timed(name, lambda: [REGISTRY[k].build(spark, sf_dir).write.format("noop").mode("overwrite").save() for k in keys])

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
