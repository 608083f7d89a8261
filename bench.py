"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` gives the tables, ``BENCH_CPUS`` the number of cores. Every query runs once to warm up and then three
times; the median is reported. Results go to a sink that reads every row.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dockflow.catalog import features, ingest, models, reports  # noqa: E402
from dockflow.session import build_session  # noqa: E402

HEADLINE = {
    "grid_from_polls": features.grid_from_polls,
    "geojson_activity": ingest.geojson_activity,
    "idle_run": features.idle_run,
    "detector_calendar": features.detector_calendar,
    "lags_and_rolling": features.lags_and_rolling,
    "future_target": features.future_target,
    "station_profile": models.station_profile,
    "fleet_detectors": models.fleet_detectors,
    "anomaly_predictions": models.anomaly_predictions,
    "anomaly_episodes": reports.episodes,
    "activity_heatmap": reports.heatmap,
    "nearest_stations": features.nearest,
}


def run_once(build, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "dockflow-bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
        # the tables are small: keep all cores busy instead of merging shuffle partitions up to 1 MB
        spark__sql__adaptive__coalescePartitions__minPartitionSize="64k",
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name, build in HEADLINE.items():
        run_once(build, spark, sf_dir)
        timings[name] = round(statistics.median(run_once(build, spark, sf_dir) for _ in range(3)), 4)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(timings.values()), 4),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "poll_rows": events,
        "polls_per_sec": round(events / timings["grid_from_polls"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
