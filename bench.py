"""Time the headline queries on one scale; prints one JSON line.

    BENCH_SF_DIR   tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_QUERIES  comma-separated names, or "all" (default: the headline set)
    BENCH_RUNS     timed runs per query after one warm-up, median taken (default 1)
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from annotary.plans import catalog  # noqa: E402
from annotary.session import build_session, clear_scratch  # noqa: E402

HEADLINE = [
    "group_split",
    "group_split_by_source",
    "leak_check",
    "session_merge",
    "session_groups",
    "thumbnail_link",
    "clean_polygons",
    "harmonise",
    "class_source_pivot",
    "per_image_stats",
    "per_source_stats",
    "density_hist",
    "log_hist",
    "coco_images",
    "coco_annotations",
    "seeded_half",
    "source_sample",
    "confusion",
    "evaluation_report",
    "pair_iou",
    "greedy_match",
    "mean_average_precision",
    "polygon_fill",
    "mask_merge",
    "components",
    "seed_aggregate",
    "run_grid_pending",
    "last_event",
    "via_scan",
    "stream_confusion",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    queries = catalog.load()
    names = list(queries) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        conf={
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        samples = []
        for k in range(runs + 1):
            start = time.perf_counter()
            queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - start)
            clear_scratch(spark)
        samples = samples[1:]  # the first run warms up
        times[name] = round(statistics.median(samples), 3)
        print(f"{name:28s} {times[name]:7.2f}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
