"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the data folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wiregrain.plans.queries import QUERIES  # noqa: E402
from wiregrain.session import build_session  # noqa: E402

HEADLINE = [
    "inter_arrival_rolling",
    "size_rolling",
    "packet_entropy",
    "header_decode_modbus",
    "flow_counts",
    "all_features",
    "summary_stats",
    "group_fingerprint",
    "frequency_distributions",
    "rule_flags",
    "anomaly_report",
    "timing_outliers_p99",
    "label_join",
    "fc_usage_grouping_sets",
    "temporal_pattern",
    "flow_metrics",
    "request_response",
    "sliding_60s",
    "sessions",
    "roc_points",
    "count_windows",
    "capture_verdicts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "wiregrain-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query starts the JVM's compiler and the executors.
    QUERIES[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        # Every row and column is computed; nothing is sent to the driver.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    packets = spark.read.parquet(f"{folder}/events.parquet").count()
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "feature_rows_per_sec": round(packets / times["all_features"]),
                "fingerprint_rows_per_sec": round(lines / times["group_fingerprint"]),
            }
        )
    )


if __name__ == "__main__":
    main()
