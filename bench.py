"""Times the headline queries over the tables in BENCH_SF_DIR on local[BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from driftmerge import catalogue

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "merge_cls_rows_lineitem", "merge_cls_cells_lineitem", "merge_cls_events", "merge_order_insensitive", "merge_winner_db_version", "merge_rejected_changes", "merge_gos_conversations",
    "capture_insert_clocks", "capture_update_clocks", "capture_delete_tombstones", "capture_key_move", "backfill_except", "feed_all", "feed_since_cursor", "pk_encode_composite", "pk_roundtrip",
    "payload_roundtrip_lz4", "payload_roundtrip_raw", "alter_add_column", "compact_vanished_rows", "policy_gate_atomic", "value_order_cross_type", "stream_merge_availablenow",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in sys.argv[1:] if n in catalogue.QUERIES] or HEADLINE
    took = {}
    for name in names:
        runs = []
        for _ in range(2):  # the first one compiles
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "total seconds of the headline queries, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "median": round(statistics.median(took.values()), 3), "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
