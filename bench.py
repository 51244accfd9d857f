"""Headline queries, each timed after one untimed run; prints one line of JSON.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3: the median counts).
"""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "filter_and_null_logic", "project_strings", "project_json", "project_decimal", "agg_by_key", "agg_avg_decimal_ts", "win_tumbling", "win_hopping", "win_hop_unaligned", "join_stream_stream_inner", "join_stream_stream_left",
    "join_nullsafe_keys", "join_stream_table_inner", "union_positional", "store_table_latest", "scan_prefix_range", "get_point", "sort_multi_nulls", "topic_bridge", "stream_windowed", "stream_table_upsert",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    settings = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("freshet-bench")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from freshet import workload

    seconds = {}
    for name in HEADLINE:
        run = workload.queries()[name]
        taken = []
        for k in range(runs + 1):
            began = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if k:
                taken.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(taken), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
