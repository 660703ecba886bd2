"""Benchmark of the headline queries: one JSON line with seconds for each.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8). Each
query is run once to warm up and then timed over its whole result, which is written to
the ``noop`` sink so that nothing is cut short.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from quern import catalog

HEADLINE = [
    "close_friends", "bgp_join_chain", "subselect_join", "optional_lineitem", "exists_big_order", "not_exists_lineitem", "exists_theta_newer_event", "filter_exists_or_expr", "minus_labels",
    "path_plus", "agg_sum", "agg_count_distinct", "group_by_expr", "bind_arith", "graph_var", "construct_triples", "event_mode_match", "rules_running_sum", "rules_max_so_far", "window_avg_closed",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf"), "close_friends_events_per_sec": round(events / seconds["close_friends"])}))


if __name__ == "__main__":
    main()
