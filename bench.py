"""Times the headline queries: one warm run and the median of two more, each written to the noop sink.

``build_tables`` is the time to derive and write the tables that most of the queries read (battles without repeats,
state, players, matchups, cells), once, with a cold start, ``build_search_index`` that for the postings of the search; ``build_cells`` derives the cells from the line items each time.

Folder and cores come from BENCH_SF_DIR and BENCH_CPUS; prints one line of JSON.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from matchstats.plans.queries import QUERIES
from matchstats.plans.store import Store

HEADLINE = ["winrate_levels", "popularity_levels", "build_cells", "rank_distribution", "top_winrates", "winrate_changes_all", "upsert_character_stats", "player_matchups", "best_worst_matchups", "player_search", "page_coverage", "player_profile"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    began = time.perf_counter()
    store = Store.of(spark, sf_dir)
    store.matchups, store.players, store.cells  # noqa: B018  each built when first asked for
    seconds = {"build_tables": round(time.perf_counter() - began, 3)}
    began = time.perf_counter()
    Store.of(spark, sf_dir).search  # noqa: B018  built when first asked for
    seconds["build_search_index"] = round(time.perf_counter() - began, 3)
    for name in HEADLINE:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(2)), 3)
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
