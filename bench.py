"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. Every query runs once unmeasured, then BENCH_RUNS times (default
1); the median counts. Results are fully computed and thrown away.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from siegeboard.catalog import QUERIES
from siegeboard.session import build_session

HEADLINE = [
    "difficulty_plain",
    "difficulty_extended",
    "pve_rating",
    "top5_score",
    "player_stats",
    "losers_sum",
    "derived_matches",
    "recent_games",
    "setup_text",
    "avg_ranks",
    "row_index",
    "backup_repair",
    "update_join",
    "new_rows_anti",
    "null_profile",
    "latest_names",
    "knn_l2_exact",
    "corr_features",
    "ingest_incremental",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - started

    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "master": f"local[{cpus}]",
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
