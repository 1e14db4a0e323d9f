"""Seconds per headline query: ``BENCH_SF_DIR`` on ``local[BENCH_CPUS]``, one JSON line.

Each query runs once to warm up and then three times; the median counts. The
whole result is computed and thrown away. Queries that start streams run once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marketlake import session  # noqa: E402
from marketlake.plans import registry  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

WARM = [
    "listings_latest", "parse_listings", "price_summary", "hq_premium", "price_bounds",
    "arbitrage", "velocity", "price_history", "price_history_fine", "top_arbitrage",
    "price_lookup", "top_velocity", "page_price_metrics", "center_prices", "snapshot_items",
    "live_quotes", "item_details", "page_headlines", "usage_rates", "usage_active", "dq_report",
]
ONCE = ["stream_ingest", "stream_rates", "pipeline_run"]


def seconds(spark, name: str) -> float:
    start = time.perf_counter()
    registry.run(name, spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    names = sys.argv[1:] or WARM + ONCE
    spark = session.build(
        "bench",
        master=f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        runs = 1 if name in ONCE else 4
        taken = [seconds(spark, name) for _ in range(runs)]
        times[name] = round(statistics.median(taken[1:] or taken), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
