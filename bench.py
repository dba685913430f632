"""Times the headline queries and prints one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
Every query is forced in full through the no-op sink; the first, unreported
run of a small query warms the JVM up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidebook.plans.catalogue import QUERIES  # noqa: E402
from tidebook.session import build_session  # noqa: E402

HEADLINE = (
    "participant_flow",
    "participant_top10",
    "participant_top3",
    "participant_scores",
    "broker_source_select",
    "foreign_source_select",
    "foreign_features",
    "broker_windows",
    "broker_features",
    "bars_daily",
    "bars_last_n",
    "price_flow_features",
    "smc_levels",
    "price_quality",
    "split_events",
    "market_context",
    "relative_strength",
    "scan_verified_broker",
    "finalists_top5",
    "finalists_merged",
    "outcomes_forward",
    "outcomes_excluded",
    "outcome_updates",
    "closed_book_violations",
    "broker_cache_sync",
    "tier_coalesce",
    "missing_days",
    "evidence_telemetry",
    "duplicate_runs",
    "json_chart",
)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        f"local[{cpus}]",
        "tidebook-bench",
        shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
        extra_conf={
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    QUERIES["bars_daily"](spark, root).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "catalogue_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
