"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the threads.
Results go to the no-op sink, so every row is computed and none is collected. Each query runs
BENCH_RUNS times (default 2) and the best time counts, so the first run serves as warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from candlework.operators.features import base_table  # noqa: E402
from candlework.plans.queries import queries  # noqa: E402
from candlework.session import local_session  # noqa: E402
from candlework.sources.tables import line_bars  # noqa: E402

HEADLINE = [
    "base_table_batch",
    "base_table_stream",
    "base_table_join",
    "base_table_segmented",
    "sma_crossover",
    "bollinger",
    "cci",
    "stochastic",
    "rsi",
    "mfi",
    "chaikin",
    "williams_r",
    "wma10",
    "code_frequencies",
    "response_variable",
    "optimal_return",
    "sweep_pivot",
    "confusion_stats",
    "exact_split",
]


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), name="bench")
    registered = queries()
    times: dict[str, float] = {}
    for name in HEADLINE:
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            noop(registered[name](spark, sf_dir))
            took.append(time.perf_counter() - start)
        times[name] = round(min(took), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    bars = line_bars(spark, sf_dir)
    plan = base_table(bars, hot=None)._jdf.queryExecution().executedPlan().toString()
    rows = bars.count()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "rows": rows,
                "base_table_rows_per_sec": round(rows / times["base_table_batch"]),
                "base_table_exchanges": plan.count("Exchange hashpartitioning"),
                "one_pass_speedup_over_joins": round(times["base_table_join"] / times["base_table_batch"], 2),
            }
        )
    )


if __name__ == "__main__":
    main()
