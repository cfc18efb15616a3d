"""Time the headline queries, each from cold caches, writing nowhere. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from barlake.plans.catalog import REGISTRY
from barlake.session import local_session

HEADLINE = [
    "bars_day",
    "bars_week",
    "sma",
    "rsi",
    "macd",
    "average_directional_index",
    "filled_indicators",
    "latest_indicator_signals",
    "timeframe_blend",
    "combined_votes",
    "period_returns",
    "sector_correlations_all_present",
    "max_sharpe_portfolio",
    "trained_models",
    "walk_forward_folds",
    "strategy_risk",
    "alert_first_triggers",
    "prediction_scorecard",
    "accuracy_trend",
    "position_book",
    "cash_account",
    "article_sentiment",
    "news_sentiment",
    "fundamental_scores",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, cpus, "barlake-bench")
    REGISTRY["bars_month"].build(spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        spark.catalog.clearCache()
        start = time.perf_counter()
        REGISTRY[name].build(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
