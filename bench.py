"""Headline queries at one scale; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query
is collected whole, once, after one small query has started the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.registry import all_queries  # noqa: E402
from plumbline.session import build_session  # noqa: E402

HEADLINE = (
    "clean_text",
    "truncate_tokens",
    "stratified_split",
    "stratified_sample",
    "ensemble_decide",
    "eval_overall",
    "crm_action_list",
    "score_cache_hit",
    "score_cache_miss",
    "quantile_bins",
    "psi_numeric",
    "psi_categorical",
    "drift_summary",
    "volume_guardrail",
    "semantic_psi",
    "confidence_buckets",
    "latency_p95",
    "metrics_snapshot",
    "anchored_91d",
    "sliding_sentiment",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries["sentiment_counts"](spark, sf_dir).collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).toArrow()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
