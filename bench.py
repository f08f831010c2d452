"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: median seconds of three runs each; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemark import plans
from tidemark.session import local_session

HEADLINE = (
    "fact_entity_monthly", "period_completeness", "market_concentration", "fund_performance_ranking", "screen_dormant_trend",
    "activity_grouping_sets", "lending_participant_daily", "short_interest_daily", "close_total_return", "panel_wide",
    "asof_join", "name_resolve", "shared_exposure", "portfolio_credit_returns",
    "company_financials", "balance_sheets", "flat_forward", "restatement_diff", "holdings_monthly", "research_universe",
    "business_days", "implied_rate", "body_differences", "ticker_lineages", "known_values", "fact_by_period",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()  # warm-up
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.time()
            plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
