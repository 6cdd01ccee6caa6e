"""Times the headline queries, warm: median of three runs each. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH", "")]))
sys.path.insert(0, HERE)

HEADLINE = (
    "market_consensus pit_latest_prices pit_asof_join pit_asof_join_bucketed pit_decision_times team_form base_rates eval_scores eval_bootstrap eval_agreement decision_rules quality_coverage score_markets elo_history"
    " goal_strengths walk_forward merge_events ledger_chain"
).split()


def main() -> None:
    from pyspark.sql import SparkSession

    from tidemark.plans.catalogue import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs), 3)
    prices = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    line = {"metric": "headline queries, warm median of 3", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")}
    if "market_consensus" in took:
        line["prices_per_second"] = round(prices / took["market_consensus"])
    if "walk_forward" in took:
        forecasts = QUERIES["walk_forward"](spark, sf_dir).where("kind = 'raw'").groupBy().sum("n").first()[0]
        line["walk_forward_forecasts_per_second"] = round(forecasts / took["walk_forward"])
    print(json.dumps(line))


if __name__ == "__main__":
    main()
