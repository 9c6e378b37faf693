"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tidemark import plans
from tidemark.session import session

#: One query of each family: scan and aggregate, windows, as-of joins, rollups, consensus, valuation, evaluation, resampling,
#: grouped solvers, simulation, identity, documents, micro-batches.
HEADLINE = (
    "lagged_ewm_baseline_mae", "context_aggregates", "pooled_group_mean_fallback", "role_change_ffill", "lag_shift_feature_join", "asof_inclusive", "forward_asof_first_outcome",
    "vacated_share_rollup", "home_away_unpivot", "opponent_group_pivot", "linear_scoring_fold", "trimmed_mean_consensus", "replacement_level_vor", "gap_tiers_raw", "multiplier_product_cap",
    "weekly_spearman", "startsit_pair_accuracy", "cluster_bootstrap_ci", "icc_within_entity", "bias_replay_forward", "ridge_strength_adjustment", "optimal_lineup", "rest_of_season_totals",
    "html_table_extract", "session_event_counts", "upsert_by_period",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = plans.queries(), {}
    spark.read.parquet(f"{folder}/orders.parquet").count()  # compile and open files once
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
