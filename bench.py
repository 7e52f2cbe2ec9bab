"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The panel, schedule and prediction tables are written once per session and
scanned afterwards. Their build is timed as its own entry (``stored_tables``);
the other entries are the time to run the whole query into a no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from rankpanel.catalog import QUERIES
from rankpanel.catalog.base import predictions
from rankpanel.session import build_session
from rankpanel.sources.tables import schedule

HEADLINE = (
    "results_table",
    "a3_keyed_upsert",
    "a5_batch_checksum",
    "b21_as_of_roster",
    "c1_driver_rolling_means",
    "c2_team_rolling_means",
    "c3_driver_ewm",
    "c4_team_ewm",
    "c6_circuit_attributes",
    "c13_driver_cluster_form",
    "c15_gap_to_pole",
    "c18_percent_rank_adjustment",
    "c20_driver_season_points",
    "c21_whole_plan",
    "c22_preparation",
    "d4_purged_folds",
    "d6_event_zscore",
    "d16_mae_weights",
    "d17_spearman_weights",
    "e2_mode_auto",
    "e8_baseline_race",
    "f5_outcome_summary",
    "f6_position_matrix",
    "g5_spearman",
    "g6_event_errors",
    "g8_top_k_metrics",
    "g10_reliability_curve",
    "g12_compare_predictions",
    "h1_best_laps",
    "s2_idempotent_ingest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = tuple(x for x in os.environ.get("BENCH_ONLY", "").split(",") if x)
    spark = build_session("bench", cpus, partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    start = time.perf_counter()
    schedule(spark, sf_dir)
    predictions(spark, sf_dir)
    times["stored_tables"] = round(time.perf_counter() - start, 3)
    for name in only or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
