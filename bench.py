"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Stored layers (clean trips, panel, arms) are built first and timed on their own
lines, because metrics and readouts are defined over stored layers. Every query is
run to completion once to warm the session and once for the clock.
"""

from __future__ import annotations

import json
import os
import time

from tripledger.session import build_session
from verification import queries as Q

HEADLINE = (
    "clean_trips", "quality_report", "fact_cube", "heat_week_hour", "cube_grouping_sets",
    "period_summary", "period_summary_approx", "daily_summary", "duration_hist",
    "station_profile", "od_flows", "kpi", "kpi_cards_period_rider", "narrative_numbers",
    "describe_by", "row_numbers", "welch_t", "mann_whitney", "bootstrap_diff", "chi2_hours",
    "stratified_diff", "pool_panel", "power_table", "aa_calibration", "randomisation_gap",
    "block_randomise", "readout", "bootstrap_ratio", "did", "rate_guardrail", "decision_table",
    "landing_audit", "landed_clean", "bootstrap_did", "guardrails", "launch_decision",
)


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", **{
        "spark.master": f"local[{cpus}]", "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")

    def finish(name: str) -> None:
        Q.REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    finish("clean_trips")
    seconds = {
        "store_clean_trips": timed(lambda: Q.stored_orders(spark, sf_dir)),
        "store_panel_and_arms": timed(lambda: Q.event_arms(spark, sf_dir)),
    }
    for name in HEADLINE:
        finish(name)
        seconds[name] = timed(lambda: finish(name))
    print(json.dumps({
        "metric": "total seconds of the headline queries", "unit": "sec",
        "value": round(sum(seconds.values()), 3), "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
