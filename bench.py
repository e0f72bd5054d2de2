"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from daygauge.plans import QUERIES  # noqa: E402
from daygauge.session import build_session  # noqa: E402

HEADLINES = [
    "hourly_to_daily", "daily_table_by_site", "full_feature_table", "lag_correlation_table", "correlation_matrix", "cross_region_ccf",
    "spearman_by_site", "ols_by_site", "coefficient_table", "newey_west", "seasonal_sensitivity", "holdout_validation", "site_metrics",
    "multi_site_run", "opportunity_gap_flags", "lost_population", "crowding_bins", "complaint_rates", "quartiles_of_raw_values",
    "column_profile", "drift_between_blocks", "missing_calendar_days", "demand_by_month_and_region", "keyed_upsert", "survey_satisfaction_files", "wide_survey_file",
    "monthly_upsert_table", "stationarity_tests",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINES
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    # Start of the JVM, of the Python workers and of code generation is no part of any query.
    for name in ("ols_by_site", "column_profile"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
