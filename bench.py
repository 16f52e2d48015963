"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR  folder of the driver tables (default /root/testdata/sf0.1)
BENCH_CPUS    local executor threads (default 8)
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from sitewatch.plans.catalog import CATALOG

HEADLINE = (
    "dq_nulls", "dq_casefold", "dq_dup_rows", "dq_dup_keys", "val_percentiles", "out_iqr_counts",
    "out_histograms", "stg_clean", "feat_severity", "ent_summary", "risk_prelim_dist",
    "risk_backjoin", "biz_overview", "biz_operator", "biz_operator_spread", "biz_state_outages",
    "biz_cause_recurring", "biz_daily", "ml_history", "ml_split_stats", "ml_auc", "score_category",
    "wl_full_history", "wl_priority", "dash_obs_cube", "dash_crosstab", "ml_logreg", "ml_forest",
    "ml_gbt",
)


def run(df: DataFrame) -> None:
    """Compute every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Longer methods are not compiled by the JVM; run them in smaller pieces.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    for name in ("biz_overview", "dq_nulls", "ent_summary", "ml_history"):  # warm-up
        run(CATALOG[name](spark, folder))
    seconds = {}
    for name in names:
        start = time.perf_counter()
        run(CATALOG[name](spark, folder))
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
