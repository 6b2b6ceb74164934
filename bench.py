"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
`naive` holds two deliberately simple versions of operators for comparison: the calendar from five
joined aggregates, and the yield trend fitted row by row on the driver.
"""

from __future__ import annotations

import json
import os
import time

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seasonframe.plans.queries import QUERIES, WINDOWS, Tables

HEADLINE = [
    "date_parts", "weather_dekadal", "season_bounds", "growth_prepared", "calendar_summary",
    "weather_summary", "weather_features", "split_growth_features", "fixed_window_trend",
    "optimal_window", "contiguous_folds", "prediction_scores", "median_order_value",
    "national_scores", "ridge_predictions", "knn_test_predictions", "season_features",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def naive_calendar(t: Tables):
    growth, keys = t.growth_ready, ["IDREGION", "CAMPAIGN_YEAR"]
    out = growth.select(*keys).distinct()
    for name, condition, value in (
        ("START_DVS", "DVS > 0", F.min("CAMPAIGN_DEKAD")),
        ("START_DVS1", "DVS >= 100", F.min("CAMPAIGN_DEKAD")),
        ("START_DVS2", "DVS >= 200", F.min("CAMPAIGN_DEKAD")),
        ("HARVEST", "DVS >= 200", F.min("DEKAD")),
        ("ALIGN", "DVS >= 200", F.max(F.expr("CAMPAIGN_DEKAD - DEKAD"))),
    ):
        out = out.join(growth.filter(condition).groupBy(*keys).agg(value.alias(name)), keys)
    run(out)


def naive_trend(t: Tables):
    history = {}
    for r in t.yields.orderBy("IDREGION", "FYEAR").collect():
        history.setdefault(r["IDREGION"], []).append((r["FYEAR"], r["YIELD"]))
    for points in history.values():
        for i in range(min(WINDOWS), len(points)):
            for w in (w for w in WINDOWS if w <= i):
                x, y = np.array(points[i - w:i]).T
                for j in range(w):
                    np.polyfit(np.delete(x, j), np.delete(y, j), 1)


def timed(job) -> float:
    start = time.perf_counter()
    job()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["growth_prepared"](spark, sf_dir))  # warm the JVM, not counted
    seconds = {q: timed(lambda q=q: run(QUERIES[q](spark, sf_dir))) for q in HEADLINE}
    kept = ("crop_growth", "yields")
    naive = {
        "calendar_summary": timed(lambda: naive_calendar(Tables(spark, sf_dir, kept))),
        "optimal_window": timed(lambda: naive_trend(Tables(spark, sf_dir))),
    }
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "naive": naive,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
