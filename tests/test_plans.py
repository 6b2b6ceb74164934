"""Shapes of physical plans: what must not appear in them at any scale."""

from pathlib import Path

import pytest
from fixtures import daily_weather, growth, yields

import __spark_entry__ as entry
from seasonframe.operators import features, metrics, season, splits, trend
from seasonframe.plans.queries import Tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")
@pytest.mark.parametrize("name", [
    "date_parts", "crop_filter", "parent_to_children", "season_bounds", "season_ends_crossing",
    "clean_yield_wide", "optimal_window", "leave_one_out", "sliding_folds", "trend_rounds",
    "median_order_value", "source_levels",
])
def test_no_cross_joins_or_python_in_relational_queries(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "NestedLoop", "EvalPython", "MapInPandas"):
        assert bad not in text


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")
def test_scan_reads_needed_columns_and_filters_early(spark):
    text = Tables(spark, SF).crop_growth.select("IDREGION", "DATE", "DVS")
    scan = next(line for line in plan(text).splitlines()
                if "FileScan" in line and "l_suppkey" in line)
    assert "l_extendedprice" not in scan and "l_discount" not in scan
    assert "l_linenumber" in plan(text).split("FileScan")[0]  # the crop filter sits on the scan


def test_season_needs_two_shuffles_after_the_reduction(spark):
    text = plan(season.season_bounds(season.season_end(growth(spark).drop("CROP_ID"))))
    # by value, by region-year, by region
    assert text.count("Exchange hashpartitioning") == 3


def test_all_trend_windows_share_one_shuffle(spark):
    text = plan(trend.optimal_window_trend(yields(spark), [5, 7, 10]))
    assert text.count("Exchange") == 1


def test_medians_and_splits_avoid_joins_with_one_row(spark):
    for df in (metrics.exact_median(yields(spark), "YIELD"),
               splits.with_split(yields(spark), yields(spark))):
        assert "NestedLoop" not in plan(df)


def test_unhinted_season_join_follows_measured_sizes(spark):
    aligned = season.prepare_weather(daily_weather(spark), season.crop_season(
        growth(spark).drop("CROP_ID")))
    assert "ResolvedHint" not in aligned._jdf.queryExecution().analyzed().toString()


def test_features_are_one_aggregate(spark):
    calendar = spark.createDataFrame(
        [("AT21", 2003, 10, 20, 30, 36)],
        "IDREGION string, CAMPAIGN_YEAR int, START_DVS int, START_DVS1 int, START_DVS2 int, "
        "CAMPAIGN_EARLY_SEASON int")
    aligned = season.prepare_weather(daily_weather(spark), season.crop_season(
        growth(spark).drop("CROP_ID")))
    spec = features.FeatureSpec(averages={"p1": ["TAVG"], "p2": ["PREC"]})
    text = plan(features.period_aggregates(aligned, calendar, spec))
    assert text.count("keys=[IDREGION") >= 1
    assert "Exchange hashpartitioning(IDREGION" in text and "NestedLoop" not in text
