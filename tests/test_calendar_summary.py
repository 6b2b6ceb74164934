import pytest
from conftest import rows
from fixtures import stages
from pyspark.sql import functions as F

from seasonframe.operators import calendars, summary

COLUMNS = ["CAMPAIGN_YEAR", "START_DVS", "START_DVS1", "START_DVS2", "CALENDAR_END_SEASON",
           "CAMPAIGN_EARLY_SEASON"]


def test_calendar(spark):
    cal = calendars.calendar_summary(stages(spark))
    assert rows(cal, *COLUMNS) == [(2003, 21, 26, 32, 21, 33), (2004, 22, 27, 34, 23, 35)]


def test_calendar_early(spark):
    cal = calendars.calendar_summary(stages(spark), early_offset=-6)
    assert rows(cal, "CAMPAIGN_EARLY_SEASON", "CALENDAR_EARLY_SEASON") == [(27, 15), (29, 17)]


def test_campaign_missing_a_stage_is_left_out(spark):
    cal = calendars.calendar_summary(stages(spark).filter("FYEAR = 2003 OR DVS < 200"))
    assert rows(cal, "CAMPAIGN_YEAR") == [(2003,)]


def test_country_calendar_rounds_half_to_even(spark):
    cal = calendars.country_calendar(calendars.calendar_summary(stages(spark)))
    assert rows(cal) == [("AT", 22.0, 26.0, 33.0, 34.0)]  # 21.5 and 26.5 before


def in_periods(spark, early):
    cal = spark.createDataFrame([(20, 26, 33, early)], "START_DVS int, START_DVS1 int, "
                                "START_DVS2 int, CAMPAIGN_EARLY_SEASON int")
    dekads = cal.selectExpr("*", "explode(sequence(1, 36)) AS CAMPAIGN_DEKAD")
    return {name: [r[0] for r in dekads.filter(inside).select("CAMPAIGN_DEKAD").collect()]
            for name, inside in calendars.period_predicates().items()}


def test_periods(spark):
    assert in_periods(spark, 36) == {
        "p0": list(range(9, 21)), "p1": [19, 20, 21], "p2": list(range(20, 27)),
        "p3": [25, 26, 27], "p4": list(range(26, 34)), "p5": [32, 33, 34]}


def test_periods_end_with_an_early_season(spark):
    assert in_periods(spark, 26) == {
        "p0": list(range(9, 21)), "p1": [19, 20, 21], "p2": list(range(20, 27)),
        "p3": [25, 26], "p4": [26], "p5": []}


def test_report(spark):
    report = calendars.calendar_report(calendars.calendar_summary(stages(spark)))
    assert rows(report, "PERIOD", "START", "STOP") == [
        ("p0", 11.0, 22.0), ("p1", 21.0, 23.0), ("p2", 22.0, 26.0), ("p3", 25.0, 27.0),
        ("p4", 26.0, 33.0), ("p5", 32.0, 34.0)]
    early = calendars.calendar_report(calendars.calendar_summary(stages(spark), -6), early=True)
    # mean early season is 28: yield formation is cut, the harvest window vanishes
    assert rows(early, "PERIOD", "START", "STOP") == [
        ("p0", 11.0, 22.0), ("p1", 21.0, 23.0), ("p2", 22.0, 26.0), ("p3", 25.0, 27.0),
        ("p4", 26.0, 28.0)]


def test_indicator_summary(spark):
    values = [4.0, 9.5, 2.0]
    df = spark.createDataFrame([("AT21", v, 2 * v) for v in values],
                               "IDREGION string, RSM double, Y double")
    out = summary.indicator_summary(df, [], ["Y"], ["RSM"])
    assert out.columns == ["IDREGION", "max(Y)", "avg(RSM)"]
    assert rows(out) == [("AT21", 19.0, 5.17)]
    assert rows(summary.indicator_summary(df, [], [], [])) == [("AT21",)]


def test_yield_summary(spark):
    df = spark.createDataFrame(
        [("SI01", 36.25), ("SI01", 31.5), ("SI04", 22.6), ("SI04", 18.0)],
        "IDREGION string, YIELD double")
    (a, lo, hi, mean), second = rows(summary.yield_summary(df))
    assert (a, lo, hi) == ("SI01", 31.5, 36.25) and mean == pytest.approx(33.875, abs=0.01)
    assert second == ("SI04", 18.0, 22.6, 20.3)


def test_year_range_and_keys(spark):
    assert summary.year_range(stages(spark)).first() == (2003, 2004)
    assert rows(summary.distinct_keys(stages(spark), "IDREGION", "FYEAR")) == [
        ("AT21", 2003), ("AT21", 2004)]
    assert stages(spark).filter(F.col("DVS") < 0).count() == 0
