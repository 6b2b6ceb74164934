"""Crop calendar: when the stages are reached, and the six periods built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import country_of, steady_round

STAGES = ["START_DVS", "START_DVS1", "START_DVS2", "CAMPAIGN_EARLY_SEASON"]

# Period, description, start (stage, offset), end (stage, offset), in dekads.
PERIODS = [
    ("p0", "pre-planting window", ("START_DVS", -11), ("START_DVS", 0)),
    ("p1", "planting window", ("START_DVS", -1), ("START_DVS", 1)),
    ("p2", "vegetative phase", ("START_DVS", 0), ("START_DVS1", 0)),
    ("p3", "flowering phase", ("START_DVS1", -1), ("START_DVS1", 1)),
    ("p4", "yield formation phase", ("START_DVS1", 0), ("START_DVS2", 0)),
    ("p5", "harvest window", ("START_DVS2", -1), ("START_DVS2", 1)),
]


def calendar_summary(growth: DataFrame, early_offset: int | None = None) -> DataFrame:
    """Stage dekads per region and campaign year, from one aggregate over the growth series.

    Campaigns that miss a stage are left out. `early_offset` (negative: before harvest) moves
    the early-season end and adds CALENDAR_EARLY_SEASON.
    """
    def first_dekad(condition: Column, dekad: str = "CAMPAIGN_DEKAD") -> Column:
        return F.min(F.when(condition, F.col(dekad)))

    dvs = F.col("DVS")
    shift = F.max(F.when(dvs >= 200, F.col("CAMPAIGN_DEKAD") - F.col("DEKAD")))
    stages = growth.groupBy("IDREGION", "CAMPAIGN_YEAR").agg(
        first_dekad(dvs > 0).alias("START_DVS"),
        first_dekad(dvs >= 100).alias("START_DVS1"),
        first_dekad(dvs >= 200).alias("START_DVS2"),
        (first_dekad(dvs >= 200, "DEKAD") + 1).alias("CALENDAR_END_SEASON"),
        shift.alias("_shift"),
    ).filter(F.col("START_DVS2").isNotNull())
    end = F.col("CALENDAR_END_SEASON")
    columns = {"CAMPAIGN_EARLY_SEASON": end + F.col("_shift") + (early_offset or 0)}
    if early_offset is not None:
        columns["CALENDAR_EARLY_SEASON"] = end + early_offset
    return stages.withColumns(columns).drop("_shift")


def country_calendar(calendar: DataFrame) -> DataFrame:
    """Rounded mean stage dekads per country."""
    return calendar.groupBy(country_of("IDREGION").alias("COUNTRY")).agg(
        *[steady_round(F.avg(s), 0).alias(s) for s in STAGES])


def with_calendar(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Attach COUNTRY and the stages of its calendar to every row.

    Broadcast: one row per two-character country code, a bound independent of the data size.
    """
    return df.withColumn("COUNTRY", country_of("IDREGION")).join(
        F.broadcast(country_calendar(calendar)), "COUNTRY")


def _plus(stage: str, offset: int) -> str:
    return f"{stage} {'+' if offset >= 0 else '-'} {abs(offset)}"


def period_conditions() -> dict[str, str]:
    """SQL condition per period for rows with CAMPAIGN_DEKAD and the stage columns.

    A period is cut at the early-season end. Text, because feature specs combine them into
    dozens of aggregates and one parsed expression is far cheaper to build than nested columns.
    """
    return {
        name: f"(CAMPAIGN_DEKAD BETWEEN {_plus(*start)} "
              f"AND least({_plus(*stop)}, CAMPAIGN_EARLY_SEASON))"
        for name, _, start, stop in PERIODS
    }


def period_predicates() -> dict[str, Column]:
    """The period conditions as columns."""
    return {name: F.expr(condition) for name, condition in period_conditions().items()}


def calendar_report(calendar: DataFrame, early: bool = False) -> DataFrame:
    """Mean calendar over all regions as rows (PERIOD, DESCRIPTION, START, STOP)."""
    means = calendar.agg(*[steady_round(F.avg(s), 0).alias(s) for s in STAGES])
    cut = F.col("CAMPAIGN_EARLY_SEASON")

    def bounds(start, lead, stop, tail, first):
        lo, hi = F.col(start) + lead, F.col(stop) + tail
        return (F.greatest(lo, F.lit(1.0)) if first else lo), (F.least(hi, cut) if early else hi)

    rows = []
    for name, text, (start, lead), (stop, tail) in PERIODS:
        lo, hi = bounds(start, lead, stop, tail, name == "p0")
        rows.append(F.struct(F.lit(name).alias("PERIOD"), F.lit(text).alias("DESCRIPTION"),
                             lo.alias("START"), hi.alias("STOP")))
    return means.select(F.inline(F.array(*rows))).filter(F.col("STOP") > F.col("START"))
