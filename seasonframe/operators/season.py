"""Crop seasons from development stages, and the alignment of any series to them.

A development stage (DVS) runs from 0 at sowing over 100 at flowering to 200 at ripeness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dekad_of, parse_date, steady_round, with_year_dekad, year_of
from .clean import water_balance

YEAR_KEYS = ["IDREGION", "FYEAR"]
SEASON_COLUMNS = ["PREV_SEASON_END", "SEASON_END"]
BOUND_COLUMNS = ["FIRST_YEAR", "LAST_YEAR"]
CAMPAIGN_KEYS = ["IDREGION", "CAMPAIGN_YEAR", "CAMPAIGN_DEKAD"]
RIPE = 200


def season_end(growth: DataFrame, crosses: bool = False) -> DataFrame:
    """First dekad of each region and year in which the growing season is over.

    Over means: ripe and no longer developing; or reset to zero (after being ripe, or at all
    when the season crosses the year boundary); or the last dekad of the year. Region-years
    that never get there have no row.

    Rows are first collapsed to one per observation date (to one per dekad when there is no
    date), keeping just what the rule needs, so the ordered window sees at most one row per day
    of the year however many rows a region holds. Within a date rows count as ordered by DVS.
    """
    dated = "DATE" in growth.columns
    raw = dated and "FYEAR" not in growth.columns
    dvs = F.col("DVS").cast("double")
    observed = growth.select(
        "IDREGION",
        (year_of("DATE") if raw else F.col("FYEAR").cast("int")).alias("FYEAR"),
        (dekad_of("DATE") if raw else F.col("DEKAD").cast("int")).alias("DEKAD"),
        (parse_date("DATE") if dated else F.lit(None).cast("date")).alias("OBSERVED"),
        dvs.alias("DVS"),
    )
    when_keys = [*YEAR_KEYS, "DEKAD", "OBSERVED"]
    # after the first reduction one shuffle by region-year serves both aggregates and the window
    steps = (
        observed.groupBy(*when_keys, "DVS").agg(F.count(F.lit(1)).alias("N"))
        .repartition(*YEAR_KEYS)
        .groupBy(*when_keys)
        .agg(
            F.min("DVS").alias("LOW"),
            F.max("DVS").alias("HIGH"),
            F.bool_or((F.col("DVS") >= RIPE) & (F.col("N") > 1)).alias("RIPE_TWICE"),
            F.bool_or(F.col("DVS") == 0).alias("ANY_ZERO"),
        )
    )
    before = F.lag("HIGH").over(Window.partitionBy(*YEAR_KEYS).orderBy("DEKAD", "OBSERVED"))
    flat = (F.col("LOW") >= RIPE) & (F.col("BEFORE").isNull() | (F.col("LOW") == F.col("BEFORE")))
    reset = F.col("ANY_ZERO") if crosses else (F.col("BEFORE") >= RIPE) & (F.col("LOW") == 0)
    over = flat | F.col("RIPE_TWICE") | reset | (F.col("DEKAD") == 36)
    return (
        steps.withColumn("BEFORE", before).filter(over)
        .groupBy(*YEAR_KEYS).agg(F.min("DEKAD").alias("SEASON_END_DEKAD"))
    )


def season_bounds(ends: DataFrame, global_bounds: bool = False) -> DataFrame:
    """(IDREGION, FYEAR, PREV_SEASON_END, SEASON_END, FIRST_YEAR, LAST_YEAR).

    SEASON_END is the later of this and the next year's end. A region's first year has no
    previous season (0) and its last year no next one. With `global_bounds` first and last are
    those of the whole table, so a region that starts later or stops earlier gets null bounds.
    """
    region = Window.partitionBy("IDREGION")
    by_year = region.orderBy("FYEAR")
    own, following = F.col("SEASON_END_DEKAD"), F.lead("SEASON_END_DEKAD").over(by_year)
    if global_bounds:
        first, last = (ends.agg(f("FYEAR")).scalar() for f in (F.min, F.max))
        following = F.when(F.col("FYEAR") == last, own).otherwise(following)
        end = F.when(own > F.col("NEXT_END"), own).otherwise(F.col("NEXT_END"))
        previous = F.when(F.col("FYEAR") == first, 0).otherwise(F.lag("SEASON_END").over(by_year))
    else:
        first, last = (f("FYEAR").over(region) for f in (F.min, F.max))
        end = F.greatest(own, F.col("NEXT_END"))
        previous = F.coalesce(F.lag("SEASON_END").over(by_year), F.lit(0))
    return (
        ends.withColumns({"NEXT_END": following, "FIRST_YEAR": first, "LAST_YEAR": last})
        .withColumn("SEASON_END", end.cast("int"))
        .withColumn("PREV_SEASON_END", previous.cast("int"))
        .select(*YEAR_KEYS, *SEASON_COLUMNS, *BOUND_COLUMNS)
    )


def crop_season(growth: DataFrame, crosses: bool = False,
                global_bounds: bool = False) -> DataFrame:
    return season_bounds(season_end(growth, crosses), global_bounds)


def _with_year_bounds(season: DataFrame, global_bounds: bool) -> DataFrame:
    """First and last year for season tables that come without them."""
    if all(c in season.columns for c in BOUND_COLUMNS):
        return season
    if global_bounds:
        first, last = (season.agg(f(F.col("FYEAR").cast("int"))).scalar() for f in (F.min, F.max))
    else:
        region = Window.partitionBy("IDREGION")
        first, last = (f(F.col("FYEAR").cast("int")).over(region) for f in (F.min, F.max))
    return season.withColumns({"FIRST_YEAR": first, "LAST_YEAR": last})


def align_to_season(df: DataFrame, season: DataFrame, crosses: bool = False,
                    global_bounds: bool = False, keep_season: bool = False) -> DataFrame:
    """Add CAMPAIGN_YEAR and CAMPAIGN_DEKAD, counting dekads so that a season ends in 36.

    Dekads after the season's end move to the next campaign. Rows of the first year are dropped
    when the season crosses the year boundary, as are rows beyond the last campaign.

    The season table has one row per region-year and grows with the data, so the join carries
    no broadcast hint: adaptive execution picks one from the measured size, or splits skew.
    """
    season = _with_year_bounds(season, global_bounds).withColumn(
        "FYEAR", F.col("FYEAR").cast("int"))
    first, last = F.col("FIRST_YEAR"), F.col("LAST_YEAR")
    values = [c for c in df.columns if c not in (*YEAR_KEYS, "DEKAD")]
    moved = F.col("DEKAD") > F.col("SEASON_END")
    campaign_dekad = (
        F.when(F.col("CAMPAIGN_YEAR") == first, F.col("DEKAD") + 36 - F.col("SEASON_END"))
        .when(moved, F.col("DEKAD") - F.col("SEASON_END"))
        .otherwise(F.col("DEKAD") + 36 - F.col("PREV_SEASON_END"))
    )
    inside = F.col("CAMPAIGN_YEAR") <= last
    if crosses:
        inside = inside & (F.col("CAMPAIGN_YEAR") > first)
    return (
        df.withColumn("FYEAR", F.col("FYEAR").cast("int"))
        .join(season, YEAR_KEYS)
        .withColumn("CAMPAIGN_YEAR", F.when(moved, F.col("FYEAR") + 1).otherwise(F.col("FYEAR")))
        .filter(inside)
        .withColumn("CAMPAIGN_DEKAD", campaign_dekad.cast("int"))
        .select(*YEAR_KEYS, "DEKAD", "CAMPAIGN_YEAR", "CAMPAIGN_DEKAD", *values,
                *(SEASON_COLUMNS if keep_season else []))
    )


def zero_after_season(df: DataFrame) -> DataFrame:
    """Set every indicator to 0 from the season's end on; needs SEASON_END on the rows."""
    keep = {*YEAR_KEYS, "DEKAD", "CAMPAIGN_YEAR", "CAMPAIGN_DEKAD", *SEASON_COLUMNS}
    growing = F.col("DEKAD") < F.col("SEASON_END")
    return df.withColumns({
        c: F.when(growing, F.col(c)).otherwise(0) for c in df.columns if c not in keep
    })


def prepare_growth(df: DataFrame, season: DataFrame, crosses: bool = False,
                   global_bounds: bool = False) -> DataFrame:
    """Season-aligned growth indicators, zero from the season's end on."""
    aligned = align_to_season(with_year_dekad(df), season, crosses, global_bounds, True)
    return zero_after_season(aligned).drop(*SEASON_COLUMNS)


def prepare_weather(df: DataFrame, season: DataFrame, crosses: bool = False,
                    global_bounds: bool = False) -> DataFrame:
    """Season-aligned weather with the climate water balance CWB."""
    weather = with_year_dekad(water_balance(df.drop("IDCOVER")))
    return align_to_season(weather, season, crosses, global_bounds)


def prepare_remote_sensing(df: DataFrame, season: DataFrame, crosses: bool = False,
                           global_bounds: bool = False) -> DataFrame:
    """Season-aligned remote sensing; regions must be those of the season table."""
    return align_to_season(with_year_dekad(df.drop("IDCOVER")), season, crosses, global_bounds)


def daily_to_dekadal(df: DataFrame, keys=CAMPAIGN_KEYS) -> DataFrame:
    """Dekadal weather from daily rows: extremes of temperature, means, and sums of water."""
    by = [k for k in ("IDREGION", "FYEAR", "DEKAD") if k not in keys]
    aggregates = {
        "TMAX": F.max("TMAX"),
        "TMIN": F.min("TMIN"),
        "TAVG": steady_round(F.avg("TAVG"), 2),
        "PREC": steady_round(F.sum("PREC"), 2),
        "ET0": steady_round(F.sum("ET0"), 2),
        "RAD": steady_round(F.avg("RAD"), 2),
        "CWB": steady_round(F.sum("CWB"), 2),
    }
    columns = ["IDREGION", "FYEAR", "DEKAD", *[k for k in keys if k not in (*YEAR_KEYS, "DEKAD")]]
    return df.groupBy(*keys, *by).agg(*[e.alias(n) for n, e in aggregates.items()]).select(
        *columns, *aggregates)
