"""Area-weighted roll-up of regional predictions, and the national comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parent_region, parse_date, steady_round
from .metrics import DEFAULT_METRICS, scores

KEYS = ["IDREGION", "FYEAR"]
FORECAST_ALG = "MCYFS_Predictions"


def predictions_to_rows(wide: DataFrame, algorithms: Sequence[str],
                        ids: Sequence[str] = KEYS) -> DataFrame:
    """`YIELD_PRED_<alg>` columns as rows (ids..., ALG, YIELD_PRED)."""
    named = wide.select(*ids, *[F.col(f"YIELD_PRED_{a}").alias(a) for a in algorithms])
    return named.unpivot(list(ids), list(algorithms), "ALG", "YIELD_PRED")


def predictions_to_columns(rows: DataFrame, algorithms: Sequence[str],
                           ids: Sequence[str] = KEYS) -> DataFrame:
    """One `YIELD_PRED_<alg>` column per algorithm."""
    wide = rows.groupBy(*ids).pivot("ALG", list(algorithms)).agg(F.first("YIELD_PRED"))
    return wide.withColumnsRenamed({a: f"YIELD_PRED_{a}" for a in algorithms})


def _by(df: DataFrame, *keys: str) -> list[str]:
    """The keys, plus ALG when predictions of several algorithms are stacked."""
    return [*(["ALG"] if "ALG" in df.columns else []), *keys]


def fill_missing(df: DataFrame) -> DataFrame:
    """A missing prediction becomes the region's mean over the years; a region without any
    prediction gets prediction and area 0. Groups are one row per year of a region."""
    mean = F.avg("YIELD_PRED").over(Window.partitionBy(*_by(df, "IDREGION")))
    filled = df.withColumn("_mean", mean)
    return filled.withColumns({
        "FRACTION": F.when(F.col("_mean").isNull(), 0.0).otherwise(F.col("FRACTION")),
        "YIELD_PRED": F.coalesce("YIELD_PRED", "_mean", F.lit(0.0)),
    }).drop("_mean")


def renormalise(df: DataFrame) -> DataFrame:
    """Area fractions rescaled to sum to 1 within parent region and year; needs IDREG_PARENT."""
    siblings = Window.partitionBy(*_by(df, "IDREG_PARENT", "FYEAR"))
    return df.withColumn("FRACTION", F.try_divide("FRACTION", F.sum("FRACTION").over(siblings)))


def weighted_rollup(predictions: DataFrame, areas: Sequence[DataFrame]) -> DataFrame:
    """Roll predictions (IDREGION, FYEAR[, ALG], YIELD_PRED) up one level per area table.

    `areas` go from the finest level upwards. Renormalising and summing collapse into one
    partial aggregate per level; all algorithms travel together under ALG.
    """
    level = predictions
    for area in areas:
        joined = fill_missing(area.select(*KEYS, "FRACTION").join(level, KEYS))
        keys = _by(joined, "IDREGION", "FYEAR")
        level = (
            joined.withColumn("IDREGION", parent_region("IDREGION"))
            .groupBy(*keys)
            .agg(F.coalesce(
                F.try_divide(F.sum(F.col("YIELD_PRED") * F.col("FRACTION")), F.sum("FRACTION")),
                F.lit(0.0)).alias("YIELD_PRED"))
        )
    return level


def season_mean_by_year(calendar: DataFrame, by: Sequence[str] = ("FYEAR",)) -> DataFrame:
    """Mean end of season (and early season, if present) per year, in whole dekads."""
    wanted = {"CALENDAR_END_SEASON": "END_SEASON", "CALENDAR_EARLY_SEASON": "EARLY_SEASON"}
    return calendar.withColumnRenamed("CAMPAIGN_YEAR", "FYEAR").groupBy(*by).agg(*[
        steady_round(F.avg(c), 0).alias(n) for c, n in wanted.items() if c in calendar.columns])


def asof_forecast(targets: DataFrame, forecasts: DataFrame,
                  keys: Sequence[str] = ("FYEAR",)) -> DataFrame:
    """Forecast issued at or next after each target's TARGET_DEKAD, else the latest one.

    Within a dekad the earliest date wins, then the smaller value; forecasts without a dekad count
    as none. Targets without forecasts drop, those with a null key too; a null TARGET_DEKAD takes
    the first forecast. Repeated targets count once.

    Forecasts shrink to one per key and dekad before they are shuffled, targets to distinct ones.
    Both are put in one order, in which each target sees the next forecast after it and the last
    one before: no pairs of targets and forecasts are formed, however many a key has.
    """
    keys = list(keys)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    issued = forecasts.filter(known & F.col("PRED_DEKAD").isNotNull()).groupBy(
        *keys, "PRED_DEKAD").agg(F.min(F.struct(
            parse_date("PRED_DATE").alias("date"), F.col("YIELD_PRED").alias("value"))).alias("first"))
    found = F.struct("PRED_DEKAD", F.col("first.value").alias("value"))
    issued = issued.select(*keys, F.col("PRED_DEKAD").alias("_at"), F.lit(1).alias("_kind"),
                           found.alias("_found"))
    asked = targets.filter(known).select(*keys, F.col("TARGET_DEKAD").alias("_at")).distinct().select(
        *keys, "_at", F.lit(0).alias("_kind"), F.lit(None).alias("_found"))
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_at"), "_kind")
    after = F.first("_found", ignorenulls=True).over(
        order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    before = F.last("_found", ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return asked.unionByName(issued).withColumn("_found", F.coalesce(after, before)).filter(
        (F.col("_kind") == 0) & F.col("_found").isNotNull()).select(
        *keys, F.col("_at").alias("TARGET_DEKAD"),
        F.col("_found.value").alias("YIELD_PRED_MCYFS"), F.col("_found.PRED_DEKAD"))


def national_table(predictions: DataFrame, targets: DataFrame, forecasts: DataFrame,
                   national_yields: DataFrame, keys: Sequence[str] = ("FYEAR",)) -> DataFrame:
    """National predictions next to the forecast and the reported yield, for years with both.

    `predictions` are rows (IDREGION, FYEAR, ALG, YIELD_PRED); `keys` identify a nation-year.
    """
    forecast = asof_forecast(targets, forecasts, keys).drop("PRED_DEKAD", "TARGET_DEKAD")
    reported = national_yields.groupBy(*keys).agg(F.min("YIELD").alias("YIELD"))
    return (
        predictions.join(forecast, list(keys)).join(reported, list(keys))
        .filter((F.col("YIELD_PRED_MCYFS") > 0) & (F.col("YIELD") > 0))
        .select("IDREGION", "FYEAR", "ALG", "YIELD_PRED", "YIELD_PRED_MCYFS", "YIELD")
    )


def compare_national(table: DataFrame, by: Sequence[str] = (),
                     metrics: Sequence[str] = DEFAULT_METRICS) -> DataFrame:
    """Scores of every algorithm and of the external forecast on the national table."""
    own = table.select("IDREGION", "FYEAR", "ALG", "YIELD_PRED", "YIELD")
    external = table.select("IDREGION", "FYEAR", F.lit(FORECAST_ALG).alias("ALG"),
                            F.col("YIELD_PRED_MCYFS").alias("YIELD_PRED"), "YIELD").distinct()
    scored = scores(own.unionByName(external), by=[*by, "ALG"], metrics=metrics)
    return scored.withColumnsRenamed({m: f"test_{m}" for m in metrics})
