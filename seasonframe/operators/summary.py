"""Long-term summaries per region, each a single aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import steady_round

# Columns summarised per source, as (min, max, avg).
_WEATHER = ["TMAX", "TMIN", "TAVG", "PREC", "ET0", "CWB", "RAD"]
SUMMARY_COLUMNS = {
    "WOFOST": (
        ["RSM"],
        ["WLIM_YB", "WLIM_YS", "DVS", "WLAI", "RSM", "TWC", "TWR"],
        ["WLAI", "RSM", "TWC", "TWR"],
    ),
    "METEO": (_WEATHER, _WEATHER, _WEATHER),
    "REMOTE_SENSING": (["FAPAR"], ["FAPAR"], ["FAPAR"]),
}


def indicator_summary(df: DataFrame, min_cols, max_cols, avg_cols,
                      key: str = "IDREGION") -> DataFrame:
    """`min(X)`, `max(X)` and `avg(X)` columns per region, averages to 2 decimals."""
    aggregates = [
        *[F.min(c).alias(f"min({c})") for c in min_cols],
        *[F.max(c).alias(f"max({c})") for c in max_cols],
        *[steady_round(F.avg(c), 2).alias(f"avg({c})") for c in avg_cols],
    ]
    if not aggregates:
        return df.select(key).distinct()
    return df.groupBy(key).agg(*aggregates)


def source_summary(df: DataFrame, source: str) -> DataFrame:
    return indicator_summary(df, *SUMMARY_COLUMNS[source])


def yield_summary(df: DataFrame) -> DataFrame:
    return indicator_summary(df, ["YIELD"], ["YIELD"], ["YIELD"])


def year_range(df: DataFrame, year: str = "FYEAR") -> DataFrame:
    """One row (MIN_YEAR, MAX_YEAR); use `.scalar()` on a column of it inside expressions."""
    return df.agg(F.min(year).alias("MIN_YEAR"), F.max(year).alias("MAX_YEAR"))


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct()
