"""Calendar fields of `yyyyMMdd` or `dd/MM/yyyy` strings; anything else gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_date(date: Column | str) -> Column:
    text = (F.col(date) if isinstance(date, str) else date).cast("string")
    return F.when(F.length(text) == 8, F.try_to_date(text, "yyyyMMdd")).otherwise(
        F.try_to_date(text, "dd/MM/yyyy")
    )


def year_of(date: Column | str) -> Column:
    return F.year(parse_date(date))


def month_of(date: Column | str) -> Column:
    return F.month(parse_date(date))


def day_of(date: Column | str) -> Column:
    return F.dayofmonth(parse_date(date))


def _dekad(day: Column) -> Column:
    third = F.least(F.ceil(F.dayofmonth(day) / 10), F.lit(3))
    return ((F.month(day) - 1) * 3 + third).cast("int")


def dekad_of(date: Column | str) -> Column:
    """Ten-day period of the year, 1..36; the 31st belongs to the month's third dekad."""
    return _dekad(parse_date(date))


def with_year_dekad(df: DataFrame, date: str = "DATE") -> DataFrame:
    """Replace the date column by FYEAR and DEKAD, placed right after IDREGION."""
    if date not in df.columns or "FYEAR" in df.columns:
        return df
    rest = [c for c in df.columns if c not in ("IDREGION", date)]
    parsed = df.withColumn("_day", parse_date(date))
    return parsed.select(
        "IDREGION",
        F.year("_day").alias("FYEAR"),
        _dekad(F.col("_day")).alias("DEKAD"),
        *rest,
    )
