"""Row-wise cleaning and reshaping of the raw sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import crop_id, dekad_of


def only_crop(df: DataFrame, crop: int) -> DataFrame:
    """Rows of one crop, without the id column; the filter reaches the scan."""
    return df.filter(F.col("CROP_ID") == crop).drop("CROP_ID")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop the unnamed columns (`_c7`, ...) a trailing CSV separator leaves behind."""
    return df.drop(*[c for c in df.columns if c.startswith("_c")])


def year_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c[0].isdigit()]


def unpivot_years(df: DataFrame, ids=("Crop", "IDREGION")) -> DataFrame:
    """One row per year column: (ids..., FYEAR, YIELD)."""
    years = year_columns(df)
    return df.unpivot(list(ids), years, "FYEAR", "YIELD").withColumn(
        "FYEAR", F.col("FYEAR").cast("int"))


def clean_yield(df: DataFrame, crop: int) -> DataFrame:
    """Long, positive yields of one crop from a long or a wide yield table."""
    df = drop_empty_columns(df)
    if year_columns(df):
        df = unpivot_years(df, df.columns[:2])
    return (
        df.filter(crop_id(df.columns[0]) == crop)
        .select(
            "IDREGION",
            F.col("FYEAR").cast("int").alias("FYEAR"),
            F.col("YIELD").try_cast("double").alias("YIELD"),
        )
        .filter(F.col("YIELD") > 0)
    )


def clean_forecast(df: DataFrame, crop: int) -> DataFrame:
    """External national forecasts of one crop, with the dekad they were issued in."""
    return df.filter(crop_id("CROP") == crop).select(
        "IDREGION",
        F.col("FYEAR").cast("int").alias("FYEAR"),
        F.col("PREDICTION_DATE").alias("PRED_DATE"),
        F.col("YIELD_PRED").try_cast("double").alias("YIELD_PRED"),
        dekad_of("PREDICTION_DATE").alias("PRED_DEKAD"),
    )



def clean_area(df: DataFrame, crop: int) -> DataFrame:
    """Area fractions of one crop."""
    return only_crop(df.withColumn("FYEAR", F.col("FYEAR").cast("int")), crop)


def soil_capacity(df: DataFrame) -> DataFrame:
    """Water holding capacity: field capacity minus wilting point."""
    return df.select("IDREGION", F.bround(F.col("SM_FC") - F.col("SM_WP"), 2).alias("SM_WHC"))


def round_cols(df: DataFrame, cols, digits: int = 2) -> DataFrame:
    return df.withColumns({c: F.bround(c, digits) for c in cols})


def round_centroids(df: DataFrame) -> DataFrame:
    return round_cols(df, ("CENTROID_X", "CENTROID_Y"))


def water_balance(df: DataFrame) -> DataFrame:
    """Climate water balance: precipitation minus evapotranspiration."""
    return df.withColumn("CWB", F.bround(F.col("PREC") - F.col("ET0"), 2))


def expand_to_children(parents: DataFrame, children: DataFrame,
                       prefix_length: int = 4) -> DataFrame:
    """Copy every parent-region row to each child region, matched by code prefix.

    An equi-join on the prefix: the optimizer broadcasts the region list when its measured
    size is small and otherwise shuffles both sides, splitting skewed parents.
    """
    lookup = children.select(
        F.col("IDREGION").alias("_child"),
        F.left("IDREGION", F.lit(prefix_length)).alias("_parent"),
    ).distinct()
    rest = [c for c in parents.columns if c != "IDREGION"]
    return parents.join(lookup, parents["IDREGION"] == lookup["_parent"]).select(
        F.col("_child").alias("IDREGION"), *rest)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail early when nothing is left; one cheap `isEmpty`, for pipeline edges only."""
    if df.isEmpty():
        raise ValueError(f"no rows left: {what}")
    return df
