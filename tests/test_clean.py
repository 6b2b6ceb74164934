import pytest
from conftest import rows

from seasonframe.operators import clean


def long_yields(spark):
    values = {"potatoes": [31.5, 36.25, 18.0, 22.6], "sugarbeet": [71.0, 48.5, 80.25, 62.0]}
    keys = [("SI01", "2005"), ("SI01", "2007"), ("SI04", "2005"), ("SI04", "2006")]
    return spark.createDataFrame(
        [(crop, *k, v) for crop, vs in values.items() for k, v in zip(keys, vs)],
        "Crop string, IDREGION string, FYEAR string, YIELD double")


def wide_yields(spark):
    return spark.createDataFrame(
        [("Total potatoes", "AT21", 27.5, None, 33.25), ("Total potatoes", "AT22", 0.0, 41.0, 12.5),
         ("Spring barley", "AT21", 3.5, 3.75, 4.0)],
        "Crop string, IDREGION string, `2005` double, `2006` double, `2008` double")


def test_long_yields(spark):
    assert rows(clean.clean_yield(long_yields(spark), 7)) == [
        ("SI01", 2005, 31.5), ("SI01", 2007, 36.25), ("SI04", 2005, 18.0), ("SI04", 2006, 22.6)]


def test_wide_yields_with_trailing_column(spark):
    df = wide_yields(spark).selectExpr("*", "CAST(NULL AS STRING) AS _c5")
    assert rows(clean.clean_yield(df, 7)) == [
        ("AT21", 2005, 27.5), ("AT21", 2008, 33.25), ("AT22", 2006, 41.0), ("AT22", 2008, 12.5)]


def test_bad_yields_go_away(spark):
    df = spark.createDataFrame(
        [("potato", "NL11", 1990, v) for v in (None, "n/a", "0", "-1", "2.5")],
        "Crop string, IDREGION string, FYEAR int, YIELD string")
    assert rows(clean.clean_yield(df, 7)) == [("NL11", 1990, 2.5)]


def test_forecasts(spark):
    df = spark.createDataFrame(
        [("NL", "Potatoes", "11/06/1999", 1999, 44.5), ("NL", "Rye", "11/06/1999", 1999, 4.5)],
        "IDREGION string, CROP string, PREDICTION_DATE string, FYEAR int, YIELD_PRED double")
    assert rows(clean.clean_forecast(df, 7)) == [("NL", 1999, "11/06/1999", 44.5, 17)]


def test_area_and_crop_filter(spark):
    df = spark.createDataFrame([("NL11", "1999", 7, 0.5), ("NL11", "1999", 6, 0.2)],
                               "IDREGION string, FYEAR string, CROP_ID int, FRACTION double")
    assert rows(clean.clean_area(df, 7)) == [("NL11", 1999, 0.5)]


def test_soil_and_centroids(spark):
    soil = spark.createDataFrame([("NL11", 0.355, 0.12)],
                                 "IDREGION string, SM_FC double, SM_WP double")
    assert rows(clean.soil_capacity(soil)) == [("NL11", 0.24)]
    centroids = spark.createDataFrame(
        [("NL11", 4.125, 52.135, 7.0)],
        "IDREGION string, CENTROID_X double, CENTROID_Y double, DIST double")
    assert rows(clean.round_centroids(centroids)) == [("NL11", 4.12, 52.14, 7.0)]


def test_parents_to_children(spark):
    parents = spark.createDataFrame(
        [("FR10", f"1979{i:04d}", i / 100) for i in range(18)] + [("FR20", "19790101", 9.0)],
        "IDREGION string, DATE string, FAPAR double")
    children = spark.createDataFrame([("FR102",), ("FR103",), ("FR102",)], "IDREGION string")
    out = clean.expand_to_children(parents, children)
    assert out.count() == 36
    assert {r[0] for r in out.select("IDREGION").distinct().collect()} == {"FR102", "FR103"}


def test_require_rows(spark):
    with pytest.raises(ValueError, match="no rows left"):
        clean.require_rows(spark.range(0), "anything")
