from conftest import rows
from pyspark.sql import functions as F

from seasonframe.functions import (
    country_of, crop_id, crop_name, day_of, dekad_of, month_of, parent_region, steady_round,
    with_year_dekad, year_of,
)


def dates(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "DATE string")


def parts(df):
    return [tuple(r) for r in df.select(
        year_of("DATE"), month_of("DATE"), day_of("DATE"), dekad_of("DATE")).collect()]


def test_both_date_formats(spark):
    df = dates(spark, "19940102", "15831224", "02/01/1994", "31/12/1999")
    assert parts(df) == [(1994, 1, 2, 1), (1583, 12, 24, 36), (1994, 1, 2, 1), (1999, 12, 31, 36)]


def test_bad_dates_are_null_not_errors(spark):
    got = parts(dates(spark, "14341224", "12345678", "123-12-24"))
    assert got[0] == (1434, 12, 24, 36)
    assert got[1:] == [(None,) * 4] * 2


def test_dekad_boundaries(spark):
    df = dates(spark, "20010110", "20010111", "20010120", "20010121", "20010129", "20010130",
               "20010131", "20010201")
    assert [p[3] for p in parts(df)] == [1, 2, 2, 3, 3, 3, 3, 4]


def test_every_day_has_one_of_36_dekads(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2000-01-01', DATE'2000-12-31')) AS d") \
        .selectExpr("date_format(d, 'yyyyMMdd') AS DATE")
    counts = days.groupBy(dekad_of("DATE").alias("d")).count()
    assert counts.count() == 36
    assert counts.agg(F.min("count"), F.max("count")).first() == (9, 11)


def test_year_dekad_replaces_date(spark):
    df = spark.createDataFrame([("NL11", "19790110", 1.0), ("NL12", "21/01/1979", 2.0)],
                               "IDREGION string, DATE string, X double")
    out = with_year_dekad(df)
    assert out.columns == ["IDREGION", "FYEAR", "DEKAD", "X"]
    assert rows(out) == [("NL11", 1979, 1, 1.0), ("NL12", 1979, 3, 2.0)]
    assert with_year_dekad(out).columns == out.columns


def test_year_dekad_on_integer_dates(spark):
    df = spark.createDataFrame([("NL11", 19790110)], "IDREGION string, DATE int")
    assert rows(with_year_dekad(df)) == [("NL11", 1979, 1)]


def test_crops(spark):
    names = spark.createDataFrame([("Potatoes",), ("Soybean",), ("Sugar Beets",)], "n string")
    assert rows(names.select("n", crop_id("n"))) == [
        ("Potatoes", 7), ("Soybean", 0), ("Sugar Beets", 6)]
    ids = spark.createDataFrame([(6,), (8,), (95,)], "i int")
    assert rows(ids.select("i", crop_name("i"))) == [
        (6, "sugarbeet"), (8, "NA"), (95, "spring barley")]


def test_regions(spark):
    df = spark.createDataFrame([("FR102",)], "r string")
    assert df.select(country_of("r"), parent_region("r"), parent_region("r", 3)).first() == (
        "FR", "FR10", "FR")


def test_steady_round_ignores_summation_noise(spark):
    df = spark.createDataFrame([(7.525,), (7.5249999999999995,), (7.515,)], "x double")
    assert [r[0] for r in df.select(steady_round("x", 2)).collect()] == [7.52, 7.52, 7.52]
