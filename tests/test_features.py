import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from seasonframe.operators import features
from seasonframe.operators.features import FeatureSpec

SPEC = FeatureSpec(maxima={"p2": ["X"]}, averages={"p1": ["X"]}, extremes={"p2": ["X"]})


def calendar(spark):
    return spark.createDataFrame(
        [("AA11", 2000, 10, 20, 30, 36), ("BB11", 2000, 12, 20, 30, 36)],
        "IDREGION string, CAMPAIGN_YEAR int, START_DVS int, START_DVS1 int, START_DVS2 int, "
        "CAMPAIGN_EARLY_SEASON int")


def value(region, year, dekad):
    return float((dekad * 7 + year * 3 + len(region)) % 11) + (100 if dekad == 15 else 0)


def series(spark):
    return spark.createDataFrame(
        [(r, y, d, value(r, y, d), "test" if y == 2002 else "train")
         for r in ("AA11", "AA12", "BB11") for y in (2000, 2001, 2002) for d in range(1, 37)],
        "IDREGION string, CAMPAIGN_YEAR int, CAMPAIGN_DEKAD int, X double, SPLIT string")


def test_features_against_plain_python(spark):
    out = features.build_features(series(spark), calendar(spark), SPEC)
    got = {(r["IDREGION"], r["CAMPAIGN_YEAR"]): r for r in out.collect()}
    assert len(got) == 9
    start = {"AA": 10, "BB": 12}
    for country in ("AA", "BB"):
        regions = [r for r in ("AA11", "AA12", "BB11") if r.startswith(country)]
        p2 = range(start[country], 21)
        seen = [value(r, y, d) for r in regions for y in (2000, 2001) for d in p2]
        mean, spread = round(statistics.mean(seen), 2), round(statistics.stdev(seen), 2)
        for r in regions:
            for y in (2000, 2001, 2002):
                xs = [value(r, y, d) for d in p2]
                row = got[r, y]
                assert row["maxXp2"] == max(xs)
                p1 = [value(r, y, d) for d in range(start[country] - 1, start[country] + 2)]
                assert row["avgXp1"] == pytest.approx(statistics.mean(p1), abs=0.0051)
                for i in (1, 2):
                    assert row[f"Xp2gt{i}STD"] == sum(x > mean + i * spread for x in xs)
                    assert row[f"Xp2lt{i}STD"] == sum(x < mean - i * spread for x in xs)


def test_missing_is_filled_only_with_extremes(spark):
    early = series(spark).filter("CAMPAIGN_DEKAD < 5")
    filled = features.build_features(early, calendar(spark), SPEC).first()
    assert filled["maxXp2"] == 0.0 and filled["avgXp1"] == 0.0 and filled["Xp2gt1STD"] == 0
    plain = FeatureSpec(averages={"p1": ["X"]})
    assert features.build_features(early, calendar(spark), plain).first()["avgXp1"] is None


def test_country_without_training_calendar_drops_out(spark):
    only_a = calendar(spark).filter("IDREGION = 'AA11'")
    out = features.build_features(series(spark), only_a, SPEC)
    assert {r[0] for r in out.select("IDREGION").collect()} == {"AA11", "AA12"}


def test_drop_zero_features(spark):
    df = spark.createDataFrame(
        [("A", 1, "train", 0.0, 1.0, 1.0, 0.0), ("A", 2, "train", 0.0, None, 2.0, 0.0),
         ("A", 3, "test", 5.0, 1.0, None, 0.0)],
        "IDREGION string, FYEAR int, SPLIT string, ZERO double, GAP double, GOOD double, "
        "`max(Z)` double")
    assert features.drop_zero_features(df).columns == ["IDREGION", "FYEAR", "SPLIT", "GOOD"]


def test_from_year(spark):
    yields = spark.createDataFrame([(2001, "train"), (2000, "test")], "FYEAR int, SPLIT string")
    years = series(spark).withColumn(
        "SPLIT", F.when(F.col("CAMPAIGN_YEAR") == 2000, "test").otherwise("train"))
    assert rows(features.from_year(years, yields).select("CAMPAIGN_YEAR").distinct()) == [
        (2001,), (2002,)]
    kept = features.from_year(years, yields, train_only=True)
    assert rows(kept.select("CAMPAIGN_YEAR").distinct()) == [(2000,), (2001,), (2002,)]


def test_combine_counts_and_columns(spark):
    def table(name, years):
        return spark.createDataFrame([("A", y, "train", float(y)) for y in years],
                                     f"IDREGION string, FYEAR int, SPLIT string, {name} double")

    soil = spark.createDataFrame([("A", 0.2)], "IDREGION string, SM_WHC double")
    counts = {}
    out = features.combine_features(
        {"WOFOST": table("G", [1, 2, 3]), "METEO": table("W", [2, 3, 4])}, table("YIELD", [3]),
        {"SOIL": soil}, counts)
    assert out.columns == ["IDREGION", "FYEAR", "SM_WHC", "G", "W", "YIELD", "SPLIT"]
    assert rows(out) == [("A", 3, 0.2, 3.0, 3.0, 3.0, "train")]
    assert {n: o.get["rows"] for n, o in counts.items()} == {
        "WOFOST": 3, "METEO": 2, "YIELD": 1, "SOIL": 1}


def test_specs_have_the_documented_size(spark):
    sizes = {n: len(features._period_columns(s)) + len(features._extreme_columns(s))
             for n, s in features.SPECS.items()}
    assert sizes == {"WOFOST": 25, "METEO": 30, "REMOTE_SENSING": 2}
