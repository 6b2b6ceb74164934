import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from seasonframe.operators import metrics, rollup


def predictions(spark, n=200):
    rng = np.random.default_rng(1)
    data = [(a, s, float(y), float(y + rng.normal(0, 2)))
            for a in ("u", "v") for s in ("train", "test") for y in rng.uniform(20, 60, n)]
    return spark.createDataFrame(data, "ALG string, SPLIT string, YIELD double, YIELD_PRED double")


def test_scores(spark):
    names = ["NMAE", "MAPE", "NRMSE", "R2", "NSE", "EXP_VAR", "NMdAE"]
    got = {(r["ALG"], r["SPLIT"]): r for r in metrics.scores(
        predictions(spark), metrics=names).collect()}
    pdf = predictions(spark).toPandas()
    for key, part in pdf.groupby(["ALG", "SPLIT"]):
        y, e = part.YIELD.to_numpy(), (part.YIELD - part.YIELD_PRED).to_numpy()
        r2 = 1 - (e ** 2).sum() / ((y - y.mean()) ** 2).sum()
        want = [100 * abs(e).mean() / y.mean(), 100 * abs(e / y).mean(),
                100 * np.sqrt((e ** 2).mean()) / y.mean(), r2, r2, 1 - e.var() / y.var(),
                100 * np.median(abs(e)) / y.mean()]
        assert [got[key][m] for m in names] == pytest.approx(want, abs=0.0051)


def test_score_table(spark):
    table = metrics.score_table(metrics.scores(predictions(spark)))
    assert table.columns == ["ALG"] + [
        f"{s}_{m}" for m in metrics.DEFAULT_METRICS for s in ("train", "test")]
    one = metrics.score_table(metrics.scores(predictions(spark), metrics=["R2"]), ["R2"])
    assert one.columns == ["ALG", "train_R2", "test_R2"] and one.count() == 2


@pytest.mark.parametrize("values", [
    [1.0], [2.0, 1.0], [5.0] * 9, [0.0] * 50 + [1e9], [-3.5, 2.0, 7.25, 100.0, 1e-9],
    list(range(999, -1, -1)), [1.0, 1.0, 1.0, 2.0, 2.0, 2.0],
])
def test_exact_median(spark, values):
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("h", 4.0)],
                               "g string, x double")
    got = {r["g"]: r["MEDIAN"] for r in metrics.exact_median(df, "x", ["g"], buckets=8).collect()}
    assert got == {"g": np.median(values), "h": 4.0}
    assert metrics.exact_median(df.filter("g = 'g'"), "x").first()["MEDIAN"] == np.median(values)


def test_median_of_hot_skewed_group(spark):
    """A third of the rows share one value and the rest spreads over many magnitudes."""
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.exp(F.col("id") % 40)).alias("x"))
    want = np.median(df.toPandas()["x"])
    assert metrics.exact_median(df, "x").first()["MEDIAN"] == want
    assert metrics.exact_median(df, "x", buckets=16, open_rows=64).first()["MEDIAN"] == want


def test_null_labels_and_unknown_predictions_are_told(spark):
    df = spark.createDataFrame(
        [(None, 10.0, 8.0), (None, 10.0, 14.0), (None, 20.0, None), ("A", 5.0, None)],
        "ALG string, YIELD double, YIELD_PRED double")
    got = {r["ALG"]: r for r in metrics.scores(
        df, by=["ALG"], metrics=["NMAE", "NMdAE", "N_SCORED", "N_UNKNOWN"]).collect()}
    assert tuple(got[None])[1:] == (30.0, 30.0, 2, 1)
    assert tuple(got["A"])[1:] == (None, None, 0, 1)
    assert metrics.scores(df, by=[], metrics=["NMdAE"]).first()["NMdAE"] == 30.0


def test_fill_and_renormalise(spark):
    df = spark.createDataFrame(
        [("R11", 1, 0.5, 10.0), ("R11", 2, 0.5, None), ("R11", 3, 0.5, 20.0),
         ("R12", 1, 0.3, None), ("R12", 2, 0.3, None), ("R12", 3, 0.3, None),
         ("R13", 1, 0.2, 30.0), ("R13", 2, 0.2, 30.0), ("R13", 3, 0.2, 30.0)],
        "IDREGION string, FYEAR int, FRACTION double, YIELD_PRED double")
    filled = rollup.fill_missing(df)
    got = {(r[0], r[1]): (r[2], r[3]) for r in filled.select(
        "IDREGION", "FYEAR", "FRACTION", "YIELD_PRED").collect()}
    assert got["R11", 2] == (0.5, 15.0) and got["R12", 1] == (0.0, 0.0)
    assert got["R13", 3] == (0.2, 30.0)
    shares = rollup.renormalise(filled.withColumn("IDREG_PARENT", F.lit("R1")))
    for (total,) in shares.groupBy("FYEAR").agg(F.sum("FRACTION")).select(
            "sum(FRACTION)").collect():
        assert total == pytest.approx(1.0)


def test_rollup_two_levels(spark):
    data = [("R011", 10.0), ("R012", 20.0), ("R021", 30.0), ("R022", None)]
    pred = spark.createDataFrame(
        [(r, y, a, None if v is None else v * m) for r, v in data for y in (1, 2)
         for a, m in (("u", 1.0), ("v", 2.0))],
        "IDREGION string, FYEAR int, ALG string, YIELD_PRED double")
    fine = spark.createDataFrame(
        [(r, y, f) for r, f in (("R011", 0.25), ("R012", 0.75), ("R021", 0.6), ("R022", 0.4))
         for y in (1, 2)], "IDREGION string, FYEAR int, FRACTION double")
    coarse = spark.createDataFrame([(r, y, f) for r, f in (("R01", 0.4), ("R02", 0.6))
                                    for y in (1, 2)],
                                   "IDREGION string, FYEAR int, FRACTION double")
    out = rollup.weighted_rollup(pred, [fine, coarse])
    # 10 * .25 + 20 * .75 = 17.5; R02 has only 30; national .4 * 17.5 + .6 * 30 = 25
    assert rows(out, "IDREGION", "FYEAR", "ALG", "YIELD_PRED") == [
        ("R0", y, a, pytest.approx(25.0 * m)) for y in (1, 2) for a, m in (("u", 1), ("v", 2))]


def test_parent_without_any_prediction_rolls_up_to_zero(spark):
    pred = spark.createDataFrame([("R011", 1, None)],
                                 "IDREGION string, FYEAR int, YIELD_PRED double")
    area = spark.createDataFrame([("R011", 1, 1.0)],
                                 "IDREGION string, FYEAR int, FRACTION double")
    assert rows(rollup.weighted_rollup(pred, [area])) == [("R01", 1, 0.0)]


def forecasts(spark):
    return spark.createDataFrame(
        [(1, 10, "01/04/2001", 1.0), (1, 16, "05/06/2001", 6.0), (1, 16, "02/06/2001", 2.0),
         (1, 22, "01/08/2001", 3.0), (2, 5, "11/02/2002", 9.0)],
        "FYEAR int, PRED_DEKAD int, PRED_DATE string, YIELD_PRED double")


@pytest.mark.parametrize("target,dekad,value", [
    (12, 16, 2.0), (16, 16, 2.0), (30, 22, 3.0), (1, 10, 1.0), (22, 22, 3.0)])
def test_asof(spark, target, dekad, value):
    targets = spark.createDataFrame([(1, float(target)), (7, 1.0)],
                                    "FYEAR int, TARGET_DEKAD double")
    got = rollup.asof_forecast(targets, forecasts(spark))
    assert rows(got, "FYEAR", "PRED_DEKAD", "YIELD_PRED_MCYFS") == [(1, dekad, value)]


def test_asof_against_all_pairs(spark):
    rng = random.Random(6)
    issued = [(rng.choice([1, 1, 1, 2, None]), rng.choice([*range(1, 37), None]),
               f"{rng.randint(10, 12)}/03/2001", float(rng.randint(1, 5))) for _ in range(400)]
    asked = [(rng.choice([1, 2, 3, None]), rng.choice([*range(-3, 40), None])) for _ in range(120)]
    got = rollup.asof_forecast(
        spark.createDataFrame(asked, "FYEAR int, TARGET_DEKAD int"),
        spark.createDataFrame(issued, "FYEAR int, PRED_DEKAD int, PRED_DATE string, YIELD_PRED double"))
    want = []
    for year, target in set(asked):
        own = [(d < (target or -9), -d if d < (target or -9) else d, p, v, d)
               for y, d, p, v in issued if y == year and year is not None and d is not None]
        want += [(year, target, min(own)[3], min(own)[4])] if own else []

    def key(r):
        return [(v is not None, v or 0) for v in r]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_asof_empty(spark):
    targets = spark.createDataFrame([(1, 12.0)], "FYEAR int, TARGET_DEKAD double")
    assert rollup.asof_forecast(targets.limit(0), forecasts(spark)).count() == 0
    assert rollup.asof_forecast(targets, forecasts(spark).limit(0)).count() == 0


def test_national_comparison(spark):
    pred = spark.createDataFrame(
        [("NL", y, a, 50.0 + y + d) for y in (1, 2, 3) for a, d in (("u", 0.0), ("v", 5.0))],
        "IDREGION string, FYEAR int, ALG string, YIELD_PRED double")
    targets = spark.createDataFrame([(1, 12.0), (2, 12.0), (3, 12.0)],
                                    "FYEAR int, TARGET_DEKAD double")
    reported = spark.createDataFrame([(1, 51.0), (2, 52.0)], "FYEAR int, YIELD double")
    table = rollup.national_table(pred, targets, forecasts(spark), reported)
    assert table.count() == 4  # year 3 has no forecast
    scored = {r["ALG"]: r for r in rollup.compare_national(table).collect()}
    assert scored["u"]["test_NRMSE"] == 0.0 and scored["v"]["test_NMAE"] == pytest.approx(9.71)
    assert set(scored) == {"u", "v", rollup.FORECAST_ALG}


def test_predictions_between_rows_and_columns(spark):
    wide = spark.createDataFrame([("A", 1, 2.0, 3.0)], "IDREGION string, FYEAR int, "
                                 "YIELD_PRED_u double, YIELD_PRED_v double")
    tall = rollup.predictions_to_rows(wide, ["u", "v"])
    assert rows(tall) == [("A", 1, "u", 2.0), ("A", 1, "v", 3.0)]
    assert rows(rollup.predictions_to_columns(tall, ["u", "v"])) == rows(wide)


def test_season_mean(spark):
    cal = spark.createDataFrame([("A", 1, 30, 24), ("B", 1, 31, 25), ("A", 2, 30, 24)],
                                "IDREGION string, CAMPAIGN_YEAR int, CALENDAR_END_SEASON int, "
                                "CALENDAR_EARLY_SEASON int")
    assert rows(rollup.season_mean_by_year(cal)) == [(1, 30.0, 24.0), (2, 30.0, 24.0)]
