"""All entry points on files derived from the smallest test tables."""

from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from seasonframe import RunConfig
from seasonframe.operators.models import EstimatorSpec
from seasonframe.plans import pipeline
from seasonframe.plans.queries import Tables

SF = "/root/testdata/sf0.001"
RIDGE = EstimatorSpec("Ridge", "ridge", ({"alpha": 0.1},), ({"alpha": 0.1}, {"alpha": 10.0}))
SMALL = (
    RIDGE,
    EstimatorSpec("KNN", "knn", ({"k": 5},), ({"k": 3}, {"k": 5})),
    EstimatorSpec("GBDT", "gbdt", ({"max_depth": 2, "trees": 3},), ({"max_depth": 2, "trees": 3},)),
)

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The domain tables as source files of a made-up country."""
    out = tmp_path_factory.mktemp("sources")
    t = Tables(spark, SF, kept=("daily", "monthly"))

    def put(name, level, df):
        df.coalesce(1).write.option("header", True).csv(f"{out}/{name}_{level}_RX.csv")

    put("WOFOST", "NUTS2", t.growth)
    put("METEO_DAILY", "NUTS2", t.weather)
    put("SOIL", "NUTS2", t.soil)
    put("CENTROIDS", "NUTS2", t.centroids)
    put("YIELD", "NUTS2", t.wide_yields)
    put("REMOTE_SENSING", "NUTS2", t.greenness)
    for length, level in ((4, "NUTS2"), (3, "NUTS1")):
        put("AREA_FRACTIONS", level, t.areas(length))
    country = "R0"
    put("YIELD", "NUTS0", t.national_yields.filter(F.col("IDREGION") == country).select(
        F.lit("potatoes").alias("Crop"), "IDREGION", "FYEAR", "YIELD"))
    put("YIELD_PRED_MCYFS", "NUTS0", t.forecasts.filter(F.col("IDREGION") == country))
    return str(out)


@pytest.fixture
def cfg(folder, tmp_path):
    return RunConfig(country_code="RX", data_path=folder, output_path=str(tmp_path),
                     estimators=SMALL, cv_folds=3, use_centroids=True, save_features=True)


def test_sources_to_comparison(spark, cfg):
    result = pipeline.run(spark, cfg.updated(compare_with_forecast=True))
    algorithms = {"Ridge", "KNN", "GBDT"}
    assert {r["ALG"] for r in result.scores.collect()} == algorithms | {"average"}
    assert set(result.selections) == algorithms
    assert result.frequency.filter("PERIOD = 'p2'").count() > 0
    assert result.predictions.filter("YIELD_PRED_Ridge IS NULL").count() == 0
    assert {r[0] for r in rows(result.test.select("FYEAR").distinct())} == {1997, 2000}

    # saved features give the same ridge predictions, without touching the sources
    again = pipeline.run(spark, cfg.updated(
        use_saved_features=True, data_path="/nowhere", estimators=(RIDGE,), save_features=False))
    first = {tuple(r[:2]): r[2] for r in rows(
        result.predictions, "IDREGION", "FYEAR", "YIELD_PRED_Ridge")}
    for region, year, value in rows(again.predictions, "IDREGION", "FYEAR", "YIELD_PRED_Ridge"):
        assert first[region, year] == pytest.approx(value, rel=1e-6)

    national, scores = result.national
    assert {r["ALG"] for r in scores.collect()} == algorithms | {"MCYFS_Predictions"}
    assert {r["IDREGION"] for r in national.collect()} <= {"R0", "R1", "R2", "R3", "R4"}


def test_trend_residuals_and_saved_predictions(spark, cfg):
    run = cfg.updated(estimators=(RIDGE,), cv_folds=1, use_yield_trend=True,
                      predict_yield_residuals=True, trend_windows=(3,), use_centroids=False,
                      save_features=False, find_optimal_trend_window=True)
    result = pipeline.run(spark, run)
    assert result.predictions.columns == [
        "IDREGION", "FYEAR", "SPLIT", "YIELD_TREND", "YIELD_RES", "YIELD_RES_PRED_Ridge",
        "YIELD_PRED_Ridge", "YIELD"]
    off = result.predictions.filter(
        "abs(YIELD_RES_PRED_Ridge + YIELD_TREND - YIELD_PRED_Ridge) > 1e-9")
    assert off.count() == 0
    assert {r["ALG"] for r in result.scores.collect()} == {"Ridge", "trend"}
    assert {r[0] for r in rows(result.test.select("FYEAR").distinct())} <= {2000, 2001}

    wide, scores = pipeline.run_comparison(spark, run)
    assert "YIELD_PRED_Ridge" in wide.columns and scores.count() == 2


def test_objective_scaler_and_row_counts(spark, cfg):
    run = cfg.updated(estimators=SMALL[:2], cv_folds=1, use_yield_trend=True, trend_windows=(3,),
                      save_features=False, selectors=("rfe_lasso", "mutual_info"), debug_level=1,
                      scaler="minmax", selection_objective="MAE", training_objective="R2")
    result = pipeline.run(spark, run)
    assert {r["ALG"] for r in result.scores.collect()} == {"Ridge", "KNN", "trend"}
    assert set(result.selections["Ridge"].scores) == {"rfe_lasso", "mutual_info", "combined"}
    assert list(result.row_counts)[-3:] == ["YIELD", "SOIL", "CENTROIDS"]
    assert result.row_counts["CENTROIDS"] == result.predictions.count() > 0


def test_early_season(spark, cfg):
    run = cfg.updated(early_season_prediction=True, early_season_end_dekad=-12,
                      use_remote_sensing=False, use_centroids=False)
    parts = pipeline.split_sources(
        pipeline.preprocess(pipeline.readers.load_all(spark, run), run), run)
    counts = {}
    table = pipeline.feature_table(
        parts, pipeline.summarise(parts, run)["CALENDAR"], run, counts)
    assert table.count() > 0
    # the harvest window lies after the early-season end
    assert not [c for c in table.columns if "p5" in c]
    assert set(counts) == {"WOFOST", "METEO", "YIELD", "SOIL"}


def test_summaries(spark, cfg):
    parts = pipeline.split_sources(
        pipeline.preprocess(pipeline.readers.load_all(spark, cfg), cfg), cfg)
    summaries = pipeline.summarise(parts, cfg)
    assert set(summaries) == {"WOFOST", "METEO", "REMOTE_SENSING", "CALENDAR", "YIELD"}
    assert "avg(CWB)" in summaries["METEO"].columns and summaries["YIELD"].count() > 0
