"""The three entry points: sources to predictions, saved features to predictions, and saved
predictions to the national comparison."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators import clean, rollup, season
from ..operators.calendars import calendar_summary
from ..operators.features import (
    SPECS, build_features, campaign_to_year, combine_features, drop_zero_features, from_year,
)
from ..operators.metrics import score_table, scores
from ..operators.models import (
    DEFAULT_ESTIMATORS, detrend, grid_fit, null_model, restore_trend, select_features,
    selected_frequency, training_set,
)
from ..operators.splits import with_split
from ..operators.summary import source_summary, yield_summary
from ..operators.trend import lag_names, trend_features
from ..sources import readers, writers
from ..storage import cut, cut_all

SERIES = ("WOFOST", "METEO", "REMOTE_SENSING")


def preprocess(data: dict[str, DataFrame], cfg: RunConfig) -> dict[str, DataFrame]:
    """Cleaned, season-aligned sources. The season table feeds every join and is kept once."""
    growth = clean.only_crop(data["WOFOST"], cfg.crop_id)
    bounds = cut(season.crop_season(growth, cfg.season_crosses_year, cfg.global_year_bounds))
    how = (bounds, cfg.season_crosses_year, cfg.global_year_bounds)
    ready = {
        "WOFOST": season.prepare_growth(growth, *how),
        "METEO": season.prepare_weather(data["METEO"], *how),
        "SOIL": clean.soil_capacity(data["SOIL"]),
        "YIELD": clean.require_rows(clean.clean_yield(data["YIELD"], cfg.crop_id), "yield"),
    }
    if cfg.use_remote_sensing:
        observed = data["REMOTE_SENSING"].drop("IDCOVER")
        if cfg.nuts_level == "NUTS3":
            observed = clean.expand_to_children(observed, bounds.select("IDREGION").distinct())
        ready["REMOTE_SENSING"] = season.prepare_remote_sensing(observed, *how)
    if cfg.use_centroids:
        ready["CENTROIDS"] = clean.round_centroids(data["CENTROIDS"])
    return ready


def split_sources(ready: dict[str, DataFrame], cfg: RunConfig) -> dict[str, DataFrame]:
    """Add SPLIT to everything that has years; static tables stay as they are."""
    def labelled(df, year):
        return with_split(df, ready["YIELD"], year, cfg.test_fraction, cfg.use_yield_trend)

    return {
        name: labelled(df, "CAMPAIGN_YEAR") if name in SERIES
        else labelled(df, "FYEAR") if name == "YIELD" else df
        for name, df in ready.items()
    }


def summarise(parts: dict[str, DataFrame], cfg: RunConfig) -> dict[str, DataFrame]:
    """Calendar and long-term summaries of the training rows."""
    train = {n: df.filter(F.col("SPLIT") == "train") for n, df in parts.items()
             if n in SERIES or n == "YIELD"}
    summaries = {n: source_summary(train[n], n) for n in SERIES if n in train}
    summaries["CALENDAR"] = calendar_summary(train["WOFOST"], cfg.early_offset)
    summaries["YIELD"] = yield_summary(train["YIELD"])
    return summaries


def feature_table(parts: dict[str, DataFrame], calendar: DataFrame, cfg: RunConfig,
                  counts: dict | None = None) -> DataFrame:
    """Combined features and label per (IDREGION, FYEAR), with SPLIT."""
    yields = parts["YIELD"]
    # small, and needed by every source's statistics and features
    calendar = cut(from_year(calendar.withColumn("SPLIT", F.lit("train")), yields).drop("SPLIT"))
    features = {}
    for name in SERIES:
        if name in parts:
            # test rows of growth and weather are exempt from the first-year filter
            rows = from_year(parts[name], yields, train_only=name != "REMOTE_SENSING")
            features[name] = campaign_to_year(build_features(rows, calendar, SPECS[name]))
    features = {n: drop_zero_features(df) for n, df in cut_all(features).items()}
    if cfg.use_yield_trend:
        features["YIELD_TREND"] = trend_features(
            yields, cfg.trend_windows, cfg.find_optimal_trend_window)
    static = {n: parts[n] for n in ("SOIL", "CENTROIDS") if n in parts}
    return combine_features(features, yields, static, counts)


@dataclass(frozen=True)
class MLResult:
    predictions: DataFrame  # ids, SPLIT, [trend and residual columns], YIELD_PRED_<alg>, YIELD
    scores: DataFrame       # ALG, train_<metric>, test_<metric>
    frequency: DataFrame    # PERIOD, FEATURE, N
    selections: dict        # algorithm -> Selection
    params: dict            # algorithm -> chosen parameters
    national: tuple[DataFrame, DataFrame] | None = None  # see run_comparison
    row_counts: dict | None = None  # rows after each joining step, with debug_level above 0

    @property
    def test(self) -> DataFrame:
        return self.predictions.filter(F.col("SPLIT") == "test").drop("SPLIT")


def train_and_predict(table: DataFrame, cfg: RunConfig) -> MLResult:
    """Select features, tune and train every estimator, predict train and test rows."""
    trend, residuals = cfg.use_yield_trend, \
        cfg.use_yield_trend and cfg.predict_yield_residuals
    specs = cfg.estimators or DEFAULT_ESTIMATORS
    label, rows = "YIELD", cut(table)
    baseline = null_model(rows, trend)
    features = [c for c in rows.columns
                if c not in ("IDREGION", "FYEAR", "SPLIT", "YIELD", "YIELD_TREND")]
    if residuals:
        previous = lag_names(cfg.trend_windows[0])[1]
        rows, label = cut(detrend(rows, previous, cfg.cv_folds)), "YIELD_RES"
        features = [f for f in features if f not in previous] + ["YIELD_TREND"]

    train = rows.filter(F.col("SPLIT") == "train")
    ts = training_set(train, features, label, cfg.cv_folds, trend, cfg.parallelism,
                      cfg.scaler)
    predicted, names, selections, params = rows, [], {}, {}
    for spec in specs:
        picked = select_features(ts, spec, cfg.selectors, trend, cfg.selection_objective)
        model = grid_fit(ts, spec, picked.features, objective=cfg.training_objective)
        predicted = model.predict(predicted, f"YIELD_PRED_{spec.name}")
        names.append(spec.name)
        selections[spec.name], params[spec.name] = picked, model.params
    if residuals:
        predicted = restore_trend(predicted, names)

    extra = ["YIELD_TREND"] if trend else []
    own = [f"YIELD_PRED_{n}" for n in names]
    if residuals:
        extra.append("YIELD_RES")
        own = [c for n in names for c in (f"YIELD_RES_PRED_{n}", f"YIELD_PRED_{n}")]
    predictions = cut(predicted.select("IDREGION", "FYEAR", "SPLIT", *extra, *own, "YIELD"))

    stacked = rollup.predictions_to_rows(
        predictions, names, ["IDREGION", "FYEAR", "SPLIT", "YIELD"])
    scored = scores(baseline.unionByName(stacked), metrics=cfg.metrics)
    picks = rows.sparkSession.createDataFrame(
        [(n, f) for n, s in selections.items() for f in s.features], "ALG string, FEATURE string")
    return MLResult(predictions, score_table(scored, cfg.metrics), selected_frequency(picks),
                    selections, params)


def run(spark: SparkSession, cfg: RunConfig) -> MLResult:
    """Everything from the sources on, honouring the save, reuse and compare options."""
    if cfg.use_saved_predictions:
        return run_from_predictions(spark, cfg)
    if cfg.use_saved_features:
        return run_from_features(spark, cfg)
    parts = split_sources(preprocess(readers.load_all(spark, cfg), cfg), cfg)
    counts = {} if cfg.debug_level > 0 else None
    table = feature_table(parts, summarise(parts, cfg)["CALENDAR"], cfg, counts)
    if cfg.save_features:
        table = cut(table)
        writers.save_features(table, cfg.output_path, cfg, cfg.file_format)
    result = train_and_predict(table, cfg)
    if counts is not None:  # observed while the table was written, by no job of their own
        result = replace(result, row_counts={n: o.get["rows"] for n, o in counts.items()})
    return _finish(spark, result, cfg)


def run_from_features(spark: SparkSession, cfg: RunConfig) -> MLResult:
    table = writers.load_features(spark, cfg.output_path, cfg, cfg.file_format)
    return _finish(spark, train_and_predict(table, cfg), cfg)


def run_from_predictions(spark: SparkSession, cfg: RunConfig) -> MLResult:
    """Saved predictions of the test years with their scores, compared if asked for. Nothing is
    trained, so there are no selections."""
    saved = writers.load_predictions(spark, cfg.output_path, cfg, fmt=cfg.file_format)
    saved = saved.withColumn("SPLIT", F.lit("test"))
    stacked = rollup.predictions_to_rows(
        saved, _algorithms(saved), ["IDREGION", "FYEAR", "SPLIT", "YIELD"])
    none = spark.createDataFrame([], "ALG string, FEATURE string")
    result = MLResult(saved, score_table(scores(stacked, metrics=cfg.metrics), cfg.metrics),
                      selected_frequency(none), {}, {})
    return _compared(spark, result, cfg)


def _algorithms(predictions: DataFrame) -> list[str]:
    return [c.removeprefix("YIELD_PRED_") for c in predictions.columns
            if c.startswith("YIELD_PRED_")]


def _finish(spark: SparkSession, result: MLResult, cfg: RunConfig) -> MLResult:
    if cfg.save_predictions:
        writers.save_predictions(result.test, cfg.output_path, cfg, fmt=cfg.file_format)
    return _compared(spark, result, cfg)


def _compared(spark: SparkSession, result: MLResult, cfg: RunConfig) -> MLResult:
    if cfg.compare_with_forecast:
        result = replace(result, national=run_comparison(spark, cfg, result.test))
    return result


def run_comparison(spark: SparkSession, cfg: RunConfig,
                   predictions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """National predictions next to the external forecast, and the scores of both.

    Without `predictions` the saved ones are used.
    """
    if predictions is None:
        predictions = writers.load_predictions(spark, cfg.output_path, cfg, fmt=cfg.file_format)
    names = _algorithms(predictions)
    levels = [f"NUTS{i}" for i in range(int(cfg.nuts_level[-1]), 0, -1)]
    data = readers.load_all(spark, cfg, {
        "WOFOST": cfg.nuts_level, "YIELD": "NUTS0", "YIELD_PRED_MCYFS": "NUTS0"})
    areas = [clean.clean_area(readers.read_source(
        spark, cfg.data_path, "AREA_FRACTIONS", level, cfg.country_code, cfg.file_format),
        cfg.crop_id) for level in levels]

    growth = clean.only_crop(data["WOFOST"], cfg.crop_id)
    bounds = season.crop_season(growth, cfg.season_crosses_year, cfg.global_year_bounds)
    aligned = season.prepare_growth(
        growth, bounds, cfg.season_crosses_year, cfg.global_year_bounds)
    means = rollup.season_mean_by_year(calendar_summary(aligned, cfg.early_season_end_dekad))
    target = "EARLY_SEASON" if cfg.early_season_prediction else "END_SEASON"
    targets = means.select("FYEAR", F.col(target).alias("TARGET_DEKAD"))

    stacked = rollup.predictions_to_rows(predictions, names)
    table = cut(rollup.national_table(
        rollup.weighted_rollup(stacked, areas), targets,
        clean.clean_forecast(data["YIELD_PRED_MCYFS"], cfg.crop_id),
        clean.clean_yield(data["YIELD"], cfg.crop_id)))
    wide = rollup.predictions_to_columns(
        table, names, ["IDREGION", "FYEAR", "YIELD_PRED_MCYFS", "YIELD"])
    if cfg.save_predictions:
        writers.save_national_predictions(wide, cfg.output_path, cfg, cfg.file_format)
    return wide, rollup.compare_national(table, metrics=cfg.metrics)
