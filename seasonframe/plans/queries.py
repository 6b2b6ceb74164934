"""Every operator as a query over the star schema: name -> callable(spark, sf_dir)."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import (
    country_of, crop_id, crop_name, day_of, dekad_of, month_of, parent_region, with_year_dekad,
    year_of,
)
from ..operators import (
    calendars, clean, features, grouped, metrics, models, rollup, season, splits, summary, trend,
)
from ..operators.moments import collect_moments, lasso_elimination, lasso_weights, ridge_fit
from ..operators.neighbours import knn_predictions
from ..operators.univariate import mutual_information as information
from ..sources import readers, writers
from ..storage import checkpoint_dir, cut
from . import domain, pipeline

CROP = 7
MODEL_FEATURES = ["avgTAVGp2", "avgPRECp3"]
WINDOWS = [3, 4, 5]
QUERIES = {}


def query(*kept):
    """Register a query; `kept` are the tables it reads repeatedly, to be materialised once."""
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir, kept))
        return fn
    return register


# --- tables several queries are built on ----------------------------------------------------

class Tables(domain.Domain):
    """Season-aligned tables on top of the domain tables."""

    def on_season(self, crosses=False, whole=False):
        return season.crop_season(self.crop_growth, crosses, whole)

    @cached_property
    def crop_growth(self):
        return self.keep("crop_growth", clean.only_crop(self.growth, CROP))

    @cached_property
    def season(self):
        return self.keep("season", self.on_season())

    @cached_property
    def growth_ready(self):
        return self.keep("growth_ready", season.prepare_growth(self.crop_growth, self.season))

    @cached_property
    def weather_ready(self):
        return self.keep(
            "weather_ready", season.prepare_weather(self.weather, self.season))

    @cached_property
    def greenness(self):
        return clean.expand_to_children(self.remote_sensing, self.regions, prefix_length=2)

    @cached_property
    def greenness_ready(self):
        return season.prepare_remote_sensing(self.greenness, self.season)

    @cached_property
    def calendar(self):
        return self.keep("calendar", calendars.calendar_summary(self.growth_ready))

    @cached_property
    def weather_stats(self):
        return features.fit_longterm_stats(
            self.weather_ready, self.calendar, features.SPECS["METEO"])

    @cached_property
    def weather_features(self):
        self.prepare("season")
        self.prepare("weather_ready", "calendar")
        return features.period_features(
            self.weather_ready, self.calendar, features.SPECS["METEO"], self.weather_stats)

    def split(self, df, year="FYEAR", trended=False):
        return splits.with_split(df, self.yields, year, 0.3, trended)

    @cached_property
    def split_yields(self):
        return self.split(self.yields)

    @cached_property
    def predictions(self) -> DataFrame:
        """Two simple forecasts of every regional yield, as rows with SPLIT and ALG."""
        table = self.split(trend.fixed_window_trend(self.yields, 3))
        wide = table.join(self.yields, ["IDREGION", "FYEAR"]).select(
            "IDREGION", "FYEAR", "SPLIT", F.col("YIELD_TREND").alias("YIELD_PRED_line"),
            F.col("`YIELD-1`").alias("YIELD_PRED_last"), "YIELD")
        return self.keep("predictions", rollup.predictions_to_rows(
            wide, ["line", "last"], ["IDREGION", "FYEAR", "SPLIT", "YIELD"]))

    @cached_property
    def wide_predictions(self):
        return rollup.predictions_to_columns(
            self.predictions, ["line", "last"], ["IDREGION", "FYEAR", "YIELD"])

    @cached_property
    def gappy_predictions(self):
        """Predictions with gaps: one year missing for all, one region missing throughout."""
        missing = (F.col("FYEAR") == 1999) | (F.col("IDREGION") == "R207")
        return self.predictions.select(
            "IDREGION", "FYEAR", "ALG", F.when(~missing, F.col("YIELD_PRED")).alias("YIELD_PRED"))

    @cached_property
    def gappy_with_areas(self):
        return self.areas(4).drop("CROP_ID").join(self.gappy_predictions, ["IDREGION", "FYEAR"])

    @cached_property
    def rolled_up(self):
        return rollup.weighted_rollup(self.gappy_predictions, [self.areas(4), self.areas(3)])

    @cached_property
    def targets(self):
        calendar = self.calendar.withColumn("IDREGION", country_of("IDREGION"))
        means = rollup.season_mean_by_year(calendar, ["IDREGION", "FYEAR"])
        return means.select("IDREGION", "FYEAR", F.col("END_SEASON").alias("TARGET_DEKAD"))

    @cached_property
    def rolled_up_whole(self):
        return rollup.weighted_rollup(
            self.predictions.select("IDREGION", "FYEAR", "ALG", "YIELD_PRED"),
            [self.areas(4), self.areas(3)])

    def national_of(self, rolled_up):
        self.prepare("monthly", "crop_growth")
        return rollup.national_table(
            rolled_up, self.targets, clean.clean_forecast(self.forecasts, CROP),
            self.national_yields, ["IDREGION", "FYEAR"])

    @cached_property
    def national(self):
        return self.keep("national", self.national_of(self.rolled_up))

    @cached_property
    def national_whole(self):
        return self.keep("national_whole", self.national_of(self.rolled_up_whole))

    @cached_property
    def model_table(self):
        """Two weather features and the label, with SPLIT; a small stable modelling problem."""
        table = features.campaign_to_year(features.period_aggregates(
            self.weather_ready, self.calendar, features.SPECS["METEO"]))
        table = table.na.drop(subset=MODEL_FEATURES).join(self.yields, ["IDREGION", "FYEAR"])
        return self.keep("model_table", self.split(
            table.select("IDREGION", "FYEAR", *MODEL_FEATURES, "YIELD")))

    @cached_property
    def weather_table(self):
        """All weather features and the label, with SPLIT; no row is left out."""
        return self.keep("weather_table", features.campaign_to_year(self.weather_features).join(
            self.split_yields, ["IDREGION", "FYEAR"]))

    def season_features(self, trended=True) -> DataFrame:
        """Growth, weather, remote sensing, soil, centroids, trend and yield in one table."""
        self.prepare("daily", "yields")
        self.prepare("season")
        self.prepare("growth_ready", "weather_ready")
        yields = self.split(self.yields, trended=trended)
        series = {"WOFOST": self.growth_ready, "METEO": self.weather_ready,
                  "REMOTE_SENSING": self.greenness_ready}
        series = {n: self.split(df, "CAMPAIGN_YEAR", trended) for n, df in series.items()}
        calendar = self.keep("calendar", calendars.calendar_summary(
            series["WOFOST"].filter(F.col("SPLIT") == "train")))
        parts = {
            n: features.campaign_to_year(features.build_features(
                features.from_year(df, yields, train_only=n != "REMOTE_SENSING"), calendar,
                features.SPECS[n]))
            for n, df in series.items()
        }
        if trended:
            parts["YIELD_TREND"] = trend.trend_features(yields, WINDOWS)
        static = {"SOIL": clean.soil_capacity(self.soil),
                  "CENTROIDS": clean.round_centroids(self.centroids)}
        return features.combine_features(parts, yields, static)


# --- dates, codes, cleaning -----------------------------------------------------------------

def _raw_dates(t):
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    text = F.when(key % 17 == 0, "12345678").when(key % 19 == 0, "123-12-24") \
        .when(key % 2 == 0, F.date_format(day, "yyyyMMdd")) \
        .otherwise(F.date_format(day, "dd/MM/yyyy"))
    return t.table("orders").select("o_orderkey", text.alias("DATE"))


@query()
def date_parts(t):
    return _raw_dates(t).select(
        "o_orderkey", "DATE", year_of("DATE").alias("FYEAR"), month_of("DATE").alias("MONTH"),
        day_of("DATE").alias("DAY"), dekad_of("DATE").alias("DEKAD"))


@query()
def year_dekad(t):
    return with_year_dekad(t.weather)


@query()
def crop_lookup(t):
    number = crop_id("Crop")
    return t.raw_yields.select(
        "Crop", "IDREGION", "FYEAR", number.alias("CROP_ID"), crop_name(number).alias("CROP_NAME"))


@query()
def region_codes(t):
    return t.sales.groupBy(
        "IDREGION", country_of("IDREGION").alias("COUNTRY"),
        parent_region("IDREGION").alias("PARENT"), parent_region("IDREGION", 2).alias("GRAND"),
    ).agg(F.count(F.lit(1)).alias("ORDERS"))


@query()
def water_balance(t):
    return clean.water_balance(t.weather.drop("IDCOVER"))


@query()
def soil_capacity(t):
    return clean.soil_capacity(t.soil)


@query()
def rounded_centroids(t):
    return clean.round_centroids(t.centroids)


@query()
def crop_filter(t):
    return t.crop_growth


@query()
def clean_yield_long(t):
    return clean.clean_yield(t.raw_yields, CROP)


@query()
def clean_yield_wide(t):
    return clean.clean_yield(t.wide_yields.withColumn("_c9", F.lit(None)), CROP)


@query()
def unpivoted_years(t):
    return clean.unpivot_years(t.wide_yields)


@query()
def empty_columns_dropped(t):
    return clean.drop_empty_columns(
        t.soil.withColumns({"_c3": F.lit(""), "_c4": F.lit("")}))


@query()
def clean_forecast(t):
    return clean.clean_forecast(t.forecasts, CROP)


@query()
def clean_area(t):
    return clean.clean_area(t.areas(4), CROP)


@query()
def parent_to_children(t):
    return t.greenness


# --- season and calendar --------------------------------------------------------------------

@query()
def season_ends(t):
    return season.season_end(t.crop_growth)


@query()
def season_ends_crossing(t):
    return season.season_end(t.crop_growth, crosses=True)


@query()
def season_bounds(t):
    return t.season


@query("crop_growth")
def season_bounds_global(t):
    # regions with an odd last digit lose their latest year, so bounds differ from per-region
    odd_last = (F.right("IDREGION", F.lit(1)).cast("int") % 2 == 1) & (F.col("FYEAR") == 2001)
    ends = season.season_end(t.crop_growth).filter(~odd_last)
    return season.season_bounds(ends, global_bounds=True)


@query("crop_growth")
def season_bounds_global_whole(t):
    return t.on_season(whole=True)


@query("crop_growth")
def growth_aligned(t):
    return season.align_to_season(with_year_dekad(t.crop_growth), t.season)


@query("crop_growth")
def growth_aligned_crossing(t):
    return season.align_to_season(
        with_year_dekad(t.crop_growth), t.on_season(crosses=True), crosses=True)


@query("crop_growth")
def growth_aligned_global(t):
    return season.align_to_season(with_year_dekad(t.crop_growth),
                                  t.on_season(whole=True), global_bounds=True)


@query("crop_growth")
def growth_prepared(t):
    return t.growth_ready


@query("daily")
def weather_prepared(t):
    return t.weather_ready


@query("daily")
def remote_sensing_prepared(t):
    return t.greenness_ready


@query("daily")
def weather_dekadal(t):
    return season.daily_to_dekadal(t.weather_ready)


@query("daily")
def weather_dekadal_view(t):
    """The same aggregation written in SQL over a temporary view of the aligned weather."""
    view = f"aligned_weather_{uuid.uuid4().hex}"
    t.weather_ready.createOrReplaceTempView(view)
    return t.spark.sql(f"""
        SELECT IDREGION, CAMPAIGN_YEAR, CAMPAIGN_DEKAD, max(TMAX) AS TMAX, min(TMIN) AS TMIN,
               bround(sum(PREC), 2) AS PREC, count(*) AS DAYS
        FROM {view} GROUP BY ALL""")


@query("crop_growth")
def calendar_summary(t):
    return t.calendar


@query("crop_growth")
def calendar_summary_early(t):
    return calendars.calendar_summary(t.growth_ready, early_offset=-6)


@query("crop_growth")
def country_calendar(t):
    return calendars.country_calendar(t.calendar)


@query("daily", "season")
def period_days(t):
    """Days of weather per region, campaign and period."""
    days = calendars.with_calendar(t.weather_ready, t.calendar)
    return days.groupBy("IDREGION", "CAMPAIGN_YEAR").agg(*[
        F.count_if(inside).alias(p) for p, inside in calendars.period_predicates().items()])


@query("crop_growth")
def calendar_report(t):
    return calendars.calendar_report(t.calendar)


@query("crop_growth")
def calendar_report_early(t):
    early = calendars.calendar_summary(t.growth_ready, early_offset=-12)
    return calendars.calendar_report(early, early=True)


# --- summaries ------------------------------------------------------------------------------

@query("crop_growth")
def growth_summary(t):
    return summary.source_summary(t.growth_ready, "WOFOST")


@query("daily")
def weather_summary(t):
    return summary.source_summary(t.weather_ready, "METEO")


@query("daily")
def remote_sensing_summary(t):
    return summary.source_summary(t.greenness_ready, "REMOTE_SENSING")


@query()
def yield_summary(t):
    return summary.yield_summary(t.yields)


@query()
def year_range(t):
    return summary.year_range(t.season)


@query("crop_growth")
def distinct_regions(t):
    return summary.distinct_keys(t.growth_ready, "IDREGION", "CAMPAIGN_YEAR")


# --- features -------------------------------------------------------------------------------

@query("crop_growth", "growth_ready")
def growth_period_aggregates(t):
    return features.period_aggregates(
        t.growth_ready, t.calendar, features.SPECS["WOFOST"])


@query("daily", "season")
def weather_longterm_stats(t):
    return t.weather_stats


@query("daily", "season", "weather_ready", "calendar")
def weather_extreme_counts(t):
    return features.extreme_counts(t.weather_ready, t.calendar,
                                   t.weather_stats, features.SPECS["METEO"])


@query("daily", "season", "weather_ready", "calendar")
def weather_features(t):
    return t.weather_features


@query("daily", "season")
def remote_sensing_features(t):
    return features.period_features(t.greenness_ready, t.calendar,
                                    features.SPECS["REMOTE_SENSING"])


@query("crop_growth", "growth_ready", "yields")
def split_growth_features(t):
    """Statistics from training rows, features for training and test rows."""
    series = t.split(t.growth_ready, "CAMPAIGN_YEAR")
    calendar = calendars.calendar_summary(series.filter(F.col("SPLIT") == "train"))
    return features.campaign_to_year(
        features.build_features(series, calendar, features.SPECS["WOFOST"]))


@query("crop_growth", "yields")
def recent_campaigns(t):
    """Growth from the first training yield on, when yields start in 1997."""
    yields = t.split(t.yields.filter(F.col("FYEAR") >= 1997))
    rows = t.split(t.growth_ready, "CAMPAIGN_YEAR")
    return features.from_year(rows, yields, train_only=True).groupBy(
        "IDREGION", "CAMPAIGN_YEAR", "SPLIT").agg(F.count(F.lit(1)).alias("N"))


@query("daily", "season", "weather_ready", "calendar")
def feature_column_usage(t):
    names = [c for c in t.weather_features.columns if c not in ("IDREGION", "CAMPAIGN_YEAR")]
    return features.column_usage(t.weather_features, names)


@query("daily", "season", "yields")
def zero_features_dropped(t):
    """Remote-sensing features joined with two dead columns, which go away."""
    table = features.campaign_to_year(features.period_features(
        t.greenness_ready, t.calendar,
        features.SPECS["REMOTE_SENSING"]))
    table = t.split(table).withColumns({
        "NOTHING": F.lit(0.0),
        "GAPS": F.when(F.col("FYEAR") != 1998, F.col("avgFAPARp2")),
    })
    return features.drop_zero_features(cut(table))


@query("daily", "season", "growth_ready", "weather_ready", "calendar", "yields")
def season_features(t):
    """Flagship: every feature family, the trend and the label in one table."""
    return t.season_features()


# --- trend ----------------------------------------------------------------------------------

@query()
def previous_yields(t):
    return trend.lag_columns(t.yields, 3)


@query()
def fixed_window_trend(t):
    return trend.fixed_window_trend(t.yields, 3)


@query("yields")
def fixed_window_point(t):
    return trend.fixed_window_query(t.yields, "R101", 2000, 4)


@query()
def leave_one_out(t):
    return trend.loo_predictions(t.yields, 4)


@query()
def leave_one_out_error(t):
    return trend.loo_rmse(t.yields, 4)


@query()
def optimal_window(t):
    return trend.optimal_window_trend(t.yields, WINDOWS)


@query("yields")
def optimal_window_point(t):
    return trend.optimal_window_query(t.yields, "R101", 2001, WINDOWS)


@query("yields")
def optimal_trend_features(t):
    return trend.optimal_trend_features(t.yields, WINDOWS)


@query("yields")
def split_trend_features(t):
    return trend.trend_features(t.split_yields, WINDOWS)


@query("yields")
def split_trend_features_optimal(t):
    yields = t.split(t.yields, trended=True)
    return trend.trend_features(yields, WINDOWS, optimal=True)


@query()
def trend_rounds(t):
    return trend.trend_rounds(t.yields, 4)


# --- splits ---------------------------------------------------------------------------------

@query()
def test_years_last(t):
    return splits.test_years(t.yields, 0.3, trend=True)


@query()
def test_years_spaced(t):
    return splits.test_years(t.yields, 0.3)


@query("yields")
def split_yields(t):
    return t.split_yields


@query("yields")
def split_test_side(t):
    yields = t.yields
    return splits.split(yields, "FYEAR", splits.test_years(yields, 0.3))[1]


@query()
def sliding_folds(t):
    return splits.sliding_folds(t.yields, 4)


@query("yields")
def contiguous_folds(t):
    return splits.contiguous_folds(t.yields, 5)


# --- predictions, scores, roll-up -----------------------------------------------------------

@query("yields")
def prediction_rows(t):
    return t.predictions


@query("yields")
def prediction_columns(t):
    return t.wide_predictions


@query("yields", "predictions")
def prediction_scores(t):
    return metrics.scores(t.predictions, metrics=[
        "NMAE", "MAPE", "NRMSE", "R2", "NSE", "EXP_VAR", "NMdAE"])


@query("yields")
def prediction_score_table(t):
    return metrics.score_table(metrics.scores(t.predictions))


@query()
def median_order_value(t):
    """Exact median of every order's cents per region, without gathering a region."""
    return metrics.exact_median(t.sales, "cents", ["IDREGION"])


@query("yields")
def null_stats(t):
    return models.null_stats(t.split_yields.filter(F.col("SPLIT") == "train"))


@query("yields")
def null_average(t):
    return models.null_model(t.split_yields)


@query("yields")
def null_trend(t):
    table = trend.fixed_window_trend(t.yields, 3)
    table = table.join(t.yields, ["IDREGION", "FYEAR"])
    return models.null_model(t.split(table), trend=True)


@query("yields")
def restored_trend(t):
    wide = t.wide_predictions
    residual = wide.withColumn("YIELD_TREND", F.col("YIELD_PRED_line")).withColumn(
        "YIELD_PRED_last", F.col("YIELD_PRED_last") - F.col("YIELD_TREND"))
    table = models.restore_trend(residual, ["last"])
    return table.withColumns({
        c: F.round(c, 6) for c in ("YIELD_PRED_last", "YIELD_RES_PRED_last")})


@query("monthly", "yields")
def missing_filled(t):
    filled = rollup.fill_missing(t.gappy_with_areas)
    return filled.withColumn("YIELD_PRED", F.round("YIELD_PRED", 6))


@query("monthly", "yields")
def fractions_renormalised(t):
    rows = rollup.fill_missing(t.gappy_with_areas).withColumn(
        "IDREG_PARENT", parent_region("IDREGION"))
    return rollup.renormalise(rows).select(
        "IDREGION", "IDREG_PARENT", "FYEAR", "ALG", F.round("FRACTION", 9).alias("FRACTION"))


@query("monthly", "yields")
def national_rollup(t):
    return t.rolled_up.withColumn("YIELD_PRED", F.round("YIELD_PRED", 6))


@query("monthly", "yields")
def national_rollup_whole(t):
    return t.rolled_up_whole.withColumn("YIELD_PRED", F.round("YIELD_PRED", 6))


@query("crop_growth")
def season_mean(t):
    calendar = calendars.calendar_summary(t.growth_ready, early_offset=-6)
    return rollup.season_mean_by_year(calendar)


@query("crop_growth")
def forecast_asof(t):
    forecasts = clean.clean_forecast(t.forecasts, CROP)
    return rollup.asof_forecast(t.targets, forecasts, ["IDREGION", "FYEAR"])


@query("monthly", "yields", "crop_growth")
def national_comparison(t):
    return t.national.withColumn("YIELD_PRED", F.round("YIELD_PRED", 6))


@query("monthly", "yields", "crop_growth", "national")
def national_scores(t):
    return rollup.compare_national(t.national, ["IDREGION"])


@query("monthly", "yields", "crop_growth")
def national_comparison_whole(t):
    return t.national_whole.withColumn("YIELD_PRED", F.round("YIELD_PRED", 6))


@query("monthly", "yields", "crop_growth", "national_whole")
def national_scores_whole(t):
    return rollup.compare_national(t.national_whole, ["IDREGION"])


# --- models ---------------------------------------------------------------------------------

@query("daily", "season", "yields", "model_table")
def scaled_features(t):
    rows = t.model_table
    stats = models.scaling_stats(rows.filter(F.col("SPLIT") == "train"), MODEL_FEATURES)
    scaled = models.population_scaled(rows, MODEL_FEATURES, stats)
    return scaled.select("IDREGION", "FYEAR", *[F.round(c, 6).alias(c) for c in MODEL_FEATURES])


@query("daily", "season", "yields", "model_table")
def ridge_predictions(t):
    rows = t.model_table
    train = rows.filter(F.col("SPLIT") == "train")
    line = ridge_fit(collect_moments(train, MODEL_FEATURES, "YIELD", "FYEAR"), alpha=5.0)
    return rows.select("IDREGION", "FYEAR", "SPLIT",
                       F.round(line.column(), 6).alias("YIELD_PRED"))


@query("daily", "season", "yields", "model_table")
def knn_test_predictions(t):
    rows = t.model_table
    train, test = (rows.filter(F.col("SPLIT") == s) for s in ("train", "test"))
    found = knn_predictions(test, train, MODEL_FEATURES, "YIELD", models.IDS, [3, 5])
    ids = F.from_json("qid", "IDREGION string, FYEAR int")
    return found.select(ids.alias("id"), "K3", "K5").select(
        "id.IDREGION", "id.FYEAR", F.round("K3", 6).alias("K3"), F.round("K5", 6).alias("K5"))


def _numeric(table):
    return [c for c in table.columns if c not in ("IDREGION", "FYEAR", "SPLIT", "YIELD")]


def _scaled(rows):
    names = _numeric(rows)
    stats = models.scaling_stats(rows.filter(F.col("SPLIT") == "train"), names)
    return models.population_scaled(rows, names, stats), names


@query("daily", "season", "weather_ready", "calendar", "yields", "weather_table")
def scaled_features_whole(t):
    """Every weather feature of every row, scaled by the training rows, one row per value."""
    scaled, names = _scaled(t.weather_table)
    return scaled.unpivot(["IDREGION", "FYEAR"], names, "FEATURE", "VALUE").withColumn(
        "VALUE", F.round("VALUE", 6))


@query("daily", "season", "weather_ready", "calendar", "yields", "weather_table")
def knn_predictions_whole(t):
    """Test years from all weather features and the whole grid of k; a missing value counts as
    the training mean."""
    scaled, names = _scaled(t.weather_table)
    rows = scaled.na.fill(0.0, subset=names)
    train, test = (rows.filter(F.col("SPLIT") == s) for s in ("train", "test"))
    found = knn_predictions(test, train, names, "YIELD", models.IDS, [3, 5, 7, 9])
    ids = F.from_json("qid", "IDREGION string, FYEAR int")
    return found.withColumn("id", ids).select(
        "id.IDREGION", "id.FYEAR", *(F.round(f"K{k}", 6).alias(f"K{k}") for k in (3, 5, 7, 9)))


@query("monthly", "yields")
def experiment_ridge(t):
    """Every crop and country as an experiment of its own, all in one job: yields from the two
    previous ones, penalty by 5 folds."""
    names, keys = ["YIELD-1", "YIELD-2"], ["CROP", "COUNTRY"]
    rows = trend.lag_columns(t.yields, 2).select("IDREGION", "FYEAR", *(f"`{n}`" for n in names)).join(
        t.raw_yields, ["IDREGION", "FYEAR"]).select(
        F.col("Crop").alias("CROP"), country_of("IDREGION").alias("COUNTRY"), "IDREGION", "FYEAR",
        *(f"`{n}`" for n in names), "YIELD")
    rows = cut(rows)
    lines = grouped.grouped_ridge(rows, keys, names, "YIELD", models.TREND_ALPHAS)
    return grouped.with_lines(rows, lines, keys, names).select(
        *keys, "IDREGION", "FYEAR", "ALPHA", "YIELD", F.round("YIELD_PRED", 6).alias("YIELD_PRED"))


def _lagged(t):
    return trend.lag_columns(t.yields, 2).join(t.yields, ["IDREGION", "FYEAR"])


@query("yields")
def cv_objectives(t):
    """Validation errors of ridge from the two previous yields, by penalty and objective."""
    ts = models.training_set(_lagged(t), ["YIELD-1", "YIELD-2"])
    spec = next(s for s in models.DEFAULT_ESTIMATORS if s.kind == "ridge")
    grid, names = [{"alpha": a} for a in models.TREND_ALPHAS], [list(ts.features)] * len(ts.folds)
    return t.spark.createDataFrame(
        [(float(p["alpha"]), objective, float(e)) for objective in models.OBJECTIVES
         for p, e in zip(grid, models.cv_errors(ts, spec, grid, names, objective))],
        "ALPHA double, OBJECTIVE string, ERROR double").withColumn("ERROR", F.round("ERROR", 6))


@query("yields")
def lasso_path(t):
    """Standardised lasso coefficients of the two previous yields, at shares of the penalty that
    leaves none."""
    moments = collect_moments(_lagged(t), ["YIELD-1", "YIELD-2"], "YIELD", "FYEAR")
    total = moments.total()
    n = total[0, 0]
    covariance = total[1:-1, -1] / n - total[1:-1, 0] * total[0, -1] / n**2
    spread = moments.standardisation()[1] / moments.scale
    most = float(max(abs(covariance / spread)))
    return t.spark.createDataFrame(
        [(share, name, float(b)) for share in (1.0, 0.9, 0.5, 0.1, 0.01, 0.0)
         for name, b in zip(moments.features, lasso_weights(total, share * most))],
        "SHARE double, FEATURE string, COEFFICIENT double").withColumn(
        "COEFFICIENT", F.round("COEFFICIENT", 6))


@query("daily", "season", "weather_ready", "calendar", "yields", "weather_table")
def mutual_information(t):
    """Information of every weather feature on the yield, over the training rows."""
    table = t.weather_table
    found = information(table.filter(F.col("SPLIT") == "train"), _numeric(table), "YIELD")
    return found.withColumn("MI", F.round("MI", 9))


@query("daily", "season", "growth_ready", "weather_ready", "calendar", "yields")
def lasso_selected(t):
    """Features left by recursive elimination down to 10."""
    table = features.drop_zero_features(cut(t.season_features(trended=False)))
    train = table.filter(F.col("SPLIT") == "train")
    moments = collect_moments(train, _numeric(table), "YIELD", "FYEAR")
    kept = lasso_elimination(moments, [10])[10]
    return t.spark.createDataFrame([("rfe_lasso", f) for f in kept], "ALG string, FEATURE string") \
        .transform(models.selected_frequency)


@query("yields")
def ridge_detrended(t):
    """Trend by ridge over three previous yields, tuned on 5 folds, or all there are: n training
    years have n - 1 time-ordered folds at most."""
    table = trend.lag_columns(t.yields, 3).join(
        t.yields, ["IDREGION", "FYEAR"])
    rows = cut(t.split(table, trended=True))
    years = rows.filter(F.col("SPLIT") == "train").agg(F.count_distinct("FYEAR")).first()[0]
    return models.detrend(rows, trend.lag_names(3)[1], k=min(5, max(1, years - 1)))


@query("daily", "season", "growth_ready", "weather_ready", "calendar", "yields")
def boosted_predictions(t):
    """Boosted trees on all features of the season table: depth and number of trees from the
    default grid by 5 folds, refitted on all training rows."""
    table = cut(features.drop_zero_features(cut(t.season_features(trended=False))))
    spec = next(s for s in models.DEFAULT_ESTIMATORS if s.kind == "gbdt")
    ts = models.training_set(table.filter(F.col("SPLIT") == "train"), _numeric(table))
    model = models.grid_fit(ts, spec, ts.features)
    return model.predict(table, "YIELD_PRED").select(
        "IDREGION", "FYEAR", "SPLIT", F.lit(model.params["max_depth"]).alias("MAX_DEPTH"),
        F.lit(model.params["trees"]).alias("TREES"), "YIELD", F.round("YIELD_PRED", 6).alias("YIELD_PRED"))


@query("daily", "season", "growth_ready", "weather_ready", "calendar", "yields")
def model_scores(t):
    """Selection, tuning, training and scoring of all estimators on the season table."""
    cfg = RunConfig(use_yield_trend=False)
    table = features.drop_zero_features(cut(t.season_features(trended=False)))
    return pipeline.train_and_predict(table, cfg).scores


# --- sources and sinks ----------------------------------------------------------------------

def _folder(t, name):
    app = t.spark.sparkContext.applicationId
    return f"{checkpoint_dir(t.spark)}/{app}/{name}/{t.sf_dir.rstrip('/').rsplit('/', 1)[-1]}"


def _written_source(t, name, df, level, country=None):
    folder = _folder(t, name)
    df.write.mode("overwrite").option("header", True).csv(
        readers.source_path(folder, name, level, country))
    return folder


@query()
def source_csv(t):
    """Weather written as CSV and read back under the declared schema, with its origin."""
    folder = _written_source(t, "METEO", t.weather, "NUTS2", "RX")
    return readers.read_source(t.spark, folder, "METEO", "NUTS2", "RX", with_origin=True)


@query("daily")
def source_csv_reordered(t):
    """Weather in a file per country, each with its columns in another order, read as one table."""
    rows = cut(t.weather.withColumn("_country", country_of("IDREGION")))
    names = t.weather.columns
    for i, r in enumerate(rows.select("_country").distinct().orderBy("_country").collect()):
        own = rows.filter(F.col("_country") == r["_country"])
        folder = _written_source(t, "METEO_DAILY", own.select(names[i:] + names[:i]), "NUTS2",
                                 r["_country"])
    return readers.read_source(t.spark, folder, "METEO_DAILY", "NUTS2", "*", with_origin=True)


@query("monthly")
def source_wide_years(t):
    """Wide yields in two files with different years, read as one table and made long."""
    wide = cut(t.wide_yields)
    years = clean.year_columns(wide)
    for country, own in (("AA", years[:len(years) // 2]), ("BB", years[len(years) // 2:])):
        folder = _written_source(t, "YIELD", wide.select("Crop", "IDREGION", *own), "NUTS2", country)
    read = readers.read_source(t.spark, folder, "YIELD", "NUTS2", "*")
    return clean.unpivot_years(read).filter("YIELD IS NOT NULL")


@query("monthly", "yields")
def source_levels(t):
    """Area fractions of two levels as one table."""
    for length, level in ((4, "NUTS2"), (3, "NUTS1")):
        folder = _written_source(
            t, "AREA_FRACTIONS", t.areas(length), level, "RX")
    return readers.read_levels(t.spark, folder, "AREA_FRACTIONS", ["NUTS2", "NUTS1"], "RX")


@query("daily", "season", "yields", "model_table")
def saved_features(t):
    cfg = RunConfig(country_code="RX")
    folder = _folder(t, "saved")
    writers.save_features(t.model_table, folder, cfg)
    return writers.load_features(t.spark, folder, cfg)


@query("yields")
def saved_predictions(t):
    cfg = RunConfig(country_code="RX")
    folder = _folder(t, "saved")
    wide = t.wide_predictions
    writers.save_predictions(wide, folder, cfg, fmt="csv")
    return writers.load_predictions(t.spark, folder, cfg, fmt="csv")
