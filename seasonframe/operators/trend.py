"""Linear yield trends over the previous years of each region.

Windows count the preceding *rows* of a region, so gaps in the years are skipped. One window
sort per region serves every window length: the preceding points are gathered once (never more
than the longest window) and all fits are closed-form expressions over that short array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import steady_round

KEYS = ["IDREGION", "FYEAR"]


def _by_year():
    return Window.partitionBy("IDREGION").orderBy("FYEAR")


def lag_names(window: int) -> tuple[list[str], list[str]]:
    """(YEAR-w..YEAR-1, YIELD-w..YIELD-1)"""
    steps = range(window, 0, -1)
    return [f"YEAR-{i}" for i in steps], [f"YIELD-{i}" for i in steps]


def _lags(window: int) -> list[Column]:
    steps = range(window, 0, -1)
    return [
        *[F.lag("FYEAR", i).over(_by_year()).alias(f"YEAR-{i}") for i in steps],
        *[F.lag("YIELD", i).over(_by_year()).alias(f"YIELD-{i}") for i in steps],
    ]


def _all_yields_known(window: int) -> Column:
    known = F.col(f"`YIELD-{window}`").isNotNull()
    for i in range(1, window):
        known = known & F.col(f"`YIELD-{i}`").isNotNull()
    return known


def lag_columns(df: DataFrame, window: int, region: str | None = None) -> DataFrame:
    """Previous years and yields as columns; rows without `window` predecessors are dropped."""
    if region is not None:
        df = df.filter(F.col("IDREGION") == region)
    return df.select(*KEYS, *_lags(window)).filter(_all_yields_known(window))


def _preceding(window: int) -> Column:
    """The previous points as an array of (x, y), x counted from the current year."""
    frame = _by_year().rowsBetween(-window, -1)
    return F.collect_list(F.struct("FYEAR", "YIELD")).over(frame)


def _points(window: int) -> Column:
    """Last `window` points as doubles, or null when there are fewer or a yield is missing."""
    size = F.size("_past")
    last = F.slice("_past", -window, window)
    points = F.transform(last, lambda p: F.struct(
        (p["FYEAR"] - F.col("FYEAR")).cast("double").alias("x"),
        p["YIELD"].cast("double").alias("y"),
    ))
    return F.when(
        size >= window, F.when(F.forall(last, lambda p: p["YIELD"].isNotNull()), points))


def _sum(points: Column, term) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda acc, p: acc + term(p))


def _moments(points: Column) -> Column:
    return F.struct(
        F.size(points).cast("double").alias("n"),
        _sum(points, lambda p: p["x"]).alias("x"),
        _sum(points, lambda p: p["y"]).alias("y"),
        _sum(points, lambda p: p["x"] * p["x"]).alias("xx"),
        _sum(points, lambda p: p["x"] * p["y"]).alias("xy"),
    )


def _line_at(n, x, y, xx, xy, at) -> Column:
    """Least-squares line through points with the given sums, evaluated at `at`."""
    slope = F.try_divide(n * xy - x * y, n * xx - x * x)
    return (y - slope * x) / n + slope * at


def _forecast(m: Column) -> Column:
    return steady_round(_line_at(m["n"], m["x"], m["y"], m["xx"], m["xy"], F.lit(0.0)), 2)


def _left_out(m: Column, p: Column) -> Column:
    """Prediction for a point from all the others: the sums without that point."""
    x, y = p["x"], p["y"]
    return steady_round(
        _line_at(m["n"] - 1, m["x"] - x, m["y"] - y, m["xx"] - x * x, m["xy"] - x * y, x), 2)


def _select_region(df: DataFrame, region: str | None, pred_year: int | None) -> DataFrame:
    if region is not None:
        df = df.filter(F.col("IDREGION") == region)
    if pred_year is not None:
        df = df.filter(F.col("FYEAR") <= pred_year)
    return df


def fixed_window_trend(df: DataFrame, window: int, pred_year: int | None = None,
                       region: str | None = None) -> DataFrame:
    """Lag columns plus YIELD_TREND, the line through the previous `window` rows."""
    frame = _by_year().rowsBetween(-window, -1)
    # years counted from a nearby origin keep the fit well conditioned
    year = F.col("FYEAR") - 2000
    fits = _select_region(df, region, pred_year).select(
        *KEYS, *_lags(window),
        F.regr_slope("YIELD", year).over(frame).alias("_slope"),
        F.regr_intercept("YIELD", year).over(frame).alias("_level"),
    ).filter(_all_yields_known(window))
    if pred_year is not None:
        fits = fits.filter(F.col("FYEAR") == pred_year)
    trend = steady_round(F.col("_level") + F.col("_slope") * year, 2)
    return fits.withColumn("YIELD_TREND", trend).drop("_slope", "_level")


def _with_actual(predicted: DataFrame, df: DataFrame) -> DataFrame:
    actual = df.select(*KEYS, F.col("YIELD").alias("ACTUAL"))
    return predicted.withColumnRenamed("YIELD_TREND", "PREDICTED").join(actual, KEYS)


def fixed_window_query(df: DataFrame, region: str, pred_year: int, window: int) -> DataFrame:
    """Trend of one region and year next to the ACTUAL yield; empty without enough history."""
    return _with_actual(fixed_window_trend(df, window, pred_year, region), df)


def loo_predictions(df: DataFrame, window: int) -> DataFrame:
    """Leave-one-out predictions, one row per left-out position: (keys, ITERATION, YEAR, YTRUE,
    YPRED). Iteration i leaves out the i-th most recent year."""
    scored = (
        df.select(*KEYS, _preceding(window).alias("_past"))
        .select(*KEYS, _points(window).alias("_points"))
        .filter(F.col("_points").isNotNull())
        .withColumn("_m", _moments(F.col("_points")))
        .select(*KEYS, F.posexplode(F.transform("_points", lambda p: F.struct(
            p["x"].alias("x"), p["y"].alias("y"),
            _left_out(F.col("_m"), p).alias("pred"),
        ))).alias("_pos", "_p"))
    )
    return scored.select(
        *KEYS,
        (window - F.col("_pos")).alias("ITERATION"),
        (F.col("FYEAR") + F.col("_p.x")).cast("int").alias("YEAR"),
        F.col("_p.y").alias("YTRUE"),
        F.col("_p.pred").alias("YPRED"),
    )


def window_scores(df: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Per window w: YIELD_TREND<w> and the leave-one-out error CV_RMSE<w>, null when the
    region has too little history for that window."""
    gathered = df.select(*KEYS, _preceding(max(windows)).alias("_past"))
    points = gathered.select(*KEYS, *[_points(w).alias(f"_p{w}") for w in windows])
    fitted = points.withColumns({f"_m{w}": F.when(
        F.col(f"_p{w}").isNotNull(), _moments(F.col(f"_p{w}"))) for w in windows})

    def rmse(w: int) -> Column:
        m = F.col(f"_m{w}")
        total = _sum(F.col(f"_p{w}"), lambda p: F.pow(p["y"] - _left_out(m, p), F.lit(2.0)))
        return steady_round(F.sqrt(total / w), 2)

    return fitted.select(
        *KEYS,
        *[c for w in windows for c in (
            _forecast(F.col(f"_m{w}")).alias(f"YIELD_TREND{w}"),
            rmse(w).alias(f"CV_RMSE{w}"),
        )],
    ).filter(F.col(f"YIELD_TREND{windows[0]}").isNotNull())


def loo_rmse(df: DataFrame, window: int) -> DataFrame:
    return window_scores(df, [window])


def optimal_window_trend(df: DataFrame, windows: Sequence[int], pred_year: int | None = None,
                         region: str | None = None) -> DataFrame:
    """Window with the smallest leave-one-out error per region and year: (keys, OPT_TW,
    YIELD_TREND). Rows exist where the first window fits; ties go to the earlier window."""
    scores = window_scores(_select_region(df, region, pred_year), windows)
    if pred_year is not None:
        scores = scores.filter(F.col("FYEAR") == pred_year)
    ranked = F.filter(
        F.array(*[F.struct(
            F.col(f"CV_RMSE{w}").alias("rmse"), F.lit(i).alias("place"),
            F.lit(w).alias("window"), F.col(f"YIELD_TREND{w}").alias("trend"),
        ) for i, w in enumerate(windows)]),
        lambda s: s["rmse"].isNotNull(),
    )
    best = scores.select(*KEYS, F.array_min(ranked).alias("_best"))
    return best.select(*KEYS, F.col("_best.window").alias("OPT_TW"),
                       F.col("_best.trend").alias("YIELD_TREND"))


def optimal_window_query(df: DataFrame, region: str, pred_year: int,
                         windows: Sequence[int]) -> DataFrame:
    return _with_actual(optimal_window_trend(df, windows, pred_year, region), df)


def optimal_trend_features(df: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Lag columns of the first window plus the trend of the best window."""
    best = optimal_window_trend(df, windows).drop("OPT_TW")
    return lag_columns(df, windows[0]).join(best, KEYS)


def trend_features(yields: DataFrame, windows: Sequence[int], optimal: bool = False) -> DataFrame:
    """Trend features for yields carrying SPLIT: training rows see training yields only, test
    rows see all earlier yields. Previous years are dropped, previous yields kept."""
    def features(df: DataFrame) -> DataFrame:
        if optimal:
            return optimal_trend_features(df, windows)
        return fixed_window_trend(df, windows[0])

    is_test = F.col("SPLIT") == "test"
    train = features(yields.filter(~is_test)).withColumn("SPLIT", F.lit("train"))
    test_keys = yields.filter(is_test).select(*KEYS, "SPLIT").distinct()
    test = features(yields).join(test_keys, KEYS)
    return train.unionByName(test).drop(*lag_names(windows[0])[0])


def trend_rounds(df: DataFrame, window: int, region: str | None = None) -> DataFrame:
    """Rounds from the latest year back: (IDREGION, ROUND, TEST_YEAR, START_YEAR, END_YEAR)."""
    years = _select_region(df, region, None).select(*KEYS).distinct()
    latest_first = Window.partitionBy("IDREGION").orderBy(F.desc("FYEAR"))
    return years.select(
        "IDREGION",
        (F.row_number().over(latest_first) - 1).alias("ROUND"),
        F.col("FYEAR").alias("TEST_YEAR"),
        F.lead("FYEAR", window).over(latest_first).alias("START_YEAR"),
        F.lead("FYEAR", 1).over(latest_first).alias("END_YEAR"),
    ).filter(F.col("START_YEAR").isNotNull())
