"""Estimators, feature selection and prediction over a table of regional yearly features.

Ridge and the lasso selector come out of one pass of cross products, nearest neighbours out of a
block join, boosted trees out of one job for all folds and depths, forests from `pyspark.ml`. The
driver only keeps scores, names and fitted trees.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product
from statistics import median

from pyspark import inheritable_thread_target
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import steady_round
from ..storage import cut
from .boosting import Boosted, Boosting, Task, fit_many
from .metrics import exact_median
from .moments import (
    Moments, absolute_errors, collect_moments, lasso_elimination, quoted, ridge_cv_error,
    ridge_cv_lines, ridge_fit,
)
from .neighbours import Search, search_all, weighted, with_knn
from .splits import contiguous_folds, sliding_folds
from .univariate import best_features

IDS = ("IDREGION", "FYEAR")
SCALERS = ("standard", "minmax")

#: What cross-validation minimises, from a fold's mean squared and absolute error and the variance
#: of its labels. "R2" is 1 - R²; without variance it is 0 where all is met and 1 otherwise.
OBJECTIVES = {
    "MSE": lambda squared, absolute, variance: squared,
    "RMSE": lambda squared, absolute, variance: squared ** 0.5,
    "MAE": lambda squared, absolute, variance: absolute,
    "R2": lambda squared, absolute, variance: squared / variance if variance > 0 else float(squared > 0),
}


@dataclass(frozen=True)
class EstimatorSpec:
    """Name, kind (ridge, knn or gbdt), and the parameter grids for selection and training."""

    name: str
    kind: str
    selection_grid: tuple[dict, ...]
    grid: tuple[dict, ...]


# Default estimators and their grids.
DEFAULT_ESTIMATORS = (
    EstimatorSpec("Ridge", "ridge", ({"alpha": 0.1},),
                  tuple({"alpha": a} for a in (1e-5, 1e-2, 1e-1, 0.5, 1, 5, 10))),
    EstimatorSpec("KNN", "knn", ({"k": 5},), tuple({"k": k} for k in (3, 5, 7, 9))),
    EstimatorSpec("GBDT", "gbdt", ({"max_depth": 5, "trees": 100},),
                  tuple({"max_depth": d, "trees": t} for d, t in product((5, 10, 15), (100, 500)))),
)
# Penalties tried for the trend model, and for the lasso of the selector.
TREND_ALPHAS = (1e-3, 1e-2, 1e-1, 1, 10)
LASSO_ALPHA = 0.1
SEED = 42


def standard_scaler(features: Sequence[str]) -> list:
    """pyspark.ml stages for zero mean and unit (sample) deviation: columns -> `scaled`."""
    return [VectorAssembler(inputCols=list(features), outputCol="assembled"),
            StandardScaler(withMean=True, inputCol="assembled", outputCol="scaled")]


def population_scaled(df: DataFrame, features: Sequence[str], stats: DataFrame) -> DataFrame:
    """Scale by a one-row table of `mean_<f>` and `std_<f>` (population deviation)."""
    row = stats.first()
    return df.withColumns({
        f: (F.col(f"`{f}`") - row[f"mean_{f}"]) / (row[f"std_{f}"] or 1.0) for f in features})


def scaling_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.agg(*[e for f in features for e in (
        F.avg(f"`{f}`").alias(f"mean_{f}"), F.stddev_pop(f"`{f}`").alias(f"std_{f}"))])


def forest(**params) -> RandomForestRegressor:
    return RandomForestRegressor(**{
        "featuresCol": "_x", "labelCol": "YIELD", "numTrees": 100, "maxDepth": 5,
        "minInstancesPerNode": 5, "seed": SEED, **params})


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(
        inputCols=list(features), outputCol="_x", handleInvalid="keep").transform(df)


@dataclass(frozen=True)
class TrainingSet:
    """Training rows with their validation groups and cross products, shared by everything."""

    df: DataFrame
    features: tuple[str, ...]
    label: str
    group: str
    folds: tuple[tuple[tuple, tuple], ...]
    moments: Moments
    parallelism: int = 4
    ids: tuple[str, ...] = IDS
    picks: dict = field(default_factory=dict)
    scaler: str = "standard"

    def fold_means(self, objective: str, errors: Sequence[tuple[float, float]]) -> float:
        """Mean over folds of the objective, from each fold's (squared, absolute) error."""
        measure = OBJECTIVES[objective]
        return sum(measure(*e, self.moments.label_variance(valid))
                   for e, (_, valid) in zip(errors, self.folds)) / len(self.folds)

    def rows(self, groups) -> DataFrame:
        return self.df if groups is None else self.df.filter(F.col(self.group).isin(list(groups)))

    def in_parallel(self, jobs: Sequence[Callable]) -> list:
        """Run Spark jobs from a few driver threads so small stages overlap."""
        with ThreadPoolExecutor(self.parallelism) as pool:
            spark = self.df.sparkSession
            return [f.result() for f in [
                pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def training_set(train: DataFrame, features: Sequence[str], label: str = "YIELD", k: int = 5,
                 time_ordered: bool = False, parallelism: int = 4,
                 scaler: str = "standard") -> TrainingSet:
    """Assign validation folds (sliding years when time-ordered, else contiguous blocks),
    materialise the rows once and collect their cross products."""
    if scaler not in SCALERS:
        raise ValueError(f"unknown scaler {scaler!r}")
    if time_ordered:
        group = "FYEAR"
        rows = cut(train)
        plan = {}
        for r in sliding_folds(rows, k).collect():  # years x folds, a small table
            plan.setdefault(r["FOLD"], {"train": [], "test": []})[r["ROLE"]].append(r["FYEAR"])
        folds = tuple((tuple(p["train"]), tuple(p["test"])) for _, p in sorted(plan.items()))
    else:
        group = "FOLD"
        rows = cut(contiguous_folds(train, k))
        folds = tuple((tuple(g for g in range(k) if g != j), (j,)) for j in range(k))
    if not folds:
        raise ValueError(f"too few years for {k} time-ordered folds")
    moments = collect_moments(rows, features, label, group, extremes=scaler == "minmax")
    return TrainingSet(rows, tuple(features), label, group, folds, moments, parallelism,
                       scaler=scaler)


def cv_errors(ts: TrainingSet, spec: EstimatorSpec, grid: Sequence[dict],
              subsets: Sequence[Sequence[str]], objective: str = "MSE") -> list[float]:
    """Mean validation error per parameter set; `subsets` holds each fold's features."""
    return cv_errors_each(ts, spec, grid, [subsets], objective)[0]


def cv_errors_each(ts: TrainingSet, spec: EstimatorSpec, grid: Sequence[dict],
                   choices: Sequence[Sequence[Sequence[str]]], objective: str = "MSE"
                   ) -> list[list[float]]:
    """The same for several choices of every fold's features. OBJECTIVES has the errors known."""
    if objective not in OBJECTIVES:
        raise ValueError(f"unknown objective {objective!r}")
    if spec.kind == "ridge":
        return ridge_cv_errors(ts, grid, choices, objective)
    if spec.kind == "gbdt":
        return boosted_cv_errors_each(ts, grid, choices, objective=objective)
    return knn_cv_errors(ts, grid, choices, objective)


def ridge_cv_errors(ts: TrainingSet, grid: Sequence[dict],
                    choices: Sequence[Sequence[Sequence[str]]], objective: str = "MSE"
                    ) -> list[list[float]]:
    """Squared errors follow from the cross products; absolute ones of all choices, folds and
    penalties take one pass over the rows."""
    alphas = [p["alpha"] for p in grid]
    if objective == "MSE":
        return [[ridge_cv_error(ts.moments, a, ts.folds, subsets, scaler=ts.scaler)
                 for a in alphas] for subsets in choices]
    lines = [ridge_cv_lines(ts.moments, alphas, ts.folds, subsets, scaler=ts.scaler)
             for subsets in choices]
    absolute = iter(absolute_errors(
        ts.df, ts.moments, [x for own in lines for x in own], ts.label, ts.group)
        if objective == "MAE" else [float("nan")] * sum(map(len, lines)))
    out = []
    for own in lines:
        errors = [(ts.moments.squared_error(*line), next(absolute)) for line in own]
        out.append([ts.fold_means(objective, errors[i::len(grid)]) for i in range(len(grid))])
    return out


def knn_cv_errors(ts: TrainingSet, grid: Sequence[dict],
                  choices: Sequence[Sequence[Sequence[str]]], objective: str = "MSE"
                  ) -> list[list[float]]:
    """All folds, choices of features and k in one run of searches for the largest k."""
    searches = []
    for subsets in choices:
        for (train, valid), names in zip(ts.folds, subsets):
            center, scale = ts.moments.scaling(train, ts.scaler)
            at = ts.moments.positions(names)
            searches.append(Search(tuple(names), center[at], scale[at], *(
                F.col(ts.group).isin(list(groups)) for groups in (train, valid))))
    ks = sorted({p["k"] for p in grid})
    found = search_all(ts.df, ts.df, searches, ts.label, ts.ids, ks[-1]).groupBy("no", "qid").agg(
        *map(weighted, ks))
    truth = ts.df.select(F.to_json(F.struct(*ts.ids)).alias("qid"), ts.label)
    wrong = {k: F.col(f"K{k}") - F.col(ts.label) for k in ks}
    errors = {r["no"]: r for r in found.join(truth, "qid").groupBy("no").agg(
        *[F.avg(F.pow(wrong[k], F.lit(2.0))).alias(f"S{k}") for k in ks],
        *[F.avg(F.abs(wrong[k])).alias(f"A{k}") for k in ks]).collect()}
    n = len(ts.folds)
    return [[ts.fold_means(objective, [
        (errors[i * n + j][f"S{p['k']}"], errors[i * n + j][f"A{p['k']}"]) for j in range(n)])
        for p in grid] for i in range(len(choices))]


def boosted_cv_errors(ts: TrainingSet, grid: Sequence[dict], subsets: Sequence[Sequence[str]],
                      settings: Boosting = Boosting()) -> list[float]:
    return boosted_cv_errors_each(ts, grid, [subsets], settings)[0]


def boosted_cv_errors_each(ts: TrainingSet, grid: Sequence[dict],
                           choices: Sequence[Sequence[Sequence[str]]],
                           settings: Boosting = Boosting(), objective: str = "MSE"
                           ) -> list[list[float]]:
    """All folds, choices of features and parameters from one job: a model per choice, fold and
    depth, with the most trees; fewer trees are its beginning."""
    sizes: dict[int, set[int]] = {}
    for p in grid:
        sizes.setdefault(p["max_depth"], set()).add(p["trees"])
    wanted = [(i, Task(tuple(ts.moments.positions(names)), depth, tuple(sorted(trees)), train, valid))
              for i, subsets in enumerate(choices) for depth, trees in sizes.items()
              for (train, valid), names in zip(ts.folds, subsets)]
    fits = fit_many(ts.df, ts.features, ts.label, ts.group, [task for _, task in wanted], ts.ids,
                    settings, with_trees=False)
    errors = {}
    for (i, task), fit in zip(wanted, fits):
        for trees, (squared, absolute, _) in zip(task.stages, fit.errors):
            errors.setdefault((i, task.depth, trees), []).append((squared, absolute))
    return [[ts.fold_means(objective, errors[i, p["max_depth"], p["trees"]]) for p in grid]
            for i in range(len(choices))]


def boosted_fit(ts: TrainingSet, params: dict, names: Sequence[str],
                settings: Boosting = Boosting()) -> Boosted:
    """Boosted trees on all training rows."""
    task = Task(tuple(ts.moments.positions(names)), params["max_depth"], (params["trees"],))
    return fit_many(ts.df, ts.features, ts.label, ts.group, [task], ts.ids, settings)[0]


def selection_sizes(n_features: int, trend: bool = False) -> list[int]:
    """Numbers of features tried, as far as there are more than that."""
    sizes = [min(10, n_features)] + [s for s in (15, 20) if n_features > s]
    return sizes + ([25] if trend and n_features > 25 else [])


def forest_picks(importances: Sequence[float], features: Sequence[str],
                 sizes: Sequence[int]) -> dict[int, list[str]]:
    """Features at or above the median importance, at most `size`, the most important first."""
    floor = median(importances)
    ranked = sorted((-v, i) for i, v in enumerate(importances) if v >= floor)
    return {s: [features[i] for i in sorted(i for _, i in ranked[:s])] for s in sizes}


def _picks(ts: TrainingSet, selector: str, sizes: Sequence[int], groups) -> dict[int, list[str]]:
    if selector == "rfe_lasso":
        return lasso_elimination(ts.moments, sizes, LASSO_ALPHA, groups, ts.scaler)
    if selector == "mutual_info":
        return best_features(ts.rows(groups), ts.features, ts.label, sizes)
    model = forest(labelCol=ts.label).fit(_assembled(ts.rows(groups), ts.features))
    return forest_picks(list(model.featureImportances.toArray()), ts.features, sizes)


def selector_picks(ts: TrainingSet, selector: str, sizes: Sequence[int]) -> list[dict]:
    """Picks per fold and, last, on all training rows. Kept: estimators share them."""
    key = (selector, tuple(sizes))
    if key not in ts.picks:
        if selector not in ("random_forest", "rfe_lasso", "mutual_info"):
            raise ValueError(f"unknown selector {selector!r}")
        samples = [train for train, _ in ts.folds] + [None]
        ts.picks[key] = ts.in_parallel([
            lambda g=g: _picks(ts, selector, sizes, g) for g in samples])
    return ts.picks[key]


@dataclass(frozen=True)
class Selection:
    features: list[str]
    scores: dict[str, float]  # selector or 'combined' -> negative error


def select_features(ts: TrainingSet, spec: EstimatorSpec,
                    selectors: Sequence[str] = ("random_forest", "rfe_lasso"),
                    trend: bool = False, objective: str = "MSE") -> Selection:
    """Best size per selector by cross-validation, then the union of all selectors' features
    unless the best single selector scores higher."""
    sizes = selection_sizes(len(ts.features), trend)
    chosen, scores = {}, {}
    picks = [selector_picks(ts, selector, sizes) for selector in selectors]
    errors = cv_errors_each(ts, spec, spec.selection_grid, [
        [p[s] for p in by_fold] for *by_fold, _ in picks for s in sizes], objective)
    for n, (selector, (*_, overall)) in enumerate(zip(selectors, picks)):
        own = errors[n * len(sizes):(n + 1) * len(sizes)]
        best, _, size = min((min(e), i, s) for i, (e, s) in enumerate(zip(own, sizes)))
        scores[selector], chosen[selector] = -best, overall[size]
    union = [f for f in ts.features if any(f in names for names in chosen.values())]
    scores["combined"] = -min(
        cv_errors(ts, spec, spec.selection_grid, [union] * len(ts.folds), objective))
    winner = max(selectors, key=lambda s: scores[s])
    names = chosen[winner] if scores["combined"] < scores[winner] else union
    return Selection(names, scores)


@dataclass(frozen=True)
class Fitted:
    """A trained estimator; `predict` adds its prediction column to any rows."""

    spec: EstimatorSpec
    params: dict
    features: list[str]
    predict: Callable[[DataFrame, str], DataFrame]


def grid_fit(ts: TrainingSet, spec: EstimatorSpec, features: Sequence[str],
             grid: Sequence[dict] | None = None, objective: str = "MSE") -> Fitted:
    """Choose parameters by cross-validation and refit on all training rows."""
    grid, names = list(grid or spec.grid), list(features)
    errors = cv_errors(ts, spec, grid, [names] * len(ts.folds), objective)
    params = grid[errors.index(min(errors))]
    return Fitted(spec, params, names, _predictor(ts, spec, params, names))


def _predictor(ts: TrainingSet, spec: EstimatorSpec, params: dict, names: list[str]):
    if spec.kind == "ridge":
        line = ridge_fit(ts.moments, params["alpha"], names, scaler=ts.scaler)
        return lambda df, output: df.withColumn(output, line.column())
    if spec.kind == "knn":
        center, scale = ts.moments.scaling(None, ts.scaler)
        at = ts.moments.positions(names)
        return lambda df, output: with_knn(
            df, ts.df, names, ts.label, ts.ids, params["k"], center[at], scale[at], output)
    model = boosted_fit(ts, params, names)
    return lambda df, output: df.withColumn(output, model.column())


def detrend(df: DataFrame, lag_features: Sequence[str], k: int = 5,
            label: str = "YIELD") -> DataFrame:
    """Trend from the previous yields by ridge, tuned on time-ordered folds: adds YIELD_TREND
    (for all rows) and YIELD_RES, the yield without it."""
    train = df.filter(F.col("SPLIT") == "train").select(
        *IDS, label, *quoted(lag_features))
    ts = training_set(train, lag_features, label, k, time_ordered=True)
    subsets = [list(lag_features)] * len(ts.folds)
    errors = [ridge_cv_error(ts.moments, a, ts.folds, subsets, standardise=False)
              for a in TREND_ALPHAS]
    line = ridge_fit(ts.moments, TREND_ALPHAS[errors.index(min(errors))], standardise=False)
    return df.withColumn("YIELD_TREND", line.column()).withColumn(
        "YIELD_RES", F.col(label) - F.col("YIELD_TREND"))


def restore_trend(df: DataFrame, algorithms: Sequence[str]) -> DataFrame:
    """Residual predictions move to `YIELD_RES_PRED_<alg>`; adding the trend gives yields."""
    columns = {}
    for a in algorithms:
        columns[f"YIELD_RES_PRED_{a}"] = F.col(f"YIELD_PRED_{a}")
        columns[f"YIELD_PRED_{a}"] = F.col(f"YIELD_PRED_{a}") + F.col("YIELD_TREND")
    return df.withColumns(columns)


def null_stats(train: DataFrame, label: str = "YIELD") -> DataFrame:
    """One row: MIN, MAX, MEAN and MEDIAN of the training label, rounded to 2."""
    table = train.agg(
        *[steady_round(e, 2).alias(n) for n, e in (
            ("MIN", F.min(label)), ("MAX", F.max(label)), ("MEAN", F.avg(label)))])
    middle = exact_median(train, label).select(steady_round("MEDIAN", 2)).scalar()
    return table.withColumn("MEDIAN", middle)


def null_model(df: DataFrame, trend: bool = False, label: str = "YIELD") -> DataFrame:
    """Baseline predictions as rows (ids, SPLIT, ALG, YIELD_PRED, YIELD): the yield trend, or
    the rounded mean of the training yields."""
    if trend:
        name, pred = "trend", F.col("YIELD_TREND")
    else:
        mean = df.filter(F.col("SPLIT") == "train").agg(steady_round(F.avg(label), 2)).scalar()
        name, pred = "average", mean
    return df.select(*IDS, "SPLIT", F.lit(name).alias("ALG"), pred.alias("YIELD_PRED"), label)


def feature_period(feature: Column | str) -> Column:
    """Period a feature name belongs to: the last of p0..p5 it contains, else 'static'."""
    name = F.col(feature) if isinstance(feature, str) else feature
    return F.coalesce(
        *[F.when(F.contains(name, F.lit(p)), p) for p in ("p5", "p4", "p3", "p2", "p1", "p0")],
        F.lit("static"))


def selected_frequency(picks: DataFrame) -> DataFrame:
    """How many estimators picked each feature: (PERIOD, FEATURE, N) from (ALG, FEATURE)."""
    return picks.groupBy(feature_period("FEATURE").alias("PERIOD"), "FEATURE").agg(
        F.count(F.lit(1)).alias("N"))
