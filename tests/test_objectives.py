"""Objectives, scalers, the lasso's active set and the univariate selector, against plain versions."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from seasonframe import RunConfig
from seasonframe.operators import models, moments
from seasonframe.operators.models import EstimatorSpec
from seasonframe.operators.univariate import best_features, mutual_information

FEATURES = ["a", "b c", "d"]
SCHEMA = "IDREGION string, FYEAR int, a double, `b c` double, d double, YIELD double"
PLAIN = {
    "MSE": lambda e, y: np.mean(e**2),
    "RMSE": lambda e, y: np.sqrt(np.mean(e**2)),
    "MAE": lambda e, y: np.mean(np.abs(e)),
    "R2": lambda e, y: np.mean(e**2) / np.var(y),
}


@pytest.fixture(scope="module")
def problem(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 3)) * [1, 20, 0.1] + [5, 300, 0]
    y = 2 * x[:, 0] + 0.1 * x[:, 1] + rng.normal(0, 1, 60)
    df = spark.createDataFrame(
        [(f"R{i // 12}", 2000 + i % 12, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
        SCHEMA)
    return df, x, y


def scaling(x, scaler):
    return (x.mean(0), x.std(0)) if scaler == "standard" else (x.min(0), np.ptp(x, axis=0))


def ridge(x, y, alpha, scaler):
    unit = scaling(x, scaler)[1]
    z = (x - x.mean(0)) / unit
    b = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return lambda q: y.mean() + (q - x.mean(0)) / unit @ b


def nearest(x, y, k, scaler):
    center, unit = scaling(x, scaler)

    def predict(q):
        out = []
        for row in (q - center) / unit:
            far = np.sqrt((((x - center) / unit - row) ** 2).sum(1))
            near = far.argsort(kind="stable")[:k]
            out.append((y[near] / far[near]).sum() / (1 / far[near]).sum())
        return np.array(out)
    return predict


@pytest.mark.parametrize("scaler", ["standard", "minmax"])
def test_objectives_match_refits(problem, scaler):
    df, x, y = problem
    ts = models.training_set(df, FEATURES, k=4, scaler=scaler)
    fold = np.repeat(np.arange(4), 15)
    for spec, grid, fit in (
            (EstimatorSpec("Ridge", "ridge", (), ()), [{"alpha": 0.1}, {"alpha": 7.0}],
             lambda p, *at: ridge(*at, p["alpha"], scaler)),
            (EstimatorSpec("KNN", "knn", (), ()), [{"k": 3}, {"k": 5}],
             lambda p, *at: nearest(*at, p["k"], scaler))):
        for objective, measure in PLAIN.items():
            got = models.cv_errors_each(ts, spec, grid, [[FEATURES] * 4, [FEATURES[:2]] * 4], objective)
            for own, d in zip(got, (3, 2)):
                want = [np.mean([measure(
                    fit(p, x[fold != j][:, :d], y[fold != j])(x[fold == j][:, :d]) - y[fold == j],
                    y[fold == j]) for j in range(4)]) for p in grid]
                assert own == pytest.approx(want, rel=1e-8), (spec.name, objective)


def test_boosting_objectives_follow_from_its_errors(problem):
    df, _, _ = problem
    ts = models.training_set(df, FEATURES, k=3)
    spec = EstimatorSpec("GBDT", "gbdt", (), ())
    grid = [{"max_depth": 2, "trees": t} for t in (5, 20)]
    got = {o: models.cv_errors(ts, spec, grid, [FEATURES] * 3, o) for o in models.OBJECTIVES}
    assert all(m <= r + 1e-12 for m, r in zip(got["MAE"], got["RMSE"]))
    assert all(r * r <= s + 1e-12 for r, s in zip(got["RMSE"], got["MSE"]))
    assert got["MSE"][1] < got["MSE"][0] and got["R2"][1] < got["R2"][0]


def test_minmax_prediction_and_selection(problem):
    df, x, y = problem
    ts = models.training_set(df, FEATURES, k=4, scaler="minmax")
    spec = EstimatorSpec("Ridge", "ridge", ({"alpha": 0.1},), ({"alpha": 0.5},))
    picked = models.select_features(ts, spec, ("rfe_lasso", "mutual_info"), objective="MAE")
    assert set(picked.features) <= set(FEATURES) and set(picked.scores) == {
        "rfe_lasso", "mutual_info", "combined"}
    line = models.grid_fit(ts, spec, FEATURES, objective="R2").predict(df, "guess")
    got = [r["guess"] for r in line.orderBy("IDREGION", "FYEAR").collect()]
    assert got == pytest.approx(list(ridge(x, y, 0.5, "minmax")(x)), rel=1e-9)


def test_unknown_names_raise(problem):
    df, _, _ = problem
    with pytest.raises(ValueError):
        models.training_set(df, FEATURES, scaler="rank")
    ts = models.training_set(df, FEATURES, k=3)
    with pytest.raises(ValueError):
        models.cv_errors(ts, models.DEFAULT_ESTIMATORS[0], [{"alpha": 1}], [FEATURES] * 3, "NMAE")
    with pytest.raises(ValueError):
        ts.moments.scaling(None, "minmax")
    for wrong in ({"scaler": "rank"}, {"training_objective": "x"}, {"selection_objective": "mse"}):
        with pytest.raises(ValueError):
            RunConfig(**wrong)


def total_of(x, y):
    block = np.column_stack([np.ones(len(x)), x, y])
    return block.T @ block


def lasso_cost(x, y, b, alpha):
    z = (x - x.mean(0)) / np.where(x.std(0) < 1e-12, 1, x.std(0))
    return np.sum((y - y.mean() - z @ b) ** 2) / 2 / len(y) + alpha * np.abs(b).sum()


def lasso_by_signs(x, y, alpha):
    """The least cost over the stationary points of all patterns of signs."""
    z, n = (x - x.mean(0)) / x.std(0), len(y)
    gram, target, found = z.T @ z / n, z.T @ (y - y.mean()) / n, []
    for signs in itertools.product((-1, 0, 1), repeat=x.shape[1]):
        at, b = [i for i, s in enumerate(signs) if s], np.zeros(x.shape[1])
        b[at] = np.linalg.solve(gram[np.ix_(at, at)], target[at] - alpha * np.array(signs)[at])
        found.append((lasso_cost(x, y, b, alpha), tuple(b)))
    return np.array(min(found)[1])


@pytest.mark.parametrize("seed", range(12))
def test_lasso_is_the_best_of_all_sign_patterns(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, 4)) @ rng.normal(size=(4, 4))  # correlated
    y = x @ rng.normal(size=4) + rng.normal(size=40)
    for alpha in (0.0, 0.01, 0.2, 1.0, 50.0):
        got = moments.lasso_weights(total_of(x, y), alpha)
        assert got == pytest.approx(lasso_by_signs(x, y, alpha), abs=1e-7)


@pytest.mark.parametrize("seed", range(8))
def test_lasso_with_repeated_mixed_and_constant_columns(seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(50, 3))
    x = np.column_stack([base, base[:, 0], base[:, 1] + base[:, 2], np.ones(50), -base[:, 2]])
    y = base @ [2.0, -1.0, 0.5] + rng.normal(size=50)
    for alpha in (0.01, 0.3):
        got = moments.lasso_weights(total_of(x, y), alpha)
        assert got[5] == 0
        z = (x - x.mean(0)) / np.where(x.std(0) < 1e-12, 1, x.std(0))
        slope = z.T @ (y - y.mean() - z @ got) / len(y)
        assert np.all(np.abs(slope) <= alpha + 1e-8)  # optimal: the gradient is within the penalty
        assert np.all(np.abs(slope - alpha * np.sign(got))[got != 0] < 1e-8)


def test_lasso_takes_many_features_and_wide_tables():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 60))  # more features than rows
    y = x[:, 0] - x[:, 1] + rng.normal(size=30)
    got = moments.lasso_weights(total_of(x, y), 0.05)
    z = (x - x.mean(0)) / x.std(0)
    slope = z.T @ (y - y.mean() - z @ got) / len(y)
    assert np.all(np.abs(slope) <= 0.05 + 1e-8) and 0 < np.count_nonzero(got) < 30


def plain_information(pairs, bins):
    pairs = [(a, b) for a, b in pairs if a is not None]
    if not pairs:
        return None
    n, of = len(pairs), Counter(pairs)
    left, right = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    return sum(c / n * math.log(c * n / left[a] / right[b]) for (a, b), c in of.items())


def test_information_matches_plain_counts(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=300)
    cols = {"near": y + rng.normal(0, 0.2, 300), "far": rng.normal(size=300), "flat": np.ones(300)}
    data = [(None if i % 7 == 0 else float(cols["near"][i]), float(cols["far"][i]), 1.0, None,
             None if i % 50 == 3 else float(y[i]), "x") for i in range(300)]
    df = spark.createDataFrame(
        data, "near double, `fa.r` double, flat double, none double, YIELD double, y string")
    names = ["near", "fa.r", "flat", "none"]
    got = {r["FEATURE"]: (r["MI"], r["N"]) for r in mutual_information(df, names, "YIELD", 5).collect()}
    known = [r for r in data if r[4] is not None]

    def binned(values):
        inner = [v for v in values if v is not None]
        low, high = (min(inner), max(inner)) if inner else (0, 0)
        return [None if v is None else 0 if high == low else
                min(int((v - low) / (high - low) * 5), 4) for v in values]
    label = binned([r[4] for r in known])
    for i, name in enumerate(names):
        pairs = list(zip(binned([r[i] for r in known]), label))
        want = plain_information(pairs, 5)
        assert got[name][1] == sum(a is not None for a, _ in pairs)
        assert got[name][0] == (None if want is None else pytest.approx(want, abs=1e-12))
    assert best_features(df, names, "YIELD", [1, 2], 5) == {1: ["near"], 2: ["near", "fa.r"]}
    empty = mutual_information(df.limit(0), names, "YIELD").collect()
    assert {(r["MI"], r["N"]) for r in empty} == {(None, 0)} and len(empty) == 4
