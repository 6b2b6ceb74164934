"""Linear models from one pass over the data.

Means, cross products and the label's products per validation group hold everything ridge and
lasso need: a fold's training set is a sum of groups, its validation error a quadratic form. One
Spark job collects a (features+2)^2 matrix per group; every fold, penalty and feature subset is
then small algebra on the driver, instead of a pass over the data each.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATRIX_BYTES = 256 << 20  # of one group, in a task and on the driver


def quoted(names: Iterable[str]) -> list[str]:
    return [f"`{n}`" for n in names]


@dataclass(frozen=True)
class LinearFit:
    """A fitted line: evaluate it on rows as a column expression."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        total = F.lit(self.intercept)
        for name, weight in zip(quoted(self.features), self.weights):
            if weight:
                total = total + F.col(name) * weight
        return total


@dataclass(frozen=True)
class Moments:
    """Sums of products of (1, z, y) per group; z are features shifted and scaled once."""

    features: tuple[str, ...]
    center: np.ndarray
    scale: np.ndarray
    groups: dict
    extremes: dict | None = None  # group -> (least, largest) of the raw features

    def total(self, groups: Iterable | None = None) -> np.ndarray:
        size = len(self.features) + 2
        picked = self.groups.values() if groups is None else (
            self.groups[g] for g in groups if g in self.groups)
        return sum(picked, np.zeros((size, size)))

    def standardisation(self, groups: Iterable | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Mean and population deviation of the raw features over some groups."""
        mean, spread, *_ = _centered(self.total(groups))
        return self.center + mean * self.scale, spread * self.scale

    def scaling(self, groups: Iterable | None = None, scaler: str = "standard"):
        """Center and scale of the raw features over some groups: mean and deviation, or the
        least value and the range ("minmax")."""
        if scaler == "standard":
            return self.standardisation(groups)
        if self.extremes is None:
            raise ValueError("collect_moments(extremes=True) is needed to scale by the range")
        picked = [self.extremes[g] for g in (self.extremes if groups is None else groups)
                  if g in self.extremes]
        if not picked:
            return self.center, np.ones(len(self.features))
        low, high = np.min([e[0] for e in picked], axis=0), np.max([e[1] for e in picked], axis=0)
        return low, np.where(high > low, high - low, 1.0)

    def unit(self, at: Sequence[int], groups: Iterable | None = None, scaler: str = "standard"):
        """What some features are divided by, in z units; None: their own deviation."""
        return None if scaler == "standard" else self.scaling(groups, scaler)[1][at] / self.scale[at]

    def squared_error(self, groups: Iterable, at: Sequence[int], intercept: float,
                      weights: np.ndarray) -> float:
        """Mean squared error of a line in z units over some groups."""
        return squared_error(_subset(self.total(groups), at), intercept, weights)

    def label_variance(self, groups: Iterable) -> float:
        total = self.total(groups)
        n = max(total[0, 0], 1.0)
        return max(float(total[-1, -1] / n - (total[0, -1] / n) ** 2), 0.0)

    def positions(self, names: Sequence[str]) -> list[int]:
        return [self.features.index(n) for n in names]


def collect_moments(df: DataFrame, features: Sequence[str], label: str, group: str,
                    extremes: bool = False) -> Moments:
    """Run the pass: tasks build one partial matrix per group, Spark sums them as vectors.
    `extremes`: also the least and largest value of each feature per group."""
    features = list(features)
    if 8 * (len(features) + 2) ** 2 > MATRIX_BYTES:
        raise ValueError(f"{len(features)} features: the cross products take over {MATRIX_BYTES} bytes")
    rows = df.select(group, *quoted(features), label).na.drop()
    stats = rows.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(quoted(features))],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(quoted(features))],
    ).first()
    d = len(features)
    center = np.array([stats[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(d)])
    upper = np.triu_indices(d + 2)

    def partial_products(batches):
        sums = {}
        for pdf in batches:
            for key, part in pdf.groupby(group):
                z = (part[features].to_numpy(float) - center) / scale
                block = np.column_stack([np.ones(len(z)), z, part[label].to_numpy(float)])
                sums[key] = sums.get(key, 0.0) + block.T @ block
        for key, matrix in sums.items():
            yield pd.DataFrame({"grp": [int(key)], "val": [matrix[upper]]})

    summed = rows.mapInPandas(partial_products, "grp int, val array<double>").groupBy("grp").agg(
        Summarizer.sum(array_to_vector("val")).alias("val")).collect()
    groups = {}
    for r in summed:
        matrix = groups[r["grp"]] = np.zeros((d + 2, d + 2))
        matrix[upper] = r["val"].toArray()
        matrix.T[upper] = matrix[upper]
    ends = None
    if extremes:
        ends = {r[0]: (np.array(r[1:d + 1], float), np.array(r[d + 1:], float)) for r in rows.groupBy(
            F.col(group).cast("int")).agg(*map(F.min, quoted(features)), *map(F.max, quoted(features))
                                          ).collect()}
    return Moments(tuple(features), center, scale, groups, ends)


def _centered(total: np.ndarray):
    n = max(total[0, 0], 1.0)
    mean, label_mean = total[0, 1:-1] / n, total[0, -1] / n
    cov = total[1:-1, 1:-1] - n * np.outer(mean, mean)
    with_label = total[1:-1, -1] - n * mean * label_mean
    spread = np.sqrt(np.clip(np.diag(cov), 0, None) / n)
    spread[spread < 1e-12] = 1.0
    return mean, spread, cov, with_label, label_mean, n


def _subset(total: np.ndarray, positions: Sequence[int]) -> np.ndarray:
    keep = [0, *[p + 1 for p in positions], total.shape[0] - 1]
    return total[np.ix_(keep, keep)]


def ridge_weights(total: np.ndarray, alpha: float, unit: np.ndarray | None = None):
    """(intercept, weights) in z units of  |y - Xb|^2 + alpha |b|^2.

    X is standardised over the same rows, or divided by `unit` (None: standardise).
    """
    mean, spread, cov, with_label, label_mean, _ = _centered(total)
    unit = spread if unit is None else unit
    b = np.linalg.solve(cov / np.outer(unit, unit) + alpha * np.eye(len(unit)), with_label / unit)
    w = b / unit
    return label_mean - w @ mean, w


def lasso_weights(total: np.ndarray, alpha: float, unit: np.ndarray | None = None):
    """Coefficients of  |y - Xb|^2 / 2n + alpha |b|_1,  X scaled as in ridge_weights.

    An active set: the feature whose gradient exceeds the penalty most enters, the coefficients of
    all that are in are solved for with their signs held, and one that would change its sign
    leaves where it is zero. A feature that others in the set make up takes the place of one of
    them. Every step lowers the objective, so it ends at the exact solution after finitely many.
    """
    mean, spread, cov, with_label, _, n = _centered(total)
    unit = spread if unit is None else unit
    gram, target = cov / np.outer(unit, unit) / n, with_label / unit / n
    d = len(target)
    b, sign, active = np.zeros(d), np.zeros(d), []
    usable = np.diag(gram) > 1e-14 * max(np.diag(gram).max(initial=0.0), 1e-300)
    least = alpha + 1e-12 * np.abs(target).max(initial=0.0)

    def leave(step, move):
        """Go along `move` until a coefficient is zero, at most `step`; whether one was."""
        falls = [(b[i] / -m, i) for i, m in zip(active, move) if m * sign[i] < 0]
        stop, out = min(falls, default=(np.inf, None))
        if stop > step:
            return False
        b[active] += stop * np.asarray(move)
        b[out] = sign[out] = 0.0
        active.remove(out)
        return True

    for _ in range(100 * (d + 1)):
        slope = target - gram @ b
        outside = [j for j in range(d) if usable[j] and j not in active]
        enter = max(outside, key=lambda j: abs(slope[j]), default=None)
        if enter is None or abs(slope[enter]) <= least:
            return b
        sign[enter] = np.sign(slope[enter])
        made_up = np.linalg.solve(gram[np.ix_(active, active)], gram[active, enter])
        rest = gram[enter, enter] - gram[enter, active] @ made_up
        active.append(enter)
        if rest <= 1e-10 * gram[enter, enter]:  # the fit stays, the sum of coefficients falls
            if not leave(np.inf, sign[enter] * np.append(-made_up, 1.0)):
                break
        while active:
            goal = np.linalg.solve(gram[np.ix_(active, active)], target[active] - alpha * sign[active])
            if not leave(1.0, goal - b[active]):
                b[active] = goal
                break
    raise ArithmeticError("lasso: no solution, features too close to multiples of each other")


def squared_error(total: np.ndarray, intercept: float, weights: np.ndarray) -> float:
    """Mean squared error of a line on the rows behind `total`."""
    v = np.concatenate([[-intercept], -weights, [1.0]])
    return float(v @ total @ v / max(total[0, 0], 1.0))


def ridge_fit(moments: Moments, alpha: float, features: Sequence[str] | None = None,
              groups: Iterable | None = None, standardise: bool = True,
              scaler: str = "standard") -> LinearFit:
    names = list(features or moments.features)
    at = moments.positions(names)
    total = _subset(moments.total(groups), at)
    unit = moments.unit(at, groups, scaler) if standardise else 1 / moments.scale[at]
    intercept, w = ridge_weights(total, alpha, unit)
    raw = w / moments.scale[at]
    return LinearFit(tuple(names), tuple(map(float, raw)),
                     float(intercept - raw @ moments.center[at]))


def ridge_cv_lines(moments: Moments, alphas: Sequence[float], folds, subsets,
                   standardise: bool = True, scaler: str = "standard") -> list:
    """(valid groups, positions, intercept, weights in z units) per fold and penalty."""
    lines = []
    for (train, valid), names in zip(folds, subsets):
        at, total = moments.positions(names), moments.total(train)
        unit = moments.unit(at, train, scaler) if standardise else 1 / moments.scale[at]
        lines += [(valid, at, *ridge_weights(_subset(total, at), a, unit)) for a in alphas]
    return lines


def ridge_cv_error(moments: Moments, alpha: float, folds, subsets,
                   standardise: bool = True, scaler: str = "standard") -> float:
    """Mean squared validation error over folds; `subsets` gives each fold's features."""
    return float(np.mean([
        moments.squared_error(*line) for line in
        ridge_cv_lines(moments, [alpha], folds, subsets, standardise, scaler)]))


def absolute_errors(df: DataFrame, moments: Moments, lines: Sequence, label: str,
                    group: str) -> list[float]:
    """Mean absolute error of every line on its validation groups, all in one pass over the rows.

    Unlike squares, absolute errors do not follow from sums of products. A task multiplies the rows
    of a group by all lines that are validated there and returns one sum a line.
    """
    features, d = list(moments.features), len(moments.features)
    table = np.zeros((len(lines), d + 1))
    for row, (_, at, intercept, weights) in zip(table, lines):
        row[0], row[[p + 1 for p in at]] = intercept, weights
    of_group = {}
    for i, (valid, *_) in enumerate(lines):
        for g in valid:
            of_group.setdefault(int(g), []).append(i)
    center, scale = moments.center, moments.scale

    def score(batches):
        sums, rows = np.zeros(len(table)), np.zeros(len(table), np.int64)
        for pdf in batches:
            for key, part in pdf.groupby(group):
                mine = of_group.get(int(key), [])
                z = (part[features].to_numpy(float) - center) / scale
                guess = np.column_stack([np.ones(len(z)), z]) @ table[mine].T
                sums[mine] += np.abs(part[label].to_numpy(float)[:, None] - guess).sum(axis=0)
                rows[mine] += len(part)
        yield pd.DataFrame({"line": np.arange(len(table)), "total": sums, "n": rows})

    found = df.select(group, *quoted(features), label).na.drop().mapInPandas(
        score, "line int, total double, n long").groupBy("line").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    means = {r["line"]: r["total"] / r["n"] if r["n"] else np.nan for r in found}
    return [means.get(i, np.nan) for i in range(len(lines))]


def lasso_elimination(moments: Moments, sizes: Sequence[int], alpha: float = 0.1,
                      groups: Iterable | None = None, scaler: str = "standard"
                      ) -> dict[int, list[str]]:
    """Recursive elimination: refit lasso and drop the smallest coefficient until each size.

    Features with a zero coefficient go first, in order; dropping one cannot change the fit.
    """
    total = moments.total(groups)
    left, kept = list(range(len(moments.features))), {}
    unit = moments.unit(left, groups, scaler)

    def fit():
        return lasso_weights(_subset(total, left), alpha, None if unit is None else unit[left])
    b = fit()
    while True:
        if len(left) in sizes:
            kept[len(left)] = [moments.features[i] for i in left]
        if len(left) <= min(sizes):
            return kept
        drop = int(np.argmin(np.abs(b)))
        refit = b[drop] != 0
        left.pop(drop)
        b = fit() if refit else np.delete(b, drop)
