"""Gradient boosted trees on binned features, many models in one job.

Rows stay where they are: every task holds a part of them, binned, and for each level of a tree the
tasks add up their histograms, after which all of them know the same splits. Models (folds, depths,
subsets of features) advance together, so that a level of all of them is one exchange. Rows that
fit one task need no exchange, and there models are dealt to tasks instead. Either way a model is
fitted by the same code, written as a generator that hands out what has to be added up over tasks.

With the Huber loss the threshold is an exact quantile of the absolute residuals, found anew for
every tree, and a leaf's value the median of its residuals plus the mean of what is beyond it,
clipped. Quantiles over tasks are exact too: counts per digit of their binary form narrow them down.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 255
ROWS_PER_TASK = 200_000
CELLS = 1 << 20  # histogram cells added up at a time
DIGIT, LONG_DIGIT = 11, 16  # bits; for many quantiles at a time and for one


@dataclass(frozen=True)
class Boosting:
    """Settings shared by all models of a job."""

    loss: str = "huber"
    quantile: float = 0.9
    step: float = 0.01
    sample: float = 0.8
    least: int = 5  # rows in a leaf
    seed: int = 42


@dataclass(frozen=True)
class Task:
    """One model: features (places in the common list), depth, numbers of trees to evaluate at (the
    last is the size), and the groups to train on and to evaluate on (None: all, empty: none)."""

    features: tuple[int, ...]
    depth: int
    stages: tuple[int, ...]
    train: tuple | None = None
    valid: tuple = ()


@dataclass(frozen=True)
class Boosted:
    """A fitted ensemble. Trees lie behind each other: a node goes to `child` where its feature is
    at most the threshold and to the next one otherwise; leaves have child 0."""

    features: tuple[str, ...]
    start: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    errors: tuple[tuple[float, float, int], ...]  # squared, absolute, rows; per stage

    def predict(self, x: np.ndarray, trees: int | None = None) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots[:trees]:
            at = np.full(len(x), root)
            while True:
                inner = self.child[at] > 0
                if not inner.any():
                    break
                right = x[rows, self.feature[at]] > self.threshold[at]
                at = np.where(inner, self.child[at] + right, at)
            out += self.value[at]
        return out

    def column(self) -> Column:
        """Prediction for a row, null where a feature is; trees times nodes travel to the tasks."""
        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            table = np.array(x.tolist(), float).reshape(len(x), -1)
            known = ~np.isnan(table).any(axis=1)
            found = np.full(len(x), np.nan)
            found[known] = self.predict(table[known])
            return pd.Series(found).astype(object).where(known, None)
        return run(F.array(*(F.col(f"`{f}`").cast("double") for f in self.features)))


def _keys(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _doubles(keys: np.ndarray) -> np.ndarray:
    bits = np.where(keys >> np.uint64(63), keys & np.uint64((1 << 63) - 1), ~keys)
    return bits.view(np.float64)


def quantiles(values: np.ndarray, part: np.ndarray, parts: int, share: float):
    """Generator: for each part the smallest value with `share` of its values at or below it."""
    keys, low = _keys(np.ascontiguousarray(values, float)), np.zeros(parts, np.uint64)
    rank, shift = None, 64
    while shift > 0:
        width = min(LONG_DIGIT if parts == 1 else DIGIT, shift)
        shift -= width
        digit = ((keys >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        cells = yield np.bincount((part << width) + digit, minlength=parts << width).astype(float)
        sums = cells.reshape(parts, -1).cumsum(axis=1)
        if rank is None:
            rank = np.maximum(np.ceil(share * sums[:, -1] - 1e-9), 1)
        chosen = (sums < rank[:, None]).sum(axis=1)
        chosen = np.minimum(chosen, (1 << width) - 1)
        before = np.where(chosen > 0, np.take_along_axis(
            sums, np.maximum(chosen - 1, 0)[:, None], 1)[:, 0], 0)
        rank = rank - before
        low |= chosen.astype(np.uint64) << np.uint64(shift)
        stays = digit == chosen[part]
        keys, part = keys[stays], part[stays]
    return _doubles(low)


def _tree(x: np.ndarray, begins: np.ndarray, target: np.ndarray, bag: np.ndarray, depth: int,
          least: int):
    """Generator: (feature, bin, child) per node and each row's node. x holds bins numbered through
    all features, which begin at `begins`; a row goes left where its bin is at most the split's."""
    cells, n = begins[-1], len(target)
    firsts, lasts = begins[:-1], begins[1:] - 1
    of_feature = np.repeat(np.arange(len(firsts)), np.diff(begins))
    is_last = np.zeros(cells, bool)
    is_last[lasts] = True
    feature, split, child = [-1], [-1], [0]
    node, level = np.zeros(n, np.int64), [0]
    for _ in range(depth):
        place = np.full(len(child), -1)
        place[level] = np.arange(len(level))
        grown = []
        at_once = max(1, CELLS // (2 * cells))
        for first in range(0, len(level), at_once):
            some = level[first:first + at_once]
            rows = np.flatnonzero(bag & (place[node] >= first) & (place[node] < first + len(some)))
            at = ((place[node[rows]] - first)[:, None] * cells + x[rows]).ravel()
            size = len(some) * cells
            both = yield np.concatenate([
                np.bincount(at, minlength=size),
                np.bincount(at, np.repeat(target[rows], x.shape[1]), minlength=size)])
            count, total = both.reshape(2, len(some), cells).cumsum(axis=2)
            for sums in (count, total):  # from the beginning of each feature
                base = np.concatenate([np.zeros((len(some), 1)), sums[:, lasts[:-1]]], axis=1)
                sums -= base[:, of_feature]
            n_all, s_all = count[:, lasts[:1]], total[:, lasts[:1]]
            n_right, s_right = n_all - count, s_all - total
            fits = (count >= least) & (n_right >= least) & ~is_last
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fits, total**2 / count + s_right**2 / n_right - s_all**2 / n_all, -1)
            # sums arrive in another order over other tasks: what is that close counts as equal
            best = (gain >= gain.max(axis=1, keepdims=True) * (1 - 1e-9)).argmax(axis=1)
            for i, k in enumerate(best.tolist()):
                if gain[i, k] > 1e-10 * max(1.0, abs(s_all[i, 0])):
                    grown.append((some[i], k))
        if not grown:
            break
        level = []
        jump = np.zeros(len(child), np.int64)
        limit = np.zeros(len(child), np.int64)
        by = np.zeros(len(child), np.int64)
        for at, k in grown:
            feature[at], split[at], child[at] = int(of_feature[k]), k, len(child)
            jump[at], limit[at], by[at] = child[at], k, feature[at]
            feature += [-1, -1]
            split += [-1, -1]
            child += [0, 0]
            level += [child[at], child[at] + 1]
        moves = jump[node] > 0
        right = x[np.arange(n), by[node]] > limit[node]
        node = np.where(moves, jump[node] + right, node)
    return np.array(feature), np.array(split), np.array(child), node


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fitting(x: np.ndarray, begins: np.ndarray, y: np.ndarray, keys: np.ndarray, train: np.ndarray,
            valid: np.ndarray, task: Task, settings: Boosting):
    """Generator: (start, trees, errors). Yields arrays, to be sent back added up over tasks."""
    nothing = np.zeros(int(train.sum()), np.int64)
    size = yield np.array([float(len(nothing))])
    if not size[0]:
        return math.nan, [], [(math.nan, math.nan, 0)] * len(task.stages)
    if settings.loss == "huber":
        start = float((yield from quantiles(y[train], nothing, 1, 0.5))[0])
    else:
        start = float((yield np.array([y[train].sum()]))[0] / size[0])
    raw, trees, errors = np.full(len(y), start), [], []
    for t in range(task.stages[-1]):
        rest = y - raw
        draw = _mixed(keys + np.uint64((settings.seed * 1_000_003 + t + 1) * 0x9E3779B97F4A7C15 % 2**64))
        bag = train & (draw < np.uint64(min(int(settings.sample * 2**64), 2**64 - 1)))
        if settings.loss == "huber":
            delta = float((yield from quantiles(
                np.abs(rest[train]), nothing, 1, settings.quantile))[0])
            target = np.clip(rest, -delta, delta)
        else:
            target = rest
        feature, split, child, node = yield from _tree(
            x, begins, target, bag, task.depth, settings.least)
        leaves = np.flatnonzero(child == 0)
        leaf = np.searchsorted(leaves, node)
        part, mine = leaf[bag], rest[bag]
        middle = np.zeros(len(leaves))
        if settings.loss == "huber":
            middle = yield from quantiles(mine, part, len(leaves), 0.5)
            beyond = mine - middle[part]
            mine = np.clip(beyond, -delta, delta)
        both = yield np.concatenate([np.bincount(part, minlength=len(leaves)),
                                     np.bincount(part, mine, minlength=len(leaves))])
        count, total = both.reshape(2, -1)
        step = np.where(count > 0, settings.step * (middle + total / np.maximum(count, 1)), 0.0)
        raw = raw + step[leaf]
        value = np.zeros(len(child))
        value[leaves] = step
        trees.append((feature, split, child, value))
        if t + 1 in task.stages:
            wrong = (y - raw)[valid]
            sums = yield np.array([np.sum(wrong**2), np.abs(wrong).sum(), float(len(wrong))])
            n = max(sums[2], 1.0)
            errors.append((sums[0] / n, sums[1] / n, int(sums[2])))
    return start, trees, errors


def _together(fits: list, add) -> list:
    """Results of generators that advance together; `add` adds an array up over tasks."""
    done, waiting = [None] * len(fits), {}
    for i, fit in enumerate(fits):
        waiting[i] = next(fit)
    while waiting:
        whole = add(np.concatenate(list(waiting.values())))
        at = 0
        for i, sent in list(waiting.items()):
            part = whole[at:at + len(sent)]
            at += len(sent)
            try:
                waiting[i] = fits[i].send(part)
            except StopIteration as end:
                done[i] = end.value
                del waiting[i]
    return done


def _over_tasks(array: np.ndarray) -> np.ndarray:
    text = base64.b64encode(zlib.compress(np.asarray(array, float).tobytes(), 1)).decode()
    parts = BarrierTaskContext.get().allGather(text)
    return sum(np.frombuffer(zlib.decompress(base64.b64decode(p))) for p in parts)


def thresholds(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Per feature at most `bins` - 1 ascending limits between values; between all values where
    there are few, else between approximate quantiles."""
    shares = np.linspace(0, 1, bins + 1).tolist()
    found = df.approxQuantile([f"`{f}`" for f in features], shares, 0.25 / bins)
    out = []
    for values in found:
        distinct = np.unique(values)
        out.append((distinct[:-1] + distinct[1:]) / 2)
    return out


_OUT = ("model int, part int, start double, roots array<int>, feature array<int>, "
        "threshold array<double>, child array<int>, value array<double>, errors array<double>")


def fit_many(df: DataFrame, features: Sequence[str], label: str, group: str,
             tasks: Iterable[Task], ids: Sequence[str], settings: Boosting = Boosting(),
             rows_per_task: int = ROWS_PER_TASK, bins: int = BINS, with_trees: bool = True
             ) -> list[Boosted]:
    """All models from one job over df (a written table); rows with a null label or feature are
    left out. A row is drawn into a tree's sample by a hash of its ids, so the sample does not
    depend on where rows lie; rows that repeat ids are drawn together.

    Up to `rows_per_task` rows there is one model per task; beyond, rows are dealt to tasks that
    run at the same time (Spark's barrier mode, which needs that many free cores, and which starts
    the stage again where an executor is lost) and all models advance together.
    """
    tasks, features = list(tasks), list(features)
    rows = df.select(
        F.xxhash64(*(F.col(f"`{c}`") for c in ids)).alias("key"), F.col(group).alias("grp"),
        F.col(label).cast("double").alias("y"),
        F.array(*(F.col(f"`{f}`").cast("double") for f in features)).alias("x"),
    ).where(F.col("y").isNotNull() & ~F.isnan("y")
            & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    limits = thresholds(df, features, bins)

    def results(pdf: pd.DataFrame, chosen: list[int], add, first: bool) -> pd.DataFrame:
        table = np.array(pdf["x"].tolist(), float).reshape(len(pdf), len(features))
        binned = np.empty(table.shape, np.int32)
        for i, t in enumerate(limits):
            binned[:, i] = np.searchsorted(t, table[:, i], "left")
        y, keys = pdf["y"].to_numpy(float), pdf["key"].to_numpy(np.int64).view(np.uint64)
        groups = pdf["grp"]
        fits = []
        for m in chosen:
            task = tasks[m]
            begins = np.cumsum([0, *(len(limits[f]) + 1 for f in task.features)])
            x = binned[:, list(task.features)] + begins[:-1].astype(np.int32)
            train = np.ones(len(y), bool) if task.train is None else groups.isin(
                task.train).to_numpy(bool)
            valid = groups.isin(task.valid).to_numpy(bool)
            fits.append(fitting(x, begins, y, keys, train, valid, task, settings))
        out = []
        for m, (start, trees, errors) in zip(chosen, _together(fits, add)):
            if not first:
                continue
            begins = np.cumsum([0, *(len(limits[f]) + 1 for f in tasks[m].features)])
            sizes = np.cumsum([0, *(len(t[2]) for t in trees)]) if with_trees else [0]
            nodes = {"feature": [], "threshold": [], "child": [], "value": []}
            for root, (feature, split, child, value) in zip(sizes, trees if with_trees else []):
                nodes["feature"] += np.maximum(feature, 0).tolist()
                nodes["threshold"] += [0.0 if f < 0 else float(
                    limits[tasks[m].features[f]][s - begins[f]]) for f, s in zip(feature, split)]
                nodes["child"] += np.where(child > 0, child + root, 0).tolist()
                nodes["value"] += value.tolist()
            out.append((m, 0, start, list(sizes[:-1]), *nodes.values(),
                        [v for e in errors for v in e]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    count = rows.count()
    parts = -(-count // rows_per_task)
    if parts <= 1:
        dealt = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(len(tasks) - 1))))
        # by range, which gives every model a task of its own
        found = dealt.repartitionByRange(len(tasks), "model").groupBy("model").applyInPandas(
            lambda pdf: results(pdf, [int(pdf["model"].iloc[0])], lambda a: a, True), _OUT)
    else:
        def run(batches):
            held = pd.concat(list(batches) or [pd.DataFrame(columns=["key", "grp", "y", "x"])])
            yield results(held, list(range(len(tasks))), _over_tasks,
                          BarrierTaskContext.get().partitionId() == 0)
        found = rows.repartition(parts).mapInPandas(run, _OUT, barrier=True)
    by_model = {r["model"]: r for r in found.collect()}
    out = []
    for m, task in enumerate(tasks):
        r, names = by_model.get(m), tuple(features[f] for f in task.features)
        if r is None:  # no row at all
            none = np.zeros(0, int)
            out.append(Boosted(names, math.nan, none, none, none.astype(float), none,
                               none.astype(float), ((math.nan, math.nan, 0),) * len(task.stages)))
            continue
        e = [math.nan if v is None else v for v in r["errors"]]  # pandas makes nan null
        out.append(Boosted(
            names, math.nan if r["start"] is None else r["start"], np.array(r["roots"], int), np.array(r["feature"], int),
            np.array(r["threshold"], float), np.array(r["child"], int), np.array(r["value"], float),
            tuple((e[i], e[i + 1], int(e[i + 2])) for i in range(0, len(e), 3))))
    return out
