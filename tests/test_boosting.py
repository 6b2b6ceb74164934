"""Boosted trees against a plain recursive version, over one task and over several."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonframe.operators import boosting
from seasonframe.operators.boosting import Boosting, Task, fit_many

IDS, NAMES = ("region", "year"), ("a", "b", "c", "const")


def lower(values, share):
    values = np.sort(values)
    return values[max(math.ceil(share * len(values) - 1e-9), 1) - 1]


def grow(x, target, rows, depth, least):
    """A leaf (row numbers) or (feature, limit, left, right)."""
    best = None
    if depth:
        for f in range(x.shape[1]):
            every = np.unique(x[:, f])  # limits lie between values of all rows
            for value in np.unique(x[rows, f])[:-1]:
                limit = (value + every[np.searchsorted(every, value) + 1]) / 2
                left = rows[x[rows, f] <= limit]
                right = rows[x[rows, f] > limit]
                if min(len(left), len(right)) < least:
                    continue
                gain = (target[left].sum()**2 / len(left) + target[right].sum()**2 / len(right)
                        - target[rows].sum()**2 / len(rows))
                if gain > 1e-10 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = gain, f, limit, left, right
    if best is None:
        return rows
    _, f, limit, left, right = best
    return (f, limit, grow(x, target, left, depth - 1, least),
            grow(x, target, right, depth - 1, least))


def routed(tree, row, value):
    while isinstance(tree, tuple):
        f, limit, left, right = tree
        tree = left if row[f] <= limit else right
    return value(tree)


def plain(x, y, keys, train, depth, trees, s):
    start = lower(y[train], 0.5) if s.loss == "huber" else y[train].mean()
    raw = np.full(len(y), start)
    for t in range(trees):
        rest = y - raw
        delta = lower(np.abs(rest[train]), s.quantile) if s.loss == "huber" else np.inf
        target = np.clip(rest, -delta, delta)
        draw = boosting._mixed(keys + np.uint64(
            (s.seed * 1_000_003 + t + 1) * 0x9E3779B97F4A7C15 % 2**64))
        bag = train & (draw < np.uint64(min(int(s.sample * 2**64), 2**64 - 1)))

        def value(rows):
            if not len(rows):
                return 0.0
            if s.loss != "huber":
                return rest[rows].mean()
            middle = lower(rest[rows], 0.5)
            return middle + np.clip(rest[rows] - middle, -delta, delta).mean()
        tree = grow(x, target, np.flatnonzero(bag), depth, s.least)
        raw = raw + np.array([s.step * routed(tree, row, value) for row in x])
    return raw


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(140):
        a, b, c = float(rng.integers(0, 12)), float(rng.normal()), float(rng.integers(0, 3))
        y = 3 * (a > 5) + b * c + float(rng.normal()) * (10 if i % 15 == 0 else 0.3)
        rows.append((f"R{i % 20}", 1990 + i // 20, i % 4, a, b, c, 1.0, y))
    df = spark.createDataFrame(
        rows, "region string, year int, fold int, a double, b double, c double, const double, y double")
    return df.withColumn("key", F.xxhash64(*IDS)).cache()


@pytest.mark.parametrize("loss", ["huber", "squared"])
def test_trees_are_those_of_a_plain_version(spark, data, loss):
    settings = Boosting(loss=loss, step=0.1)
    tasks = [Task((0, 1, 2, 3), depth, (4, 12), (0, 1, 2), (3,)) for depth in (1, 4)]
    fits = fit_many(data, NAMES, "y", "fold", tasks, IDS, settings)
    t = data.toPandas()
    x, y = t[list(NAMES)].to_numpy(float), t["y"].to_numpy(float)
    keys, train = t["key"].to_numpy(np.int64).view(np.uint64), t["fold"].to_numpy() < 3
    for task, fit in zip(tasks, fits):
        want = plain(x, y, keys, train, task.depth, 12, settings)
        assert fit.predict(x) == pytest.approx(want, abs=1e-9)
        squared, absolute, n = fit.errors[1]
        wrong = (y - want)[~train]
        assert n == (~train).sum()
        assert (squared, absolute) == (pytest.approx((wrong**2).mean()), pytest.approx(np.abs(wrong).mean()))


def test_rows_over_several_tasks_give_the_same_trees(data):
    """Three parts whose generators advance together, as tasks do."""
    t = data.toPandas()
    x = np.stack([np.unique(t[n], return_inverse=True)[1] for n in NAMES], axis=1)
    begins = np.cumsum([0, *(x.max(axis=0) + 1)])
    y, fold = t["y"].to_numpy(float), t["fold"].to_numpy()
    keys = t["key"].to_numpy(np.int64).view(np.uint64)
    task, settings = Task((0, 1, 2, 3), 4, (3, 6)), Boosting(step=0.1)

    def fit(rows):
        return boosting.fitting(x[rows] + begins[:-1], begins, y[rows], keys[rows], fold[rows] < 3,
                                fold[rows] == 3, task, settings)
    whole = boosting._together([fit(np.arange(len(y)))], lambda a: a)[0]
    parts = [fit(np.flatnonzero(np.arange(len(y)) % 5 // 2 == i)) for i in range(3)]
    sent, results = [next(p) for p in parts], None
    while results is None:
        total, sent, ends = sum(sent), [], []
        for p in parts:
            try:
                sent.append(p.send(total))
            except StopIteration as end:
                ends.append(end.value)
        results = ends or None
    for start, trees, errors in results:
        assert start == whole[0] and np.array(errors) == pytest.approx(np.array(whole[2]))
        for got, want in zip(trees, whole[1]):
            assert all(a.tolist() == b.tolist() for a, b in zip(got[:3], want[:3]))
            assert got[3] == pytest.approx(want[3])


def test_tasks_that_run_at_the_same_time(spark, data):
    tasks = [Task((0, 1, 2), 1, (1,), (0, 1, 2), (3,)), Task((1,), 1, (1,), None, ())]
    settings = Boosting(step=0.1, loss="squared")
    one = fit_many(data, NAMES, "y", "fold", tasks, IDS, settings)
    several = fit_many(data, NAMES, "y", "fold", tasks, IDS, settings, rows_per_task=60)
    for a, b in zip(one, several):
        assert a.feature.tolist() == b.feature.tolist() and a.child.tolist() == b.child.tolist()
        assert a.threshold.tolist() == b.threshold.tolist()
        assert a.value == pytest.approx(b.value) and a.start == pytest.approx(b.start)
        assert np.array(a.errors) == pytest.approx(np.array(b.errors), nan_ok=True)


def test_quantiles_are_exact():
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=500), [0.0, -0.0, 1e300, -1e300, 5e-324], np.ones(50)])
    part = rng.integers(0, 4, len(values))
    part[part == 2] = 1  # an empty part
    for share in (0.1, 0.5, 0.9):
        run = boosting.quantiles(values, part, 4, share)
        sent = next(run)
        with pytest.raises(StopIteration) as end:
            while True:
                sent = run.send(sent)
        got = end.value.value
        assert [got[p] for p in (0, 1, 3)] == [lower(values[part == p], share) for p in (0, 1, 3)]


def test_rows_without_a_value_take_no_part(spark, data):
    gaps = data.withColumn("a", F.when(F.col("year") > 1991, F.col("a"))).withColumn(
        "y", F.when(F.col("region") != "R3", F.col("y")))
    task = Task((0, 1), 2, (3,), (0, 1, 2), (3,))
    fit = fit_many(gaps, NAMES, "y", "fold", [task], IDS)[0]
    known = gaps.na.drop(subset=["a", "y"])
    again = fit_many(known, NAMES, "y", "fold", [task], IDS)[0]
    assert fit.errors == again.errors and fit.value.tolist() == again.value.tolist()
    got = gaps.select("a", fit.column().alias("p")).toPandas()
    assert (got["a"].isna() == got["p"].isna()).all()


def test_no_rows_and_constant_features(spark, data):
    task = Task((3,), 3, (2,), (0, 1), (2,))
    fit = fit_many(data, NAMES, "y", "fold", [task], IDS)[0]
    assert fit.child.tolist() == [0, 0] and fit.errors[0][2] == 35
    none = fit_many(data.limit(0), NAMES, "y", "fold", [task], IDS)[0]
    assert math.isnan(none.start) and none.errors[0][2] == 0
    nobody = fit_many(data, NAMES, "y", "fold", [Task((0,), 1, (1,), (9,), (0,))], IDS)[0]
    assert math.isnan(nobody.start)
