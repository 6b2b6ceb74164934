"""Ridge per key in one job and numbering over all tasks, against plain versions."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonframe.operators.grouped import grouped_ridge, with_lines
from seasonframe.operators.splits import contiguous_folds, numbered

ALPHAS, SCHEMA = (0.01, 1.0, 10.0), "crop string, IDREGION string, FYEAR int, a double, `b 2` double, y double"


def plain_line(x, y, alpha):
    center, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-12] = 1
    z = (x - center) / spread
    w = np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ (y - y.mean())) / spread
    return y.mean() - w @ center, w


def plain_ridge(x, y, k):
    folds = np.array_split(np.arange(len(y)), k)
    errors = []
    for alpha in ALPHAS:
        each = []
        for fold in folds:
            rest = np.setdiff1d(np.arange(len(y)), fold)
            if len(fold) and len(rest):
                w0, w = plain_line(x[rest], y[rest], alpha)
                each.append(np.mean((y[fold] - w0 - x[fold] @ w)**2))
        errors.append(np.mean(each) if each else np.nan)
    best = 0 if np.isnan(errors).all() else int(np.nanargmin(errors))
    return ALPHAS[best], errors[best], plain_line(x, y, ALPHAS[best])


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    rows = []
    for crop, n in (("hot", 300), ("two", 23), (None, 11), ("few", 3), ("one", 1)):
        for i in range(n):
            a, b = rng.normal(), rng.normal() * 5
            rows.append((crop, f"R{i // 6}", 2000 + i % 6, float(a), float(b),
                         float((2 if crop == "hot" else -1) * a + b / 3 + rng.normal())))
    rows += [("hot", "R0", 1990, None, 1.0, 1.0), ("none", "R0", 1990, None, 1.0, 1.0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_ridge_per_key_against_numpy(spark, data):
    lines = grouped_ridge(data, ["crop"], ["a", "b 2"], "y", ALPHAS)
    got = {r["crop"]: r for r in lines.collect()}
    by_key = defaultdict(list)
    for r in data.collect():
        if r["a"] is not None:
            by_key[r["crop"]].append((r["IDREGION"], r["FYEAR"], r["a"], r["b 2"], r["y"]))
    assert set(got) == set(by_key)
    for crop, rows in by_key.items():
        table = np.array([r[2:] for r in sorted(rows)])
        alpha, error, (w0, w) = plain_ridge(table[:, :2], table[:, 2], 5)
        r = got[crop]
        assert (r["ALPHA"], r["N"]) == (alpha, len(rows))
        assert r["INTERCEPT"] == pytest.approx(w0) and r["WEIGHTS"] == pytest.approx(list(w))
        if len(rows) > 1:
            assert r["CV_ERROR"] == pytest.approx(error)
    out = with_lines(data, lines, ["crop"], ["a", "b 2"]).toPandas()
    assert len(out) == data.count() and out["YIELD_PRED"].isna().sum() == 2


def test_no_rows(spark, data):
    none = data.limit(0)
    lines = grouped_ridge(none, ["crop"], ["a", "b 2"], "y", ALPHAS)
    assert lines.collect() == [] and with_lines(none, lines, ["crop"], ["a"]).collect() == []


@pytest.fixture
def many_tasks(spark):
    """Small tables stay in several tasks."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_numbering_over_many_tasks(spark, many_tasks):
    rows = [("hot" if i % 3 else None, (i * 7919) % 400 // 2, i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v int, n int").repartition(6)
    got = numbered(df, ["v"], ["k"], "at").toPandas()
    assert sorted(got["n"]) == list(range(600))
    for _, part in got.groupby("k", dropna=False):
        part = part.sort_values("at")
        assert part["at"].tolist() == list(range(len(part))) and part["v"].is_monotonic_increasing
    whole = numbered(df, ["v"]).toPandas().sort_values("_place")
    assert whole["_place"].tolist() == list(range(600)) and whole["v"].is_monotonic_increasing


def test_one_key_is_numbered_by_several_tasks(spark, many_tasks):
    df = spark.range(4000).selectExpr("'R1' AS IDREGION", "CAST(id % 2 AS INT) AS FYEAR", "id")
    folds = contiguous_folds(df, 7)
    sizes = [r["count"] for r in folds.groupBy("FOLD").count().orderBy("FOLD").collect()]
    assert sizes == [572] * 3 + [571] * 4
    spread = df.repartitionByRange("IDREGION", "FYEAR", F.xxhash64("id")).select(
        F.spark_partition_id().alias("p")).distinct().count()
    assert spread > 1
