import numpy as np
import pytest
from conftest import rows
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from seasonframe.operators import models, moments, neighbours
from seasonframe.operators.models import EstimatorSpec

D = 12


def table(spark, n=140, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, D)) * np.arange(1, D + 1) + 1000
    y = 50 + 3 * (x[:, 0] - 1000) - (x[:, 1] - 1000) + 0.2 * (x[:, 2] - 1000) \
        + rng.normal(0, 0.5, n)
    years = n // 10
    data = [(f"R{i // years:02d}", 2000 + i % years, *map(float, x[i]), float(y[i]))
            for i in range(n)]
    schema = "IDREGION string, FYEAR int, " + ", ".join(f"f{j} double" for j in range(D))
    return spark.createDataFrame(data, schema + ", YIELD double"), x, y


FEATURES = [f"f{j}" for j in range(D)]


@pytest.fixture(scope="module")
def problem(spark):
    df, x, y = table(spark)
    return models.training_set(df, FEATURES, k=5), x, y


def ridge_by_hand(x, y, alpha, standardise=True):
    m, s = x.mean(0), x.std(0) if standardise else np.ones(x.shape[1])
    z = (x - m) / s
    b = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return lambda q: y.mean() + (q - m) / s @ b


def test_moments_match_numpy(problem):
    ts, x, y = problem
    center, scale = ts.moments.standardisation()
    assert center == pytest.approx(x.mean(0)) and scale == pytest.approx(x.std(0))
    total = ts.moments.total()
    assert total[0, 0] == len(y) and total[0, -1] == pytest.approx(y.sum())
    assert sorted(ts.moments.groups) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("standardise", [True, False])
@pytest.mark.parametrize("alpha", [1e-5, 1.0, 50.0])
def test_ridge_matches_the_closed_form(problem, alpha, standardise):
    ts, x, y = problem
    want = ridge_by_hand(x, y, alpha, standardise)(x)
    line = moments.ridge_fit(ts.moments, alpha, standardise=standardise)
    got = {(r[0], r[1]): r[2] for r in ts.df.select(
        "IDREGION", "FYEAR", line.column()).collect()}
    order = sorted(got)
    assert [got[k] for k in order] == pytest.approx(list(want), rel=1e-8)


def test_ridge_cv_error_matches_refits(problem):
    ts, x, y = problem
    fold = np.repeat(np.arange(5), len(y) // 5)
    errors = []
    for j in range(5):
        fit = ridge_by_hand(x[fold != j][:, :4], y[fold != j], 2.0)
        errors.append(np.mean((fit(x[fold == j][:, :4]) - y[fold == j]) ** 2))
    got = moments.ridge_cv_error(ts.moments, 2.0, ts.folds, [FEATURES[:4]] * 5)
    assert got == pytest.approx(np.mean(errors), rel=1e-8)


def test_ridge_agrees_with_spark_linear_regression(spark, problem):
    ts, x, y = problem
    alpha, n = 5.0, len(y)
    center, scale = ts.moments.standardisation()
    scaled = ts.df.select("YIELD", *[((F.col(f) - float(c)) / float(s)).alias(f)
                                     for f, c, s in zip(FEATURES, center, scale)])
    model = LinearRegression(
        featuresCol="_x", labelCol="YIELD", elasticNetParam=0.0, standardization=False,
        regParam=alpha / n * y.std(ddof=1), solver="l-bfgs", maxIter=500, tol=1e-12,
    ).fit(models._assembled(scaled, FEATURES))
    line = moments.ridge_fit(ts.moments, alpha)
    assert np.array(line.weights) * scale == pytest.approx(
        model.coefficients.toArray(), abs=2e-2)


def lasso_by_hand(x, y, alpha, steps=20000):
    z = (x - x.mean(0)) / x.std(0)
    b, n = np.zeros(z.shape[1]), len(y)
    rate = 1 / np.linalg.eigvalsh(z.T @ z / n).max()
    for _ in range(steps):
        b = b - rate * (z.T @ (z @ b - (y - y.mean()))) / n
        b = np.sign(b) * np.maximum(abs(b) - rate * alpha, 0)
    return b


def test_lasso_matches_proximal_descent(problem):
    ts, x, y = problem
    got = moments.lasso_weights(ts.moments.total(), 0.3)
    assert got == pytest.approx(lasso_by_hand(x, y, 0.3), abs=1e-6)


def test_elimination_keeps_the_signal(problem):
    ts, _, _ = problem
    kept = moments.lasso_elimination(ts.moments, [3, 6], 0.1)
    assert set(kept[3]) == {"f0", "f1", "f2"} and set(kept[3]) < set(kept[6])


def knn_by_hand(q, x, y, k):
    out = []
    for row in q:
        d = np.sqrt(((x - row) ** 2).sum(1))
        near = d.argsort(kind="stable")[:k]
        if (d[near] == 0).any():
            out.append(y[near][d[near] == 0].mean())
        else:
            out.append((y[near] / d[near]).sum() / (1 / d[near]).sum())
    return out


@pytest.mark.parametrize("chunk,queries", [(1024, 16384), (16, 25)])
def test_knn_matches_brute_force(spark, monkeypatch, chunk, queries):
    """The small sizes force pivots, several cells and chunks, and several query groups."""
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", queries)
    monkeypatch.setattr(neighbours, "PIVOTS", 6)
    df, x, y = table(spark)
    train = df.filter("FYEAR < 2010")
    keep = np.array([2000 + i % 14 < 2010 for i in range(len(y))])
    got = {r["qid"]: (r["K3"], r["K7"]) for r in neighbours.knn_predictions(
        df, train, FEATURES, "YIELD", models.IDS, [3, 7]).collect()}
    keys = [f'{{"IDREGION":"R{i // 14:02d}","FYEAR":{2000 + i % 14}}}' for i in range(len(y))]
    for j, k in enumerate((3, 7)):
        want = knn_by_hand(x, x[keep], y[keep], k)
        assert [got[key][j] for key in keys] == pytest.approx(want, rel=1e-9)


def test_knn_cross_validation_matches_brute_force(problem):
    """Two choices of features, other ones per fold, and two k in one run."""
    ts, x, y = problem
    folds = {r["IDREGION"] + str(r["FYEAR"]): r["FOLD"] for r in ts.df.collect()}
    fold = np.array([folds[f"R{i // 14:02d}{2000 + i % 14}"] for i in range(len(y))])
    choices = [[FEATURES] * 5, [FEATURES[j:j + 3] for j in range(5)]]
    got = models.knn_cv_errors(ts, [{"k": 7}, {"k": 3}], choices)
    for subsets, errors in zip(choices, got):
        for k, error in zip((7, 3), errors):
            want = []
            for j, names in enumerate(subsets):
                at = [FEATURES.index(n) for n in names]
                train, valid = fold != j, fold == j
                z = (x[:, at] - x[train][:, at].mean(0)) / x[train][:, at].std(0)
                want.append(np.mean((np.array(
                    knn_by_hand(z[valid], z[train], y[train], k)) - y[valid]) ** 2))
            assert error == pytest.approx(np.mean(want), rel=1e-9)


def test_knn_with_hot_duplicate_rows(spark, monkeypatch):
    """A third of the training rows are equal: their cell is split into chunks."""
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 8)
    monkeypatch.setattr(neighbours, "PIVOTS", 4)
    data = [(f"R{i}", i, 1.0 if i % 3 == 0 else float(i), float(i)) for i in range(60)]
    df = spark.createDataFrame(data, "IDREGION string, FYEAR int, x double, YIELD double")
    query = spark.createDataFrame([("Q", 1, 1.0)], "IDREGION string, FYEAR int, x double")
    found = neighbours.nearest_neighbours(query, df, ["x"], "YIELD", models.IDS, 20)
    assert [r["dist"] for r in found.collect()] == [0.0] * 20
    blocks = found.count()
    assert blocks == 20


def test_missing_query_features_give_no_prediction(spark):
    df, _, _ = table(spark)
    query = df.limit(1).withColumn("f0", F.lit(None).cast("double"))
    out = neighbours.with_knn(query, df, FEATURES, "YIELD", models.IDS, 3)
    assert out.count() == 1 and out.first()["YIELD_PRED"] is None


def test_fewer_trees_are_a_prefix(problem):
    """One long fit stands for all shorter ones in cross-validation; folds share a job."""
    ts, _, _ = problem
    grid = [{"max_depth": 2, "trees": 3}, {"max_depth": 2, "trees": 8}, {"max_depth": 1, "trees": 3}]
    got = models.boosted_cv_errors(ts, grid, [FEATURES] * len(ts.folds))
    for p, error in zip(grid, got):
        own = models.boosted_cv_errors(ts, [p], [FEATURES] * len(ts.folds))
        assert error == pytest.approx(own[0], rel=1e-12)
    fit = models.boosted_fit(ts, grid[1], FEATURES)
    rows = ts.df.withColumn("P", fit.column()).toPandas()
    x = rows[list(FEATURES)].to_numpy(float)
    assert len(fit.roots) == 8 and rows["P"].to_numpy() == pytest.approx(fit.predict(x))
    assert fit.predict(x, 3) == pytest.approx(models.boosted_fit(ts, grid[0], FEATURES).predict(x))


def test_forest_picks():
    names = list("abcdef")
    assert models.forest_picks([.1, .4, .2, .0, .25, .05], names, [2, 6]) == {
        2: ["b", "e"], 6: ["b", "c", "e"]}


def test_selection_sizes():
    assert models.selection_sizes(8) == [8]
    assert models.selection_sizes(18) == [10, 15]
    assert models.selection_sizes(40) == [10, 15, 20]
    assert models.selection_sizes(40, trend=True) == [10, 15, 20, 25]


def test_selection_and_grid(problem):
    ts, x, y = problem
    spec = EstimatorSpec("Ridge", "ridge", ({"alpha": 0.1},), ({"alpha": 0.1}, {"alpha": 1e4}))
    picked = models.select_features(ts, spec)
    assert set(picked.scores) == {"random_forest", "rfe_lasso", "combined"}
    assert {"f0", "f1"} <= set(picked.features)
    fit = models.grid_fit(ts, spec, picked.features)
    assert fit.params == {"alpha": 0.1}
    out = fit.predict(ts.df, "P").agg(F.avg(F.abs(F.col("P") - F.col("YIELD")))).first()[0]
    assert out < 1.0
    with pytest.raises(ValueError, match="unknown selector"):
        models.select_features(ts, spec, ["nothing"])


def test_time_ordered_training_set(spark):
    df, _, _ = table(spark)
    ts = models.training_set(df, FEATURES, k=3, time_ordered=True)
    for train, valid in ts.folds:
        assert max(train) < min(valid) and len(valid) == 1
    with pytest.raises(ValueError, match="too few years"):
        models.training_set(df.filter("FYEAR < 2003"), FEATURES, k=5, time_ordered=True)


def test_detrend_and_restore(spark):
    data = [(f"R{r}", y, 10.0 * r + y % 100, 10.0 * r + y % 100 - 1,
             "test" if y > 2007 else "train")
            for r in range(4) for y in range(2000, 2010)]
    df = spark.createDataFrame(
        data, "IDREGION string, FYEAR int, YIELD double, `YIELD-1` double, SPLIT string")
    out = models.detrend(df, ["YIELD-1"], k=3)
    assert out.agg(F.max(F.abs("YIELD_RES"))).first()[0] < 0.1
    back = models.restore_trend(out.withColumn("YIELD_PRED_m", F.col("YIELD_RES")), ["m"])
    assert back.filter("abs(YIELD_PRED_m - YIELD) > 1e-9").count() == 0
    assert back.filter("YIELD_RES_PRED_m <> YIELD_RES").count() == 0


def test_null_model(spark):
    df = spark.createDataFrame(
        [("A", 1, "train", 1.0, 9.0), ("A", 2, "train", 2.005, 9.0), ("A", 3, "test", 50.0, 7.0)],
        "IDREGION string, FYEAR int, SPLIT string, YIELD double, YIELD_TREND double")
    assert rows(models.null_stats(df.filter("SPLIT = 'train'"))) == [(1.0, 2.0, 1.5, 1.5)]
    assert {r["YIELD_PRED"] for r in models.null_model(df).collect()} == {1.5}
    assert rows(models.null_model(df, trend=True), "ALG", "YIELD_PRED") == [
        ("trend", 7.0), ("trend", 9.0), ("trend", 9.0)]


def test_scaling(spark):
    df, x, _ = table(spark)
    out = models.population_scaled(df, FEATURES, models.scaling_stats(df, FEATURES))
    check = out.agg(F.avg("f3"), F.stddev_pop("f3")).first()
    assert check[0] == pytest.approx(0, abs=1e-9) and check[1] == pytest.approx(1)
    stages = models.standard_scaler(FEATURES)
    assembled = stages[0].transform(df)
    assert "scaled" in stages[1].fit(assembled).transform(assembled).columns


def test_selected_frequency(spark):
    picks = spark.createDataFrame(
        [("a", "avgPRECp3"), ("b", "avgPRECp3"), ("a", "SM_WHC"), ("b", "RSMp1gt2STD")],
        "ALG string, FEATURE string")
    assert rows(models.selected_frequency(picks)) == [
        ("p1", "RSMp1gt2STD", 1), ("p3", "avgPRECp3", 2), ("static", "SM_WHC", 1)]
