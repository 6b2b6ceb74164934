import pytest
from conftest import rows
from fixtures import yields
from pyspark.sql import functions as F

from seasonframe.operators import splits


def years(spark, n):
    return spark.range(n).selectExpr("CAST(id + 2000 AS INT) AS FYEAR", "1.0 AS YIELD")


def test_test_years(spark):
    df = years(spark, 20)
    assert rows(splits.test_years(df, 0.3, trend=True)) == [(y,) for y in range(2014, 2020)]
    assert rows(splits.test_years(df, 0.3)) == [(2000 + i,) for i in (2, 5, 8, 11, 14, 17)]
    assert rows(splits.test_years(years(spark, 2), 0.3, trend=True)) == []


def test_split(spark):
    df = years(spark, 20)
    train, test = splits.split(df, "FYEAR", splits.test_years(df, 0.3))
    assert train.count() == 14 and test.count() == 6
    labelled = splits.with_split(df, df, "FYEAR", 0.3)
    assert rows(labelled.filter("SPLIT = 'test'"), "FYEAR") == rows(test, "FYEAR")


@pytest.mark.parametrize("n,k", [(10, 5), (7, 3), (6, 5)])
def test_sliding_folds(spark, n, k):
    got = {}
    for fold, role, year in rows(splits.sliding_folds(years(spark, n), k)):
        got.setdefault(fold, {"train": [], "test": []})[role].append(year - 2000)
    assert got == {j: {"train": list(range(j, j + n - k)), "test": [j + n - k]} for j in range(k)}


def test_sliding_folds_need_enough_years(spark):
    assert splits.sliding_folds(years(spark, 5), 5).count() == 0


@pytest.mark.parametrize("k", [2, 5, 7])
def test_contiguous_folds(spark, k):
    df = yields(spark).repartition(5)
    got = [r["FOLD"] for r in splits.contiguous_folds(df, k).orderBy("IDREGION", "FYEAR").collect()]
    n = len(got)
    sizes = [n // k + (j < n % k) for j in range(k)]
    assert got == [j for j, size in enumerate(sizes) for _ in range(size)]


def test_contiguous_folds_keep_rows_without_a_region(spark):
    df = yields(spark).withColumn("IDREGION", F.when(F.col("IDREGION") != "AA12", F.col("IDREGION")))
    got = [r["FOLD"] for r in splits.contiguous_folds(df, 3).orderBy("IDREGION", "FYEAR").collect()]
    assert len(got) == df.count() and got == sorted(got)
