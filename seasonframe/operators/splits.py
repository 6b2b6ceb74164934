"""Training/test years and validation folds. Distinct years are few whatever the data size, so
they are handled as one sorted array in a scalar subquery: no driver round trip, no join."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def _sorted_years(df: DataFrame, year: str) -> DataFrame:
    return df.agg(F.sort_array(F.collect_set(F.col(year).cast("int"))).alias("years"))


def _test_years(years: Column, fraction: float, trend: bool) -> Column:
    n = F.size(years)
    if trend:
        count = F.floor(n * F.lit(fraction)).cast("int")
        return F.slice(years, n - count + 1, count)
    step = math.floor(1 / fraction)
    return F.filter(years, lambda _, i: (i + 1) % step == 0)


def test_years(df: DataFrame, fraction: float = 0.3, trend: bool = False,
               year: str = "FYEAR") -> DataFrame:
    """Test years as rows: the last share of years with a trend, else every n-th year."""
    picked = _sorted_years(df, year).select(
        _test_years(F.col("years"), fraction, trend).alias("years"))
    return picked.select(F.explode("years").alias("FYEAR"))


test_years.__test__ = False  # not a pytest case


def _is_test(yields: DataFrame, year_col: str, fraction: float, trend: bool) -> Column:
    years = _sorted_years(yields, "FYEAR").select(
        _test_years(F.col("years"), fraction, trend).alias("years"))
    return F.array_contains(years.scalar(), F.col(year_col))


def with_split(df: DataFrame, yields: DataFrame, year_col: str = "FYEAR",
               fraction: float = 0.3, trend: bool = False) -> DataFrame:
    """Add SPLIT ('train' or 'test') by the year's membership in the yields' test years."""
    label = F.when(_is_test(yields, year_col, fraction, trend), "test").otherwise("train")
    return df.withColumn("SPLIT", label)


def split(df: DataFrame, year_col: str, years: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test) views of df by membership in a table of test years."""
    listed = years.agg(F.collect_set(F.col("FYEAR").cast("int")).alias("years")).scalar()
    member = F.array_contains(listed, F.col(year_col).cast("int"))
    return df.filter(~member), df.filter(member)


def sliding_folds(df: DataFrame, k: int = 5, year: str = "FYEAR") -> DataFrame:
    """Time-ordered folds as (FOLD, ROLE, FYEAR): with n years, fold j trains on years
    j..j+n-k-1 and tests on the next one."""
    years = _sorted_years(df, year)
    train_size = F.size("years") - k
    placed = years.select(
        train_size.alias("size"), F.posexplode("years").alias("place", "FYEAR"))
    folds = placed.select("size", "place", "FYEAR",
                          F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("FOLD"))
    start, stop = F.col("FOLD"), F.col("FOLD") + F.col("size")
    role = F.when((F.col("place") >= start) & (F.col("place") < stop), "train") \
        .when(F.col("place") == stop, "test")
    return folds.filter(F.col("size") > 0).withColumn("ROLE", role) \
        .filter(F.col("ROLE").isNotNull()).select("FOLD", "ROLE", "FYEAR")


def numbered(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (),
             into: str = "_place") -> DataFrame:
    """df with `into`: each row's place from 0 within its keys, in the order (nulls first); rows
    that tie are numbered in any order. A null key is a key like any other.

    Rows are ordered over all tasks by range and written; each task numbers its own part, and the
    rows of earlier tasks are added. What is gathered is one count per key and task, so a key that
    holds most rows is spread over many tasks.
    """
    keys, order = list(keys), list(order)
    tie, part, before = f"{into}_tie", f"{into}_part", f"{into}_before"
    rows = df.withColumn(tie, F.xxhash64(F.monotonically_increasing_id()))
    rows = cut(rows.repartitionByRange(*keys, *order, tie).withColumn(
        part, F.spark_partition_id()))
    local = F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order, tie))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(
        F.col(part).alias("_same"), *(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(before))
    same = F.col(part) == F.col("_same")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return rows.withColumn(into, local.cast("long")).join(counts, same).withColumn(
        into, F.col(into) + F.col(before) - 1).select(*df.columns, into)


def contiguous_folds(df: DataFrame, k: int = 5, order=("IDREGION", "FYEAR"),
                     keys: Sequence[str] = ()) -> DataFrame:
    """Add FOLD 0..k-1: contiguous blocks of the rows sorted by region, then year; the first
    n mod k folds are one row longer. With `keys`, of each key's rows on their own.

    A null region or key is one like any other. No region, country or key is numbered by a single
    task (see `numbered`).
    """
    keys = list(keys)
    placed = numbered(df, order, keys)
    if keys:
        totals = df.groupBy(*(F.col(c).alias(f"_of{i}") for i, c in enumerate(keys))).agg(
            F.count(F.lit(1)).alias("_total"))
        same = F.lit(True)
        for i, c in enumerate(keys):
            same = same & F.col(c).eqNullSafe(F.col(f"_of{i}"))
        placed, total = placed.join(totals, same), F.col("_total")
    else:
        total = df.agg(F.count(F.lit(1))).scalar()
    size, extra = F.floor(total / k), total % k
    long_part = extra * (size + 1)
    fold = F.when(F.col("_place") < long_part, F.floor(F.col("_place") / (size + 1))) \
        .otherwise(extra + F.floor((F.col("_place") - long_part) / F.greatest(size, F.lit(1))))
    return placed.withColumn("FOLD", fold.cast("int")).select(*df.columns, "FOLD")
