"""Prediction scores as grouped aggregates, and an exact median that scales."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import steady_round
from ..storage import cut

DEFAULT_METRICS = ("NMAE", "MAPE", "NRMSE", "R2")


def _same(left: DataFrame, right: DataFrame, by: Sequence[str], right_by: Sequence[str]) -> Column:
    """Equal labels, where a null label equals itself."""
    return reduce(Column.__and__, (left[a].eqNullSafe(right[b]) for a, b in zip(by, right_by)))


def _expressions(y, p):
    error = y - p
    mean = F.avg(y)
    squares = F.sum(error * error)
    unexplained = F.try_divide(squares, F.var_pop(y) * F.count(y))
    return {
        "NMAE": F.try_divide(100 * F.avg(F.abs(error)), mean),
        "MAPE": 100 * F.avg(F.abs(F.try_divide(error, y))),
        "NRMSE": F.try_divide(100 * F.sqrt(F.avg(error * error)), mean),
        "R2": 1 - unexplained,
        "NSE": 1 - unexplained,
        "EXP_VAR": 1 - F.try_divide(F.var_pop(error), F.var_pop(y)),
    }


def scores(df: DataFrame, label: str = "YIELD", pred: str = "YIELD_PRED",
           by: Sequence[str] = ("ALG", "SPLIT"),
           metrics: Sequence[str] = DEFAULT_METRICS) -> DataFrame:
    """Scores per group, rounded to 2: absolute and squared errors as percent of the mean label.

    Besides the defaults: NSE (the same as R2), EXP_VAR, and NMdAE, the median absolute error.
    Rows without a prediction count in no score; N_SCORED and N_UNKNOWN, asked for as metrics, say
    how many labelled rows each group was and was not scored on.
    """
    labelled = df.filter(F.col(label).isNotNull())
    p = F.col(pred)
    y = F.when(p.isNotNull(), F.col(label))
    known = labelled.filter(p.isNotNull())
    exprs = _expressions(y, p) | {"N_SCORED": F.count(p), "N_UNKNOWN": F.count_if(p.isNull())}
    plain = [m for m in metrics if m != "NMdAE"]
    # the mean label is kept for NMdAE even when it is the only metric asked for
    table = labelled.groupBy(*by).agg(
        F.avg(y).alias("_mean"), *[(exprs[m] if m.startswith("N_") else steady_round(exprs[m], 2))
                                   .alias(m) for m in plain])
    if "NMdAE" in metrics:
        errors = known.select(*by, F.abs(y - p).alias("_error"))
        medians = exact_median(errors, "_error", by)
        if by:
            other = [f"_by{i}" for i in range(len(by))]
            medians = medians.withColumnsRenamed(dict(zip(by, other)))
            table = table.join(medians, _same(table, medians, by, other), "left")
        else:
            table = table.withColumn("MEDIAN", medians.scalar())
        table = table.withColumn(
            "NMdAE", steady_round(F.try_divide(100 * F.col("MEDIAN"), F.col("_mean")), 2))
    return table.select(*by, *metrics)


def score_table(table: DataFrame, metrics: Sequence[str] = DEFAULT_METRICS) -> DataFrame:
    """One row per algorithm with `train_<metric>` and `test_<metric>` columns."""
    wide = table.groupBy("ALG").pivot("SPLIT", ["train", "test"]).agg(
        *[F.first(m).alias(m) for m in metrics])
    if len(metrics) == 1:
        wide = wide.withColumnsRenamed({s: f"{s}_{metrics[0]}" for s in ("train", "test")})
    return wide.select("ALG", *[f"{s}_{m}" for m in metrics for s in ("train", "test")])


def exact_median(df: DataFrame, value: str, by: Sequence[str] = (), buckets: int = 1024,
                 open_rows: int = 1 << 16) -> DataFrame:
    """Exact median per group, as (by..., MEDIAN), with no group gathered in one task.

    Each pass counts rows in equal-width buckets of the range still open and narrows it to the
    bucket that holds the wanted rank, until at most `open_rows` rows are in it; a last count by
    distinct value finishes. Every pass is a partial aggregate over rows that are written once,
    followed by a running sum over at most `buckets` rows. A null label is a group like any other.
    """
    keys = [*by, "_rank"]
    other = [f"_by{i}" for i in range(len(by))]
    x = F.col("_x")
    rows = cut(df.select(*by, F.col(value).cast("double").alias("_x")).filter(x.isNotNull()))
    last = F.col("_n") - 1
    # the middle rank, or both, 0-based and relative to the open range
    state = cut(rows.groupBy(*by).agg(
        F.count(x).alias("_n"), F.min(x).alias("_lo"), F.max(x).alias("_hi")).filter("_n > 0").select(
        *by, F.explode(F.array_distinct(F.array(F.floor(last / 2), F.ceil(last / 2)))).alias("_k"),
        "_n", "_lo", "_hi").withColumn("_rank", F.col("_k")))

    def step(state: DataFrame, bucket) -> DataFrame:
        if by:
            wanted = state.drop("_n").withColumnsRenamed(dict(zip(by, other)))
            joined = rows.join(wanted, _same(rows, wanted, by, other)).drop(*other)
        else:
            both = state.agg(F.collect_list(F.struct("_rank", "_k", "_lo", "_hi"))).scalar()
            joined = rows.select("_x", F.explode(both).alias("_s")).select("_x", "_s.*")
        counted = joined.filter(x.between(F.col("_lo"), F.col("_hi"))).groupBy(
            *keys, "_k", bucket.alias("_b")).agg(
            F.count(x).alias("_n"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
        upto = Window.partitionBy(*keys).orderBy("_b")
        summed = counted.withColumn("_upto", F.sum("_n").over(upto))
        before = F.col("_upto") - F.col("_n")
        hit = summed.filter((before <= F.col("_k")) & (F.col("_k") < F.col("_upto")))
        return hit.select(*keys, (F.col("_k") - before).alias("_k"), "_n", "_lo", "_hi")

    width = F.col("_hi") - F.col("_lo")
    place = F.when(width == 0, F.lit(0)).otherwise(
        F.floor((x - F.col("_lo")) / F.nullif(width, F.lit(0.0)) * (buckets - 1)).cast("int"))

    def still_open() -> int:
        return state.agg(F.max(F.when(F.col("_lo") < F.col("_hi"), F.col("_n")))).first()[0] or 0

    before, now = None, still_open()
    while now > open_rows and now != before:  # both ends are values: every pass leaves one out
        state = cut(step(state, place))
        before, now = now, still_open()
    return step(state, x).groupBy(*by).agg(F.avg("_lo").alias("MEDIAN"))
