"""Features ranked one by one, by mutual information with the label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .moments import quoted

BINS = 10


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    place = F.floor((value - low) / (high - low) * bins)
    return F.when(high > low, F.least(place, F.lit(bins - 1))).otherwise(0).cast("int")


def mutual_information(df: DataFrame, features: Sequence[str], label: str,
                       bins: int = BINS) -> DataFrame:
    """(FEATURE, MI, N) in nats, of features and label in `bins` bins of equal width.

    Bins go from the least to the largest value over rows with a label; a feature's nulls are left
    out of its own row, and a feature without any value has MI null and N 0. One aggregate finds the
    ranges and one counts (feature, bin, bin), at most features x bins² groups after partial
    aggregation; all else works on those counts.
    """
    names = list(features)
    rows = df.select(F.col(f"`{label}`").cast("double").alias("y"), *(
        F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(quoted(names)))).filter(
        "y IS NOT NULL")
    columns = ["y", *(f"x{i}" for i in range(len(names)))]
    ends = rows.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (
        ("low", F.min), ("high", F.max)))).first()

    def binned(c: str) -> Column:
        return _bin(F.col(c), *(F.lit(ends[f"{n}_{c}"]).cast("double") for n in ("low", "high")), bins)
    cells = rows.select(F.explode(F.array(*(F.struct(
        F.lit(i).alias("i"), F.col(f"x{i}").isNotNull().alias("known"), binned(f"x{i}").alias("a"),
        binned("y").alias("b")) for i in range(len(names))))).alias("c")).filter("c.known").groupBy(
        "c.i", "c.a", "c.b").agg(F.count(F.lit(1)).alias("n"))
    total, of_a, of_b = (F.sum("n").over(Window.partitionBy(*k)) for k in (["i"], ["i", "a"], ["i", "b"]))
    found = cells.withColumns({"total": total, "of_a": of_a, "of_b": of_b}).groupBy("i").agg(
        F.sum(F.col("n") / F.col("total") * F.log(
            F.col("n") * F.col("total") / (F.col("of_a") * F.col("of_b")))).alias("MI"),
        F.first("total").alias("N"))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1)
    every = df.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("i"))
    return every.join(found, "i", "left").select(
        name.alias("FEATURE"), "MI", F.coalesce("N", F.lit(0)).cast("long").alias("N"))


def best_features(df: DataFrame, features: Sequence[str], label: str, sizes: Sequence[int],
                  bins: int = BINS) -> dict[int, list[str]]:
    """The features with the most information for each size, in their own order; of equals (to 9
    decimals) the first."""
    found = {r["FEATURE"]: r["MI"] for r in mutual_information(df, features, label, bins).collect()}
    ranked = sorted(range(len(features)), key=lambda i: -round(found[features[i]] or 0.0, 9))
    return {s: [features[i] for i in sorted(ranked[:s])] for s in sizes}
