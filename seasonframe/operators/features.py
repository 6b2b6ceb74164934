"""Per-period features: aggregates, counts of extremes, and the combined feature table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import steady_sql
from .calendars import period_conditions, with_calendar

KEYS = ("IDREGION", "CAMPAIGN_YEAR")
SPLIT = "SPLIT"


@dataclass(frozen=True)
class FeatureSpec:
    """Indicators per period: maxima, averages, and those counted beyond 1 and 2 sigma."""

    maxima: Mapping[str, list[str]] = field(default_factory=dict)
    averages: Mapping[str, list[str]] = field(default_factory=dict)
    extremes: Mapping[str, list[str]] = field(default_factory=dict)


# Indicators used per source and period.
SPECS = {
    "WOFOST": FeatureSpec(
        maxima={
            "p2": ["WLIM_YB", "TWC", "WLAI"],
            "p4": ["WLIM_YB", "WLIM_YS", "TWC", "WLAI"],
        },
        averages={"p2": ["RSM"], "p4": ["RSM"]},
        extremes={"p1": ["RSM"], "p2": ["RSM"], "p3": ["RSM"], "p4": ["RSM"]},
    ),
    "METEO": FeatureSpec(
        averages={
            "p0": ["TAVG", "PREC", "CWB"],
            "p1": ["TAVG", "PREC"],
            "p2": ["TAVG", "CWB"],
            "p3": ["PREC"],
            "p4": ["CWB"],
            "p5": ["PREC"],
        },
        extremes={"p1": ["TMIN", "PREC"], "p3": ["PREC", "TMAX"], "p5": ["PREC"]},
    ),
    "REMOTE_SENSING": FeatureSpec(averages={"p2": ["FAPAR"], "p4": ["FAPAR"]}),
}


def _pairs(columns: Mapping[str, list[str]]):
    return [(period, name) for period, names in columns.items() for name in names]


def _period_columns(spec: FeatureSpec, filled: bool = False):
    """Maximum and average expressions of a spec, for rows that carry their calendar."""
    inside = period_conditions()
    exprs = {
        **{f"max{x}{p}": f"bround(max(CASE WHEN {inside[p]} THEN `{x}` END), 2)"
           for p, x in _pairs(spec.maxima)},
        **{f"avg{x}{p}": steady_sql(f"avg(CASE WHEN {inside[p]} THEN `{x}` END)", 2)
           for p, x in _pairs(spec.averages)},
    }
    return [F.expr(f"coalesce({e}, 0D) AS `{n}`" if filled else f"{e} AS `{n}`")
            for n, e in exprs.items()]


def _extreme_columns(spec: FeatureSpec, sigmas=(1, 2)):
    inside = period_conditions()
    exprs = []
    for p, x in _pairs(spec.extremes):
        mean, spread = f"`_lt_avg{x}{p}`", f"`_lt_std{x}{p}`"
        for i in sigmas:
            for name, beyond in (("gt", f"> {mean} + {i} * {spread}"),
                                 ("lt", f"< {mean} - {i} * {spread}")):
                exprs.append(F.expr(
                    f"count_if({inside[p]} AND `{x}` {beyond}) AS `{x}{p}{name}{i}STD`"))
    return exprs


def period_aggregates(df: DataFrame, calendar: DataFrame, spec: FeatureSpec,
                      keys=KEYS) -> DataFrame:
    """Maxima and averages of the spec per period; null where a period has no rows."""
    return with_calendar(df, calendar).groupBy(*keys).agg(*_period_columns(spec))


def fit_longterm_stats(df: DataFrame, calendar: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Mean and sample deviation per country of every indicator with counted extremes."""
    inside = period_conditions()
    aggregates = []
    for p, x in _pairs(spec.extremes):
        value = f"CASE WHEN {inside[p]} THEN `{x}` END"
        aggregates += [
            F.expr(f"{steady_sql(f'avg({value})', 2)} AS `avg{x}{p}`"),
            F.expr(f"{steady_sql(f'stddev_samp({value})', 2)} AS `std{x}{p}`")]
    return with_calendar(df, calendar).groupBy("COUNTRY").agg(*aggregates)


def _with_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Broadcast: one row per two-character country code."""
    renamed = stats.select("COUNTRY", *[
        F.col(c).alias(f"_lt_{c}") for c in stats.columns if c != "COUNTRY"])
    return df.join(F.broadcast(renamed), "COUNTRY")


def extreme_counts(df: DataFrame, calendar: DataFrame, stats: DataFrame, spec: FeatureSpec,
                   keys=KEYS, sigmas=(1, 2)) -> DataFrame:
    """Rows per period strictly beyond the long-term mean by 1 and by 2 deviations."""
    rows = _with_stats(with_calendar(df, calendar), stats)
    return rows.groupBy(*keys).agg(*_extreme_columns(spec, sigmas))


def period_features(df: DataFrame, calendar: DataFrame, spec: FeatureSpec,
                    stats: DataFrame | None = None, keys=KEYS) -> DataFrame:
    """All features of a spec in one aggregate. Missing values become 0 only where the spec
    counts extremes; otherwise they stay null."""
    if not spec.extremes:
        return period_aggregates(df, calendar, spec, keys)
    rows = _with_stats(with_calendar(df, calendar), stats)
    return rows.groupBy(*keys).agg(*_period_columns(spec, filled=True), *_extreme_columns(spec))


def build_features(series: DataFrame, calendar: DataFrame, spec: FeatureSpec,
                   keys=KEYS) -> DataFrame:
    """Features of a series whose rows carry SPLIT: statistics from training rows, features
    for training and test rows in the same pass."""
    stats = None
    if spec.extremes:
        stats = fit_longterm_stats(series.filter(F.col(SPLIT) == "train"), calendar, spec)
    return period_features(series, calendar, spec, stats, (*keys, SPLIT))


def from_year(df: DataFrame, yields: DataFrame, year: str = "CAMPAIGN_YEAR",
              train_only: bool = False) -> DataFrame:
    """Drop rows before the first training yield; with `train_only` test rows are exempt."""
    first = yields.filter(F.col(SPLIT) == "train").agg(F.min("FYEAR")).scalar()
    recent = F.col(year) >= first
    return df.filter(recent | (F.col(SPLIT) == "test") if train_only else recent)


def campaign_to_year(df: DataFrame) -> DataFrame:
    """Yields are keyed by the campaign year under the name FYEAR."""
    return df.withColumnRenamed("CAMPAIGN_YEAR", "FYEAR")


def column_usage(df: DataFrame, cols) -> DataFrame:
    """One row: `<col>_nonzero` and `<col>_null` counts."""
    return df.agg(*[F.expr(e) for c in cols for e in (
        f"count_if(`{c}` <> 0) AS `{c}_nonzero`", f"count_if(`{c}` IS NULL) AS `{c}_null`")])


def drop_zero_features(features: DataFrame, keep=("IDREGION", "FYEAR", SPLIT)) -> DataFrame:
    """Drop features that are all zero, or anywhere null, in the training rows.

    Which columns remain depends on the data, so this runs one small aggregate right away.
    """
    cols = [c for c in features.columns if c not in keep]
    usage = column_usage(features.filter(F.col(SPLIT) == "train"), cols).first()
    dead = [c for c in cols if usage[f"{c}_nonzero"] == 0 or usage[f"{c}_null"] > 0]
    return features.drop(*dead)


def combine_features(parts: Mapping[str, DataFrame], yields: DataFrame,
                     static: Mapping[str, DataFrame] | None = None,
                     counts: dict[str, Observation] | None = None) -> DataFrame:
    """Inner-join all feature tables and the label into one table per (IDREGION, FYEAR, SPLIT).

    The per-year tables are grouped by those very keys, so they join without a further
    shuffle; static region tables come last. Pass a dict as `counts` to have the row count after
    each step observed during execution instead of by extra jobs.
    """
    keys = ["IDREGION", "FYEAR", SPLIT]
    static = dict(static or {})
    combined, columns = None, []
    for name, part in {**parts, "YIELD": yields}.items():
        combined = part if combined is None else combined.join(part, keys)
        columns += [c for c in part.columns if c not in keys]
        combined = _observed(combined, name, counts)
    fixed = []
    for name, part in static.items():
        combined = _observed(combined.join(part, "IDREGION"), name, counts)
        fixed += [c for c in part.columns if c != "IDREGION"]
    return combined.select(*keys[:2], *[F.col(f"`{c}`") for c in (*fixed, *columns)], SPLIT)


def _observed(df: DataFrame, name: str, counts: dict | None) -> DataFrame:
    if counts is None:
        return df
    counts[name] = Observation(f"rows after {name}")
    return df.observe(counts[name], F.count(F.lit(1)).alias("rows"))


