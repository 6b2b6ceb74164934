"""The grid of experiments as a table of run options."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CROP_IDS

# Crops, countries with their level, early-season dekads, kinds of experiment.
CROPS = ("potatoes", "sugar beets", "spring barley", "sunflower")
COUNTRY_LEVELS = {"NL": "NUTS2", "FR": "NUTS3", "DE": "NUTS3"}
# by crop id, since a crop goes by several names
EARLY_DEKADS = {7: 18, 6: 21, 95: 18, 93: 18}
KINDS = {
    "rand": ("N", "N"),
    "trend": ("Y", "N"),
    "rand-early": ("N", "Y"),
    "trend-early": ("Y", "Y"),
}


def experiment_grid(spark: SparkSession, crops: Sequence[str] = CROPS,
                    countries: Mapping[str, str] = COUNTRY_LEVELS) -> DataFrame:
    """One row per crop, country and kind, with the options that kind of run sets."""
    def rows(names, values):
        return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)])
                         for row in values])

    crop = rows(("crop_name", "early_season_end_dekad"),
                [(c, EARLY_DEKADS.get(CROP_IDS[c])) for c in crops])
    country = rows(("country_code", "nuts_level"), list(countries.items()))
    kind = rows(("experiment", "use_yield_trend", "early_season_prediction"),
                [(k, *flags) for k, flags in KINDS.items()])
    return (
        spark.range(1).select(F.inline(crop))
        .select("*", F.inline(country)).select("*", F.inline(kind))
    )
