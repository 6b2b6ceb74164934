"""Sinks: feature and prediction tables, named after the run that produced them."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import RunConfig


_SCHEMA = "_schema"  # next to the part files of a CSV table, which readers of the data skip


def output_name(kind: str, cfg: RunConfig, level: str | None = None) -> str:
    """`<kind>_<crop>_<country>[_<level>]_{trend,notrend}[_early<d>]`."""
    parts = [
        kind, cfg.crop_name.replace(" ", "_"), cfg.country_code, level,
        "trend" if cfg.use_yield_trend else "notrend",
        f"early{cfg.early_season_end_dekad}" if cfg.early_season_prediction else None,
    ]
    return "_".join(str(p) for p in parts if p)


def _write(df: DataFrame, target: str, fmt: str, partition: str | None = None) -> str:
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition)
    if fmt == "csv":
        writer.option("header", True).csv(target)
        kinds = df.sparkSession.createDataFrame([(df.schema.json(),)], "value string")
        kinds.coalesce(1).write.mode("overwrite").text(f"{target}/{_SCHEMA}")
    else:
        writer.parquet(target)
    return target


def _typed(df: DataFrame) -> DataFrame:
    """CSV without a schema next to it: region and split stay strings, years become int, all else
    double."""
    kinds = {"IDREGION": "string", "SPLIT": "string", "FYEAR": "int"}
    return df.select(*[F.col(f"`{c}`").cast(kinds.get(c, "double")).alias(c) for c in df.columns])


def _read(spark: SparkSession, target: str, fmt: str) -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(target)
    try:
        kinds = spark.read.text(f"{target}/{_SCHEMA}").first()["value"]
    except AnalysisException:
        return _typed(spark.read.option("header", True).csv(target))
    return spark.read.schema(StructType.fromJson(json.loads(kinds))).option("header", True).csv(target)


def save_features(df: DataFrame, path: str, cfg: RunConfig, fmt: str = "parquet") -> str:
    """Write the combined feature table, one directory per SPLIT; returns its location."""
    return _write(df, f"{path}/{output_name('ft', cfg)}", fmt, "SPLIT")


def load_features(spark: SparkSession, path: str, cfg: RunConfig,
                  fmt: str = "parquet") -> DataFrame:
    return _read(spark, f"{path}/{output_name('ft', cfg)}", fmt)


def save_predictions(df: DataFrame, path: str, cfg: RunConfig, level: str | None = None,
                     fmt: str = "parquet") -> str:
    return _write(df, f"{path}/{output_name('pred', cfg, level or cfg.nuts_level)}", fmt)


def load_predictions(spark: SparkSession, path: str, cfg: RunConfig, level: str | None = None,
                     fmt: str = "parquet") -> DataFrame:
    return _read(spark, f"{path}/{output_name('pred', cfg, level or cfg.nuts_level)}", fmt)


def save_national_predictions(df: DataFrame, path: str, cfg: RunConfig,
                              fmt: str = "parquet") -> str:
    return save_predictions(df, path, cfg, "NUTS0", fmt)
