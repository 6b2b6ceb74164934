"""Settings for Python workers that handle whole texts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def importable(spark: SparkSession) -> None:
    """Add the folder this package was imported from to the workers' search path, and keep batches
    small: a row is a whole text or shingle set, and Spark's 10,000 of them take much memory."""
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([*paths, root])
