"""Sources: one table per source x region level [x country], read with a declared schema."""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig
from ..schemas import source_columns, source_schema

# a file of up to 1 TiB is one split and one task; a task sees few lines before it stops
_PROBE = {
    "spark.sql.files.maxPartitionBytes": 1 << 40,
    "spark.sql.files.openCostInBytes": 1 << 40,
    "spark.sql.execution.arrow.maxRecordsPerBatch": 16,
}


def source_path(path: str, source: str, level: str, country: str | None = None,
                fmt: str = "csv") -> str:
    """`<path>/<SOURCE>_<LEVEL>[_<COUNTRY>].<fmt>`; globs in level or country are allowed."""
    return f"{path}/{'_'.join(p for p in (source, level, country) if p)}.{fmt}"


def read_source(spark: SparkSession, path: str, source: str, level: str,
                country: str | None = None, fmt: str = "csv",
                with_origin: bool = False) -> DataFrame:
    """Read one source at one level.

    A CSV file gets its types from the declared columns, matched to its own header by name: only
    header lines are read up front, all of them in one job, never the data. Files may have their
    columns in any order, or some of them only; those with the same header share one scan. `with_origin` adds
    LEVEL and COUNTRY taken from each file's name.
    """
    file = source_path(path, source, level, country, fmt)
    if fmt == "parquet":
        frames = [spark.read.parquet(file)]
    else:
        frames = [spark.read.schema(source_schema(source, header)).option("header", True).csv(files)
                  for header, files in _by_header(spark, source, file, fmt).items()]
    if with_origin:
        name = F.col("_metadata.file_path")
        pattern = rf"{source}_(NUTS\d)(?:_([A-Z0-9]{{2}}))?\.[a-z]+"
        frames = [df.select(
            "*",
            F.regexp_extract(name, pattern, 1).alias("LEVEL"),
            F.regexp_extract(name, pattern, 2).alias("COUNTRY"),
        ) for df in frames]
    return _merged(frames)


def _header_lines(spark: SparkSession, file: str) -> list[tuple[str, str]]:
    """(file, first line) of every file that has one, from one job.

    A file is one task, which stops at its first line instead of reading on. The settings for that
    belong to a session of its own, so the caller's stay as they are.
    """
    def first_line(batches):
        for lines in batches:
            named = lines[lines["value"].str.strip() != ""]
            if len(named):
                yield named.iloc[:1]
                return

    probe = spark.newSession()
    for name, value in _PROBE.items():
        probe.conf.set(name, value)
    lines = probe.read.text(file).where(F.col("_metadata.file_block_start") == 0).select(
        F.col("_metadata.file_path").alias("file"), "value")
    first = lines.mapInPandas(first_line, "file string, value string").collect()
    return [(unquote(r["file"]), r["value"]) for r in first]


def _columns(line: str) -> tuple[str, ...]:
    """Column names of a header line; nameless and repeated ones are named as Spark does."""
    names = next(csv.reader([line.removeprefix("\ufeff")]))
    times = Counter(name.lower() for name in names)
    return tuple(f"_c{i}" if not name else f"{name}{i}" if times[name.lower()] > 1 else name
                 for i, name in enumerate(names))


def _by_header(spark: SparkSession, source: str, file: str, fmt: str
               ) -> dict[tuple[str, ...], list[str]]:
    """Header -> the CSV files behind a path that have it, or their folder of part files.

    Files without a line hold nothing. Where all are like that, the table is empty and has the
    declared columns."""
    folders: dict[str, dict[tuple[str, ...], list[str]]] = {}
    for name, line in _header_lines(spark, file):
        folder = name.rsplit("/", 1)[0]
        folders.setdefault(folder, {}).setdefault(_columns(line), []).append(name)
    headers: dict[tuple[str, ...], list[str]] = {}
    for folder, found in sorted(folders.items()):
        for header, names in found.items():
            one = len(found) == 1 and folder.endswith(f".{fmt}")
            headers.setdefault(header, []).extend([folder] if one else sorted(names))
    return headers or {source_columns(source): [file]}


def _merged(frames: list[DataFrame]) -> DataFrame:
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged


def read_levels(spark: SparkSession, path: str, source: str, levels: Iterable[str],
                country: str | None = None, fmt: str = "csv") -> DataFrame:
    """Read a source at several levels into one DataFrame with a LEVEL column."""
    frames = [
        read_source(spark, path, source, level, country, fmt).withColumn("LEVEL", F.lit(level))
        for level in levels
    ]
    return _merged(frames)


def load_all(spark: SparkSession, cfg: RunConfig,
             sources: dict[str, str] | Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Lazily load every configured source.

    `sources` maps a source to its level (or levels), or merely lists sources read at the
    configured level, where remote sensing is only available at NUTS2. Every weather source is
    stored under METEO.
    """
    wanted = cfg.sources if sources is None else sources
    if not isinstance(wanted, dict):
        wanted = {s: "NUTS2" if s == "REMOTE_SENSING" else cfg.nuts_level for s in wanted}
    loaded = {}
    for source, level in wanted.items():
        read = read_source if isinstance(level, str) else read_levels
        key = "METEO" if "METEO" in source else source
        loaded[key] = read(spark, cfg.data_path, source, level, cfg.country_code, cfg.file_format)
    return loaded
