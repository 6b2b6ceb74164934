"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe.llm.decontaminate import benchmark_hits
from seasonframe.llm.language_id import UNKNOWN, predict_language, train_model
from seasonframe.llm.membership import may_be_among
from seasonframe.llm.near_dedup import near_duplicates
from seasonframe.llm.packing import packed_documents
from seasonframe.llm.secrets import redact_secrets
from seasonframe.llm.workers import importable
from seasonframe.storage import cut


def _free(name: str, docs: DataFrame) -> str:
    """The name, or the next like it that is no column yet."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (null, or no letter at all) go."""
    importable(spark)
    model = train_model(docs)
    if model is None:  # nothing to learn from, so nothing to reject by but the lack of letters
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = _free("_found", docs)
    score = _free("_found_score", docs)
    return predict_language(docs, model, into=(found, score)).where(
        F.col(found) != UNKNOWN).select(docs.columns)


def _worded() -> Column:
    """Whether the text has a word, as near_duplicates takes words."""
    return F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def _hashed(*first: int) -> Column:
    return F.xxhash64(*map(F.lit, first), "text")


def _text_keys(docs: DataFrame) -> tuple[Column, DataFrame]:
    """64 bits of the text that tell apart all texts with a word (as 128 bits do), and a table of
    those texts: key, rows that have it, least doc_id."""
    for seed in count():
        key = _hashed(seed)
        texts = cut(docs.where(_worded()).select(key.alias("key"), _hashed(seed, 1).alias("other"),
                                                 "doc_id")
                    .groupBy("key").agg(F.min("other").alias("low"), F.max("other").alias("high"),
                                        F.count("*").alias("rows"), F.min("doc_id").alias("doc_id")))
        if texts.where("low != high").isEmpty():
            return key, texts.drop("low", "high")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, 80 % shared) stays.

    Groups are found by the text alone, so rows that repeat a doc_id or have none are rows like any
    other; all texts without a word stay. The row with the smallest doc_id stays, before those
    without one. Rows alone in their group, which a filter tells, are not shuffled.
    """
    importable(spark)
    key, texts = _text_keys(docs)
    found = near_duplicates(docs.select(key.alias("doc_id"), "text"))
    placed = found.where("n_shingles > 0").select(
        F.col("doc_id").alias("key"), "component_id").distinct().join(texts, "key")
    groups = placed.groupBy("component_id").agg(F.sum("rows").alias("all"), F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    name = _free("_key", docs)
    shared = cut(placed.join(groups.where("all > 1"), "component_id").select(
        F.col("key").alias(name), (F.col("key") != F.col("first.key")).alias("goes")))
    likely = _worded() & may_be_among(shared, name)(key)
    rest = [F.col(f.name) for f in docs.schema.fields if f.name not in ("doc_id", "text")
            and "map<" not in f.dataType.simpleString()]
    of_text = docs.where(likely).groupBy(key.alias(name)).agg(F.min_by(
        F.struct(*docs.columns), F.struct(F.col("doc_id").isNull(), "doc_id", *rest)).alias("row"))
    return docs.where(~likely).unionByName(
        of_text.join(shared.where("goes"), name, "left_anti").select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go, those without a doc_id too; others that share
    their doc_id stay. The text alone decides, so 128 bits of it are the key."""
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text", F.lit(2)).alias("b"))
    hits = benchmark_hits(docs.select(key.alias("doc_id"), "text"),
                          spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    name = _free("_key", docs)
    gone = hits.select(F.col("doc_id").alias(name)).distinct()
    return docs.withColumn(name, key).join(gone, name, "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in it are replaced, and n_chars follows where it is there."""
    importable(spark)
    into = _free("_redacted", docs)
    changed = {"text": F.col(into)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("text").eqNullSafe(F.col(into)), F.col("n_chars")
                                    ).otherwise(F.length(into)).cast(
            docs.schema["n_chars"].dataType)
    return redact_secrets(docs, into=into).select(
        *(changed.get(c, F.col(c)).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in packed sequences."""
    importable(spark)
    return packed_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("packing", packing),
]

#: The language model and the packing have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
