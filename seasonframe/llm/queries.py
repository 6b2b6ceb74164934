"""The operators as registered queries over the star schema's text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seasonframe.llm.decontaminate import benchmark_hits
from seasonframe.llm.hard_negatives import negatives_report
from seasonframe.llm.importance import quality_sample
from seasonframe.llm.language_id import language_report
from seasonframe.llm.near_dedup import near_duplicates
from seasonframe.llm.packing import packed_documents
from seasonframe.llm.pii import pii_report
from seasonframe.llm.prefix_trie import trie_report
from seasonframe.llm.repeats import repeats_report
from seasonframe.llm.secrets import secret_report
from seasonframe.llm.sharding import shard_report
from seasonframe.llm.token_matrix import token_matrix
from seasonframe.llm.vector_search import embedding_neighbours
from seasonframe.llm.workers import importable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(operator):
    return lambda spark, sf_dir: operator(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language": _documents(language_report),
    "op2_pii": _documents(pii_report),
    "op3_packing": _documents(packed_documents),
    "op4_top_k": lambda spark, sf_dir: embedding_neighbours(_table(spark, sf_dir, "embeddings")),
    "op5_shards": _documents(shard_report),
    "op6_secrets": _documents(secret_report),
    "op7_token_matrix": _documents(token_matrix),
    "op8_quality_sample": lambda spark, sf_dir: quality_sample(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")),
    "op9_near_duplicates": _documents(lambda docs: near_duplicates(docs, n=2)),
    "op10_benchmark_hits": lambda spark, sf_dir: benchmark_hits(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")),
    "op11_repeats": _documents(repeats_report),
    "op12_hard_negatives": lambda spark, sf_dir: negatives_report(
        _table(spark, sf_dir, "embeddings")),
    "op13_prefix_trie": lambda spark, sf_dir: trie_report(_table(spark, sf_dir, "conversations")),
}
