"""Benchmark items inside documents, by size-partitioned MinHash containment search.

The Jaccard similarity of a 40-word item and a 20,000-word document is near zero however completely
the document holds the item, so signatures of whole documents find nothing. The sketch is taken of
the item only (its SKETCH smallest shingle hashes, a uniform sample of its shingles) and looked up
among the shingles of documents. A document that holds the wanted share of the item holds about
that share of the sketch. Size decides twice: items are partitioned by size into those small
enough for a certain number of hits and those where the number follows from the chosen miss
probability; and an item is looked up only in documents large enough to hold it. Candidates are
verified on exact shingles. Everything is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonframe.storage import cut

SKETCH = 16
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


# In what follows w is a column, never an expression: lambdas would evaluate that once per element.
def _starts(w: Column, n: int) -> Column:
    return F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
                  ).otherwise(F.array().cast("array<int>"))


def shingle_hashes(w: Column, n: int) -> Column:
    """Hash of every n words in a row; fewer words count as one sequence."""
    return F.transform(_starts(w, n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))


def shingle_texts(w: Column, n: int) -> Column:
    return F.array_distinct(F.transform(
        _starts(w, n), lambda i: F.concat_ws(" ", F.slice(w, i + 1, F.lit(n)))))


def least_hits(k: int, share: float, miss: float) -> int:
    """Most hits that a holder of the share of an item has among k samples, but for `miss`."""
    total = 0.0
    for hits in range(k + 1):
        total += math.comb(k, hits) * share**hits * (1 - share)**(k - hits)
        if total > miss:
            return max(hits, 1)
    return k


def _bounded(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it has at most BROADCAST_ROWS rows of a few dozen bytes."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, n: int = 5, percent: int = 80,
                   miss: float = 1e-9) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) where a document holds `percent` of the
    distinct n-word shingles of an item.

    Words are lower-cased runs of letters and digits, so case, punctuation and line breaks do not
    hide an item; a text of fewer than n words is one shingle, so an item of fewer is only found in
    a document that is as short and equal, never inside a longer one (a clause in a script without
    blanks is one word). Null and wordless texts, null
    doc_id and null item_id match nothing. Rows that repeat a doc_id count as one document, rows
    that repeat an item_id as one item; either may be of any type that can be joined on. A holder is missed with probability `miss` at most, and
    only where an item has more than SKETCH shingles.
    """
    items = cut(benchmark.where("item_id IS NOT NULL").select(
        "item_id", words(F.col("text")).alias("w")).select(
        "item_id", F.explode(shingle_hashes(F.col("w"), n)).alias("h")).distinct())
    sizes = items.groupBy("item_id").agg(F.count("*").alias("n_item"),
                                         F.array_sort(F.collect_set("h")).alias("all"))
    sampled = sizes.select("item_id", "n_item", F.slice("all", 1, SKETCH).alias("sketch"))
    wanted = F.ceil(F.col("n_item") * percent / 100)
    certain = F.size("sketch") - (F.col("n_item") - wanted)
    probes = _bounded(sampled.select(
        "item_id", wanted.alias("wanted"), F.explode("sketch").alias("h"),
        F.greatest(certain, F.when(F.size("sketch") < SKETCH, F.lit(1)).otherwise(
            least_hits(SKETCH, percent / 100, miss))).alias("hits")))
    shingled = documents.where("doc_id IS NOT NULL").select(
        "doc_id", words(F.col("text")).alias("w")).select(
        "doc_id", F.size("w").alias("n_words"), F.explode(shingle_hashes(F.col("w"), n)).alias("h"))
    candidates = _bounded(
        shingled.join(probes, "h").groupBy("doc_id", "item_id").agg(
            F.count_distinct("h").alias("found"), F.first("hits").alias("hits"),
            F.first("wanted").alias("wanted"), F.sum("n_words").alias("n_words"))
        .where("found >= hits AND n_words >= wanted").select("doc_id", "item_id"))

    whole = benchmark.join(candidates.select("item_id").distinct(), "item_id", "left_semi").select(
        "item_id", words(F.col("text")).alias("w")).select(
        "item_id", F.explode(shingle_texts(F.col("w"), n)).alias("shingle")).distinct()
    asked = candidates.join(whole, "item_id")
    counts = whole.groupBy("item_id").agg(F.count("*").alias("n_item"))
    found = documents.select("doc_id", "text").join(
        candidates.select("doc_id").distinct(), "doc_id", "left_semi").select(
        "doc_id", words(F.col("text")).alias("w")).select(
        "doc_id", F.explode(shingle_texts(F.col("w"), n)).alias("shingle"))
    return found.join(asked, ["doc_id", "shingle"]).groupBy("doc_id", "item_id").agg(
        F.count_distinct("shingle").alias("n_shared")).join(counts, "item_id").where(
        F.col("n_shared") * 100 >= F.col("n_item") * percent).select(
        "doc_id", "item_id", "n_shared", "n_item",
        (F.col("n_shared") / F.col("n_item")).alias("containment"))
