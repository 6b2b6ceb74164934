"""Random sharding by a two-pass external shuffle.

Pass one scatters records uniformly into buckets that fit in memory, by a seeded hash. Pass two
shuffles each bucket in memory (Fisher-Yates) and writes it. Buckets laid end to end are a random
order of everything; dealing that order out in turn gives shards whose row counts differ by one at
most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonframe.storage import cut

BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 1 << 20
ROW_BYTES = 64


def fisher_yates(count: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation: every place from the last down swaps with one not above it."""
    order = np.arange(count)
    chosen = rng.integers(0, np.arange(count, 0, -1))
    for i, j in zip(range(count - 1, 0, -1), chosen):
        order[i], order[j] = order[j], order[i]
    return order


def shuffle_into_shards(records: DataFrame, shards: int = 8, seed: int = 0,
                        size: str | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Records with shard (0 to shards - 1) and slot (gapless from 0 in every shard).

    `size` names a column with a record's bytes; from it comes the number of buckets. The bucket
    also depends on a row's place in the input, so rows that repeat, however often, scatter too.
    The shuffled buckets are written once and read from there, so retried tasks cannot disagree.
    Records move once, in the scatter: where each bucket begins is one number per bucket, of which
    there are MOST_BUCKETS at most (buckets grow beyond), and tasks add it to the written places.
    Columns named shard or slot are replaced; all others stay, whatever their names.
    """
    names = [c for c in records.columns if c not in ("shard", "slot")]
    inner = [f"c{i}" for i in range(len(names))]  # so that no name of theirs gets in the way
    cost = F.lit(ROW_BYTES) + (F.coalesce(F.col(f"`{size}`"), F.lit(0)) if size else F.lit(0))
    total = int(records.select(F.sum(cost)).first()[0] or 0)
    buckets = max(1, -(-total // max(bucket_bytes, -(-total // MOST_BUCKETS))))
    columns = [F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)]
    key = F.xxhash64(F.lit(seed), *columns, F.monotonically_increasing_id())
    scattered = records.select(
        F.pmod(key, F.lit(buckets)).alias("bucket"), key.alias("place"), *columns)

    def shuffle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable")
        number = int(rows["bucket"].iloc[0])
        rows["place"] = fisher_yates(
            len(rows), np.random.Generator(np.random.PCG64([seed, number])))
        return rows.sort_values("place")

    shuffled = cut(scattered.groupBy("bucket").applyInPandas(shuffle, scattered.schema))
    counts = np.zeros(buckets, np.int64)
    for part in shuffled.groupBy("bucket").count().toArrow().to_batches():
        counts[part.column(0).to_numpy()] = part.column(1).to_numpy()
    begins = records.sparkSession.sparkContext.broadcast(np.cumsum(counts) - counts)

    def number(batches):
        for batch in batches:
            order = begins.value[batch.column("bucket").to_numpy()] + batch.column("place").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in inner), pa.array((order % shards).astype(np.int32)),
                 pa.array(order // shards)], [*inner, "shard", "slot"])

    kinds = "".join(f"{i} {records.schema[c].dataType.simpleString()}, "
                    for c, i in zip(names, inner))
    return shuffled.mapInArrow(number, f"{kinds}shard int, slot long").select(
        *(F.col(i).alias(c) for c, i in zip(names, inner)), "shard", "slot")


def write_shards(records: DataFrame, path: str, shards: int = 8, **options) -> None:
    """Write one folder per shard; rows in a shard's files are in slot order."""
    dealt = shuffle_into_shards(records, shards, **options)
    dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard").parquet(path)


def shard_report(documents: DataFrame, shards: int = 8) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes and 1; null: 1), text_crc32, law, shard, slot, grown_shard.

    The law is `rows`. Empty and null texts are records like any other.
    """
    rows = documents.select("doc_id", "text", (
        F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"))
    dealt = shuffle_into_shards(rows, shards, size="size")
    return dealt.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
