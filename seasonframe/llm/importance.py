"""Quality selection by importance resampling.

Two generative models over hashed word uni- and bigrams are counted, one on target texts and one on
all raw texts. A text's weight is the log ratio of its likelihood under both, the sum over all its
n-grams. Gumbel noise on the log weights and a top-k make the choice a sample without replacement
in proportion to the likelihood ratios.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonframe.llm.hashing import mix, words
from seasonframe.storage import cut

BUCKETS = 10_000
FRACTION = 0.5
FILTER_BITS = 1 << 24  # 2 MB, whatever the number of targets
_PROBES = 2
_STEP = 16


def ngram_buckets(text: str | None) -> np.ndarray:
    """Buckets of all words and pairs of words of the whole text."""
    single = words(text)
    pairs = mix(single[:-1] * np.uint64(3) + single[1:])
    return (np.concatenate([single, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def count_model(rows: DataFrame) -> np.ndarray:
    """Counts per bucket over all texts; BUCKETS numbers come back."""
    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                counts += np.bincount(ngram_buckets(text.as_py()), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BUCKETS)), pa.array(counts)], ["bucket", "n"])
    summed = rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS, np.int64)
    for r in summed.collect():
        counts[r["bucket"]] = r["n"]
    return counts


def _probes():
    """Places of a doc_id in the filter, as columns."""
    return [F.pmod(F.xxhash64(F.lit(i), "doc_id"), F.lit(FILTER_BITS)) for i in range(_PROBES)]


def target_texts(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of texts whose doc_id is among the targets.

    A Bloom filter of fixed size keeps most other texts from being shuffled; the join decides. More
    targets than the filter is made for let more texts through to the join and change nothing else.
    """
    spark = texts.sparkSession
    bit = F.explode(F.array(*_probes()))
    filled = targets.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits"))
    table = np.zeros(FILTER_BITS >> 6, np.int64)
    for r in filled.collect():  # a row a word of the filter at most
        table[r["word"]] = r["bits"]
    shared = spark.sparkContext.broadcast(table.view(np.uint64))

    def run(batches):
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for i in range(_PROBES):
                at = batch.column(2 + i).to_numpy(zero_copy_only=False).astype(np.uint64)
                keep &= (shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
            yield batch.select([0, 1]).filter(pa.array(keep))
    likely = texts.where("doc_id IS NOT NULL").select("doc_id", "text", *(
        p.alias(f"p{i}") for i, p in enumerate(_probes()))).mapInArrow(
        run, texts.select("doc_id", "text").schema)
    return likely.join(targets.hint("merge"), "doc_id", "left_semi")


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target over raw probability per bucket, with one added to every count."""
    target, raw = (np.log((c + 1) / (c.sum() + BUCKETS)) for c in (target, raw))
    return target - raw


def weigh(rows: DataFrame, ratios: np.ndarray, seed: int = 0, scale: int | None = None) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, place): place orders whole numbers as the keys do.

    The log weight sums the ratios of all n-grams; with `scale` it is brought to a text of that
    many n-grams, so that long and short texts compare. Noise hashes doc_id and text.
    """
    shared = rows.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        for batch in batches:
            weights = []
            for text in batch.column("text"):
                found = ngram_buckets(text.as_py())
                total = shared.value[found].sum() if len(found) else np.nan
                weights.append(total if scale is None or not len(found) else
                               total * scale / len(found))
            weights = np.array(weights, float)
            noise = mix(batch.column("noise").to_numpy().view(np.uint64))
            uniform = ((noise >> np.uint64(12)).astype(float) + 0.5) / 2**52
            keys = weights - np.log(-np.log(uniform))
            bits = keys.view(np.int64)
            place = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
            none = np.isnan(keys)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, mask=none) for x in (weights, keys, place))],
                ["doc_id", "log_weight", "gumbel_key", "place"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("noise")
                       ).mapInArrow(run, f"doc_id {kind}, log_weight double, gumbel_key double, "
                                         "place long")


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest whole number of a column, exactly: 16 bits a pass, counts only."""
    low, high = -2**63, 2**63 - 1
    for bits in range(64 - _STEP, -1, -_STEP):
        part = F.shiftright(F.col(column) - F.lit(low), bits) if low != -2**63 else \
            F.shiftright(F.col(column), bits)
        counts = rows.where(F.col(column).between(low, high)).groupBy(part.alias("p")).count()
        found = sorted(((r["p"], r["count"]) for r in counts.collect()), reverse=True)
        base = low if low != -2**63 else 0
        for p, count in found:
            if k <= count:
                low = base + (p << bits)
                high = low + (1 << bits) - 1
                break
            k -= count
        else:
            return None
    return low


def quality_sample(documents: DataFrame, labels: DataFrame, fraction: float = FRACTION,
                   seed: int = 0, scale: int | None = None) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, selected) per row of documents.

    Targets are all documents labelled of quality 1 and not toxic; a null doc_id is no target. Raw
    counts and weights cover all texts. The `fraction` with the largest keys is selected; rows with
    the very key of the last one are too. Null and blank texts have no weight and are not selected.
    Noise depends on doc_id and text, so rows that repeat are selected together. Ids of any type
    will do; other columns are not looked at. `scale`: see `weigh`.
    """
    texts = documents.select("doc_id", "text")
    targets = cut(labels.where(
        "quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(
        F.col("doc_id").cast(texts.schema["doc_id"].dataType).alias("doc_id")).distinct())
    ratios = log_ratios(count_model(target_texts(texts, targets)), count_model(texts))
    weighed = cut(weigh(texts, ratios, seed, scale))
    known = weighed.where("place IS NOT NULL")
    last = kth_largest(known, "place", max(1, round(fraction * known.count())))
    chosen = F.coalesce(F.col("place") >= F.lit(last), F.lit(False))
    return weighed.select("doc_id", "log_weight", "gumbel_key", chosen.alias("selected"))
