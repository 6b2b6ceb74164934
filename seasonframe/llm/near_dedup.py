"""MinHash near-duplicate groups with sequential Bayesian verification.

Signatures are banded; documents that share a band are candidates. Candidates are compared batch
by batch of their signatures and dropped as soon as the posterior probability of reaching the
wanted similarity is below the chosen miss probability; survivors are confirmed on full shingle
sets. Candidates are never listed pair by pair:

1. Documents with equal shingle sets form a class; only one document of each class goes on.
2. Every class is compared with one leader: the first class of the bucket it shares most with.
3. Where a bucket still holds several components, members of the smaller are compared with all
   members of large ones, then members of small components with each other (in the first bucket
   that two of them share), in blocks of bounded size. A block skips what is linked already and
   returns at most one link per member and component. So no candidate stays untested.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonframe.llm.components import connected_components
from seasonframe.llm.hashing import minhash, mix, odd_factors, shingles, words
from seasonframe.llm.membership import may_be_among
from seasonframe.storage import cut

BANDS, ROWS = 40, 5
BATCH = 40
BLOCK_ROWS, BLOCK_BYTES = 256, 8 << 20
_KEYS = odd_factors(BANDS * ROWS)


@functools.lru_cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """Fewest equal values after each batch with which a pair goes on.

    With m of n values equal and a uniform prior, the similarity has a Beta(1 + m, 1 + n - m)
    posterior; a pair is pruned where its mass above the threshold is under `miss`.
    """
    grid = np.linspace(0, 1, 20001)[1:-1]
    above = grid >= threshold - 1e-12
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            mass = np.exp(log - log.max())
            if mass[above].sum() >= miss * mass.sum():
                break
        out.append(m)
    return tuple(out)


def _reaches(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _describe(n: int, full: bool):
    """Rows of (doc_id, text) to signatures, or to signatures and full sets."""
    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                items = shingles(words(text.as_py()), n)
                signature = minhash(items, _KEYS)
                if full:
                    rows.append((len(items), signature.tobytes(), items.tobytes()))
                    continue
                bands = np.arange(BANDS, dtype=np.uint64)
                for column in signature.reshape(BANDS, ROWS).T.astype(np.uint64):
                    bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + column)
                rows.append((len(items), xxhash.xxh3_128_digest(items.tobytes()),
                             bands.view(np.int64) if len(items) else None))
            sizes, first, second = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(first, pa.binary()),
                 pa.array(second, pa.binary() if full else pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "a", "b"])
    return run


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def signatures(documents: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) per row; bands are null for an empty set."""
    return _texts(documents).mapInArrow(
        _describe(n, False), "doc_id long, n_shingles long, a binary, b array<bigint>"
    ).withColumnsRenamed({"a": "set_key", "b": "bands"})


def _pair_links(percent: int, miss: float):
    """Pairs with both signatures and sets to those that are links."""
    def run(batches):
        floors = least_matches(percent / 100, miss)
        for batch in batches:
            keep = []
            columns = [batch.column(c) for c in ("sig_a", "sig_b", "set_a", "set_b")]
            for i in range(batch.num_rows):
                sig_a, sig_b = (np.frombuffer(c[i].as_py(), np.uint32) for c in columns[:2])
                equal = (sig_a == sig_b).reshape(-1, BATCH).sum(axis=1).cumsum()
                if (equal < floors).any():
                    continue
                a, b = (np.frombuffer(c[i].as_py(), np.uint64) for c in columns[2:])
                if _reaches(_common(a, b), len(a), len(b), percent):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
    return run


def block_links(block: pd.DataFrame, percent: int, miss: float) -> list[tuple[int, int]]:
    """Links between the two sides of a block (or within it, if there is one side only).

    With `band`, pairs that agree on an earlier band are left to the bucket they share there.
    """
    floors = least_matches(percent / 100, miss)
    block = block.sort_values("rep", kind="stable").reset_index(drop=True)
    reps = block["rep"].to_numpy()
    _, parts = np.unique(block["comp"].to_numpy(), return_inverse=True)
    sigs = np.stack([np.frombuffer(x, np.uint32) for x in block["sig"]])
    sets = [np.frombuffer(x, np.uint64) for x in block["set"]]
    side = block["side"].to_numpy()
    sides = np.unique(side)
    left = np.flatnonzero(side == sides[0])
    band = int(block["band"].iloc[0]) if len(block) else 0
    links = []
    for i in left:
        right = np.flatnonzero(side == sides[1]) if len(sides) > 1 else np.arange(i + 1, len(reps))
        right = right[parts[right] != parts[i]]
        equal = np.zeros(len(right), np.int64)
        for k, floor in enumerate(floors):
            span = slice(k * BATCH, (k + 1) * BATCH)
            equal += (sigs[right, span] == sigs[i, span]).sum(axis=1)
            stays = equal >= floor
            right, equal = right[stays], equal[stays]
        if band > 0:
            agree = (sigs[right, :band * ROWS] == sigs[i, :band * ROWS]).reshape(-1, band, ROWS)
            first = ~agree.all(axis=2).any(axis=1)
            right, equal = right[first], equal[first]
        for j in right[np.argsort(-equal, kind="stable")]:
            if parts[j] != parts[i] and _reaches(
                    _common(sets[i], sets[j]), len(sets[i]), len(sets[j]), percent):
                links.append((int(reps[i]), int(reps[j])))
                parts[parts == parts[j]] = parts[i]
    return links


def _spread(row_id, blocks):
    return F.pmod(F.xxhash64(row_id), blocks).cast("int")


def _blocks(rows, largest):
    """Blocks for so many sets, if the largest holds so many shingles of 8 bytes."""
    fit = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS),
                                       F.lit(BLOCK_BYTES) / (8 * F.greatest(largest, F.lit(1)))))
    return F.ceil(rows / F.floor(fit)).cast("int")


def _against_larger(mixed: DataFrame, present: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks that hold members of smaller components against whole larger ones."""
    large = present.where(F.col("size") > BLOCK_ROWS).select(
        "key", F.col("comp").alias("x"), F.col("size").alias("x_size"))
    sizes = present.select("comp", "size").distinct()
    left = mixed.join(large, (mixed["key"] == large["key"]) & (F.col("comp") != F.col("x"))).groupBy(
        "rep", "x").agg(F.first("comp").alias("comp"), F.first("x_size").alias("x_size"),
                        F.first("n_shingles").alias("n_shingles")).join(sizes, "comp").where(
        F.struct("size", "comp") < F.struct("x_size", "x"))
    groups = left.groupBy("x").agg(F.count("*").alias("rows"), F.max("n_shingles").alias("most"),
                                   F.first("x_size").alias("x_size")).select(
        "x", _blocks(F.col("rows"), F.col("most")).alias("p"),
        _blocks(F.col("x_size"), F.col("most")).alias("q"))
    left = left.select("rep", "comp", "x").join(groups, "x").select(
        "x", _spread("rep", F.col("p")).alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("j"), F.lit(-1).alias("band"),
        F.lit(0).alias("side"), "rep", "comp")
    right = labels.select(F.col("node").alias("rep"), F.col("root").alias("comp")).join(
        groups, F.col("comp") == F.col("x")).select(
        "x", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i"),
        _spread("rep", F.col("q")).alias("j"), F.lit(-1).alias("band"), F.lit(1).alias("side"),
        "rep", "comp")
    return left.unionByName(right)


def _among_small(mixed: DataFrame, present: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks of each bucket's members that were in small components, with their components now."""
    small = present.where((F.col("size") <= BLOCK_ROWS) & (F.col("several_small"))).select(
        "key", "comp")
    there = _labelled(mixed.join(small, ["key", "comp"]).drop("comp"), labels)
    buckets = there.groupBy("key").agg(
        F.count("*").alias("rows"), F.max("n_shingles").alias("most"),
        F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select(
        "key", _blocks(F.col("rows"), F.col("most")).alias("p"))
    placed = there.join(buckets, "key").withColumn("side", _spread("rep", F.col("p")))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).select(
        F.col("key").alias("x"), F.least("side", "other").alias("i"),
        F.greatest("side", "other").alias("j"), "band", "side", "rep", "comp")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with the component of rep; one without links is its own."""
    return rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "comp", F.coalesce("root", "rep")).drop("root")


def near_duplicates(documents: DataFrame, n: int = 5, percent: int = 80,
                    miss: float = 1e-9) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of documents.

    A document is the set of its distinct n-word shingles (words between ASCII white space, A-Z
    lower-cased; the whole sequence where it has fewer words). Two are linked where shared
    shingles make up `percent` of their union; component_id is the smallest doc_id that links
    reach. Null or blank texts have the empty set and are linked with nothing. Rows that repeat a
    doc_id are judged by their own texts; a null doc_id has no component and is kept. Two texts
    just at the threshold share no band with probability 1.3e-7 and are pruned with at most
    `miss`; a group only falls apart if all its links across that gap are missed.
    """
    described = cut(signatures(documents, n))
    classes = cut(described.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands")))
    banded = classes.select(F.posexplode("bands").alias("band", "key"), "rep", "n_shingles")
    leaders = banded.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")
                                        ).where("leader != last").drop("last")
    buckets = cut(banded.join(leaders, "key"))
    shared = buckets.where("rep != leader").groupBy("rep", "leader").agg(F.count("*").alias("c"))
    best = shared.groupBy("rep").agg(F.max(F.struct("c", -F.col("leader"))).alias("best"))
    pairs = best.select((-F.col("best.col2")).alias("a"), F.col("rep").alias("b"))
    involved = buckets.select(F.col("rep").alias("doc_id")).distinct()
    likely = may_be_among(involved, "doc_id")  # so that other texts are not shuffled
    sets = cut(_texts(documents).where(F.col("doc_id").isNotNull() & likely(F.col("doc_id")))
               .distinct().join(involved, "doc_id", "left_semi").mapInArrow(
        _describe(n, True), "doc_id long, n_shingles long, a binary, b binary").select(
        F.col("doc_id").alias("rep"), F.col("a").alias("sig"), F.col("b").alias("set")))

    sides = [sets.select(*(F.col(c).alias(f"{c}_{s}".replace(f"rep_{s}", s)) for c in sets.columns))
             for s in "ab"]
    links = cut(pairs.join(sides[1], "b").join(sides[0], "a").mapInArrow(
        _pair_links(percent, miss), "a long, b long"))

    def found(blocks: DataFrame) -> DataFrame:
        def run(block: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(block_links(block, percent, miss), columns=["a", "b"])
        return cut(blocks.join(sets, "rep").groupBy("x", "i", "j").applyInPandas(
            run, "a long, b long"))

    def joined(labels: DataFrame, new: DataFrame) -> DataFrame:
        if new.isEmpty():
            return labels
        known = labels.select(F.col("root").alias("a"), F.col("node").alias("b"))
        return cut(connected_components(known.unionByName(new)))

    labels = cut(connected_components(links))
    placed = _labelled(buckets.select("key", "band", "rep", "n_shingles"), labels)
    several = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")
                                        ).where("low != high").select("key")
    mixed = cut(placed.join(several, "key", "left_semi"))
    sizes = labels.groupBy(F.col("root").alias("comp")).agg(F.count("*").alias("size"))
    present = mixed.select("key", "comp").distinct().join(sizes, "comp", "left").na.fill(1, ["size"])
    several = present.where(F.col("size") <= BLOCK_ROWS).groupBy("key").agg(
        (F.count("*") > 1).alias("several_small"))
    present = cut(present.join(several, "key", "left").na.fill(False, ["several_small"]))
    labels = joined(labels, found(_against_larger(mixed, present, labels)))
    labels = joined(labels, found(_among_small(mixed, present, labels)))

    groups = classes.select("set_key", "rep").join(
        labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_key", F.coalesce("root", "rep").alias("component_id"))
    return described.select("doc_id", "n_shingles", "set_key").join(
        groups, "set_key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        .alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
