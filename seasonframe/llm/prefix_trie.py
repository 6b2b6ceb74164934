"""A trie of conversations by their shared first turns, with totals per subtree.

A node stands for the first d turns of its members. It is known by 128 bits: sums, over the turns,
of hashes of each turn together with its place, so that prefixes are running sums and a long
conversation can be summed in parts. Totals come from parallel tree contraction.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonframe.llm.tree_contraction import subtree_totals
from seasonframe.storage import cut

#: Turns of a conversation that are summed together.
PART = 4096
_SUMS = ["s1", "s2", "s3", "s4"]
EMPTY = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, h1, h2, chars): turns numbered from 1 in every conversation, by turn (null
    first); equal turns by role, then the first 64 characters of the text, then a hash of it.

    A null role or text is empty; rows without a conv_id are left out. Rows are ordered over all
    tasks and numbered per task and conversation first, so one conversation may fill many tasks.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.substring(text, 1, 64).alias("begin"), F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(1), text, role, F.lit(2)).alias("h2"), F.length(text).alias("chars"),
        F.xxhash64(F.monotonically_increasing_id()).alias("any"))
    order = ["turn", "role", "begin", "h1", "any"]
    parts = cut(rows.repartitionByRange("conv_id", *order).withColumn(
        "part", F.spark_partition_id()))
    local = Window.partitionBy("conv_id", "part").orderBy(*order)
    before = Window.partitionBy("conv_id").orderBy("part")
    counts = parts.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select(
        "conv_id", "part", (F.sum("n").over(before) - F.col("n")).alias("before"))
    return parts.withColumn("place", F.row_number().over(local).cast("long")).join(
        counts, ["conv_id", "part"]).select(
        "conv_id", (F.col("place") + F.col("before")).alias("place"), "h1", "h2", "chars")


def rebuilt(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: (conv_id, place, h1, h2, chars) and (conv_id, length).

    Conversation c takes the first h turns of conversation c - c % block (as many as there are, if
    that exists; % as in SQL, with the sign of c) and then its own after its first h, where h is
    the CRC-32 of its decimal id modulo `most`. One may have no turn left.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    source = F.col("conv_id") - F.col("conv_id") % block
    of_source = own.where(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("source"), F.col("n").alias("there"))
    wanted = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    plan = own.withColumn("source", source).withColumn("h", wanted).join(
        of_source, "source", "left").withColumn(
        "taken", F.least("h", F.coalesce("there", F.lit(0))))
    plan = cut(plan.select("conv_id", "source", "h", "taken", (
        F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    heads = turns.where((F.col("conv_id") % block == 0) & (F.col("place") < most)
                        ).withColumnRenamed("conv_id", "source")
    taken = plan.join(heads, "source").where("place <= h").select(
        "conv_id", "place", "h1", "h2", "chars")
    tails = turns.join(plan.drop("source"), "conv_id").where("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "h1", "h2", "chars")
    return taken.unionByName(tails), plan.select("conv_id", "length")


def _node(sums: list[Column], depth: Column) -> Column:
    return F.struct(F.xxhash64(sums[0], sums[1], depth).alias("a"),
                    F.xxhash64(sums[2], sums[3], depth).alias("b"))


def prefixes(sequences: DataFrame) -> DataFrame:
    """(conv_id, depth, id, parent, chars) for every beginning of a turn or more."""
    halves = []
    for seed in (1, 2):
        value = F.xxhash64(F.lit(seed), "place", "h1", "h2")
        halves += [value.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(value, 32)]
    rows = sequences.select("conv_id", "place", "chars", F.floor(F.col("place") / PART).alias("part"),
                            *(h.alias(f"g{i}") for i, h in enumerate(halves, 1)))
    # in parts of a conversation, and over its parts
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv_id", "part").agg(
        *(F.sum(f"g{i}").alias(f"t{i}") for i in range(1, 5))).select(
        "conv_id", "part", *(F.coalesce(F.sum(f"t{i}").over(before), F.lit(0)).alias(f"t{i}")
                             for i in range(1, 5)))
    local = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(
        Window.unboundedPreceding, 0)
    summed = rows.select("*", *(F.sum(f"g{i}").over(local).alias(f"s{i}") for i in range(1, 5))).join(
        parts, ["conv_id", "part"]).select(
        "conv_id", "place", "chars", *(f"g{i}" for i in range(1, 5)),
        *((F.col(f"s{i}") + F.col(f"t{i}")).alias(f"s{i}") for i in range(1, 5)))
    here = [F.col(s) for s in _SUMS]
    above = [F.col(s) - F.col(f"g{i}") for i, s in enumerate(_SUMS, 1)]
    return summed.select("conv_id", F.col("place").alias("depth"),
                         _node(here, F.col("place")).alias("id"),
                         _node(above, F.col("place") - 1).alias("parent"), "chars")


def _digests(batches):
    """Rows (a, b, conv_id), sorted, to the SHA-256 of each node's ids; one id at a time is held."""
    node, digest, out = None, None, []
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sha", pa.string())])

    def batch():
        return pa.RecordBatch.from_pylist(
            [{"a": a, "b": b, "sha": sha} for a, b, sha in out], schema)

    for rows in batches:
        for a, b, conv in zip(*(rows.column(c).to_pylist() for c in ("a", "b", "conv_id"))):
            if (a, b) == node:
                digest.update(b",%d" % conv)
                continue
            if node:
                out.append((*node, digest.hexdigest()))
            node, digest = (a, b), hashlib.sha256(b"%d" % conv)
        yield batch()
        out.clear()
    if node:
        out.append((*node, digest.hexdigest()))
    yield batch()


def prefix_trie(sequences: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes of the trie: id, parent (null for the root), conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved (over the subtree, members but one times
    characters of the node's last turn) and ends_sha256 (of the ids of members that end here).

    `sequences` has the turns (conv_id, place from 1, h1, h2, chars) and `lengths` every
    conversation (conv_id, length), those without turns too. Without conversations there is no
    node. A node where very many conversations end is hashed by one task, which holds one id at a
    time: SHA-256 cannot be split.
    """
    rows = cut(prefixes(sequences))
    zero = [F.lit(0).cast("long")] * 4
    root = _node(zero, F.lit(0).cast("long"))
    ends = rows.join(lengths, "conv_id").where("depth = length").select("id", "conv_id").unionByName(
        lengths.where("length = 0").select(root.alias("id"), "conv_id"))
    shas = ends.select("id.a", "id.b", "conv_id").repartition("a", "b").sortWithinPartitions(
        "a", "b", "conv_id").mapInArrow(_digests, "a long, b long, sha string").select(
        F.struct("a", "b").alias("id"), "sha")
    counted = rows.groupBy("id").agg(
        F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"), F.count("*").alias("n_convs"),
        F.first("chars").cast("long").alias("chars"))
    top = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where(
        "n_convs > 0").select(
        root.alias("id"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("parent"), "conv_id",
        F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("chars"))
    nodes = cut(counted.unionByName(top))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
        F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, "id", "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))))
    totals = subtree_totals(nodes.select(
        "id", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), ["n_leaves", "saved"])
    above = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(totals, "id").join(shas, "id", "left").join(above, "parent", "left").select(
        "id", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved", F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"))


def trie_report(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations: a row per node."""
    turns = cut(ordered_turns(conversations))
    sequences, lengths = rebuilt(turns)
    return prefix_trie(sequences, lengths).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), "ends_sha256")
