"""Packed token id matrices: best-fit decreasing with a segment tree over free capacities.

Each task packs the pieces it reads, a bounded window at a time, so no text is shuffled and a
window's last, partly filled rows are all that is lost against packing the corpus at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonframe.llm.tokens import LENGTH, TOKENIZER, tokens_of

WINDOW_TOKENS = 4_000_000
ROWS_OUT = 256


class CapacityTree:
    """Bins by free capacity; the tree counts bins below each node, leaves are the capacities."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, free: int, change: int) -> None:
        node = free + self.width
        while node:
            self.counts[node] += change
            node >>= 1

    def push(self, free: int, number: int) -> None:
        self.bins[free].append(number)
        self._add(free, 1)

    def pop_best(self, need: int) -> tuple[int, int] | None:
        """(free capacity, bin) with the least free capacity that is at least `need`."""
        node = need + self.width
        while not self.counts[node]:
            while node & 1:  # a right child: nothing larger below its parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.width:
            node = 2 * node if self.counts[2 * node] else 2 * node + 1
        free = node - self.width
        self._add(free, -1)
        return free, self.bins[free].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indexes of lengths per bin, in the order they were placed."""
    tree, bins = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        free, number = tree.pop_best(lengths[i]) or (capacity, len(bins))
        if number == len(bins):
            bins.append([])
        bins[number].append(i)
        tree.push(free - lengths[i], number)
    return bins


def token_matrix(documents: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER,
                 window: int = WINDOW_TOKENS) -> DataFrame:
    """One row per packed sequence: sequence_id, doc_ids, pieces (parallel arrays, one entry per
    segment), n_tokens, cu_seqlens (segments' ends, from 0), ids and position_ids.

    ids and position_ids are `length` little-endian 16-bit numbers, zero behind n_tokens; positions
    start anew with every segment. Documents longer than `length` are split into consecutive
    pieces, nothing is cut off: the pieces of a doc_id, in order, are its ids. Null text is empty
    (the end token alone); a null doc_id stays null; rows that repeat a doc_id are packed each.
    """
    count_up = np.arange(length, dtype="<u2").tobytes()
    names = ["sequence_id", "doc_ids", "pieces", "n_tokens", "cu_seqlens", "ids", "position_ids"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(),
             pa.list_(pa.int32()), pa.binary(), pa.binary()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def packed(held, first):
        rows = []
        for k, chosen in enumerate(best_fit_decreasing([len(h[2]) // 2 for h in held], length)):
            segments = [held[i] for i in chosen]
            sizes = [len(s[2]) // 2 for s in segments]
            positions = b"".join(count_up[:2 * n] for n in sizes)
            rows.append((first + k, [s[0] for s in segments], [s[1] for s in segments], sum(sizes),
                         np.cumsum([0, *sizes]), b"".join(s[2] for s in segments).ljust(
                             2 * length, b"\0"), positions.ljust(2 * length, b"\0")))
        return rows

    def run(batches):
        number, held, tokens = TaskContext.get().partitionId() << 40, [], 0

        def flush():
            nonlocal number, held, tokens
            rows = packed(held, number)
            number, held, tokens = number + len(rows), [], 0
            for at in range(0, len(rows), ROWS_OUT):
                yield table(rows[at:at + ROWS_OUT])

        for batch in batches:
            texts = (text.as_py() for text in batch.column("text"))
            for doc_id, whole in zip(batch.column("doc_id"), tokens_of(texts, tokenizer)):
                whole = np.frombuffer(whole, "<u4")
                if whole.max() >= 1 << 16:
                    raise ValueError("ids of this vocabulary do not fit into 16 bits")
                short = whole.astype("<u2").tobytes()
                for k, at in enumerate(range(0, len(short), 2 * length)):
                    held.append((doc_id.as_py(), k, short[at:at + 2 * length]))
                    tokens += len(held[-1][2]) // 2
                    if tokens >= window:
                        yield from flush()
        yield from flush()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "sequence_id long, doc_ids array<bigint>, pieces array<int>, n_tokens int, "
        "cu_seqlens array<int>, ids binary, position_ids binary")


def write_token_matrix(documents: DataFrame, path: str, **options) -> None:
    """Write the matrices as Parquet; rows have a fixed width, so readers can map them as they are."""
    token_matrix(documents, **options).write.parquet(path)
