"""Packing of pieces into as few sequences as possible: linear grouping, then best fit.

Lengths are integers up to the capacity, so a histogram of at most `capacity` numbers describes the
whole corpus and the packing is planned on it, however many rows there are:

1. Large lengths are put into groups of equal cardinality and rounded up to the group's largest.
2. Over these few sizes all configurations (what a sequence holds together) are listed, their linear
   program is optimised by the simplex method and rounded down; the rest is filled greedily.
3. Real lengths take the places of the rounded ones, which leaves exact gaps.
4. Small lengths go into the gaps best-fit, longest first, and then into new sequences.

Runs of sequences that hold the same lengths are kept as one entry, so the plan stays small. Spark
numbers the pieces within each length and looks up their places.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasonframe.llm.tokens import LENGTH, piece_table
from seasonframe.storage import cut

GROUPS = 32
LARGE = (2, 3, 4)  # a length above capacity / LARGE is large; the best of these plans is taken
CELL_ROWS = 50_000


def _groups(lengths: list[int], counts: Mapping[int, int]) -> list[list[list[int]]]:
    """Runs of [length, count], longest first, in up to GROUPS groups of equal cardinality."""
    total = sum(counts[x] for x in lengths)
    share = -(-total // GROUPS) if total else 1
    groups, room = [], 0
    for length in sorted(lengths, reverse=True):
        left = counts[length]
        while left:
            if not room:
                groups.append([])
                room = share
            taken = min(left, room)
            groups[-1].append([length, taken])
            left, room = left - taken, room - taken
    return groups


def _configurations(sizes: list[int], capacity: int) -> np.ndarray:
    """All multisets of sizes that fit together, as rows of counts per size."""
    out = []
    for n in range(1, capacity // min(sizes) + 1):
        for chosen in itertools.combinations_with_replacement(range(len(sizes)), n):
            if sum(sizes[i] for i in chosen) <= capacity:
                out.append(np.bincount(chosen, minlength=len(sizes)))
    return np.array(out)


def _solve(configurations: np.ndarray, demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest (fractional) sequences that meet the demand: revised simplex over all columns.

    After 50 steps a size the sequences so far are taken: they meet the demand at every step."""
    singles = [int(np.flatnonzero((configurations.sum(axis=1) == 1) & (configurations[:, i] == 1))[0])
               for i in range(len(demand))]
    basis, matrix = np.array(singles), configurations.T.astype(float)
    x = demand.astype(float)
    for _ in range(50 * len(demand)):
        inside = matrix[:, basis]
        prices = np.linalg.solve(inside.T, np.ones(len(basis)))
        gains = prices @ matrix
        entering = int(np.argmax(gains))
        if gains[entering] <= 1 + 1e-9:
            break
        direction = np.linalg.solve(inside, matrix[:, entering])
        ratios = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        leaving = int(np.argmin(ratios))
        x = np.maximum(x - ratios[leaving] * direction, 0)
        basis[leaving], x[leaving] = entering, ratios[leaving]
    return basis, x


class Plan:
    """Runs of sequences and, per length, where its pieces go in order of their rank."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.ranks: dict[int, int] = {}
        self.places: list[tuple[int, int, int, int]] = []  # length, first rank, sequence, offset
        self.gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        rank = self.ranks.get(length, 0)
        self.places.append((length, rank, sequence, offset))
        self.ranks[length] = rank + count

    def leave(self, sequence: int, count: int, filled: int) -> None:
        self.gaps[self.capacity - filled].append((sequence, count))


def _place_large(plan: Plan, groups: list[list[list[int]]]) -> None:
    sizes = [group[0][0] for group in groups]
    left = np.array([sum(n for _, n in group) for group in groups])
    configurations = _configurations(sizes, plan.capacity)
    basis, x = _solve(configurations, left)
    used = [(configurations[b], int(v + 1e-6)) for b, v in zip(basis, x)]
    fill = configurations @ np.array(sizes)
    order = configurations[np.argsort(-fill, kind="stable")]
    todo = iter(used)
    while left.any():
        config, times = next(todo, (None, 0))
        if config is None:  # the rest, fullest configuration first
            config = next(c for c in order if (c <= left).all())
            times = int((left[config > 0] // config[config > 0]).min())
        if not times:
            continue
        left = left - config * times
        parts = list(itertools.chain.from_iterable([g] * n for g, n in enumerate(config)))
        heads = [[] for _ in parts]
        for k, g in enumerate(parts):  # real lengths for this part, as runs
            need = times
            while need:
                run = groups[g][0]
                taken = min(need, run[1])
                heads[k].append([run[0], taken])
                run[1] -= taken
                need -= taken
                if not run[1]:
                    groups[g].pop(0)
        while heads[0]:
            count = min(runs[0][1] for runs in heads)
            first, filled = plan.open(count), 0
            for runs in heads:
                plan.put(runs[0][0], count, first, filled)
                filled += runs[0][0]
                runs[0][1] -= count
                if not runs[0][1]:
                    runs.pop(0)
            plan.leave(first, count, filled)


def _place_small(plan: Plan, length: int, count: int) -> None:
    while count:
        gap = next((g for g in range(length, plan.capacity + 1) if plan.gaps[g]), None)
        if gap is None:
            count_new = -(-count // (plan.capacity // length))
            plan.leave(plan.open(count_new), count_new, 0)
            continue
        sequence, size = plan.gaps[gap].pop()
        taken = min(size, count)
        plan.put(length, taken, sequence, plan.capacity - gap)
        plan.leave(sequence, taken, plan.capacity - gap + length)
        if taken < size:
            plan.gaps[gap].append((sequence + taken, size - taken))
        count -= taken


def plan_packing(counts: Mapping[int, int], capacity: int) -> Plan:
    """Places for so many pieces of each length (1 to capacity)."""
    if any(not 1 <= x <= capacity for x in counts):
        raise ValueError(f"lengths must be between 1 and {capacity}")
    least = -(-sum(x * n for x, n in counts.items()) // capacity)
    best = None
    for bound in LARGE:
        plan = Plan(capacity)
        large = [x for x in counts if x * bound > capacity]
        if large:
            _place_large(plan, _groups(large, counts))
        for length in sorted(set(counts) - set(large), reverse=True):
            _place_small(plan, length, counts[length])
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == least:
            break
    return best


def pack(pieces: DataFrame, ids: list[str], capacity: int = LENGTH) -> DataFrame:
    """Rows with sequence_id and offset: no sequence is longer than capacity, offsets leave no gap.

    `pieces` needs a column length, and `ids` to order equal lengths by; it is read twice, so it
    should be a written table. Only the histogram comes to the driver. A length that many rows
    share is numbered in cells of about CELL_ROWS rows, chosen by hash, on top of the cells'
    counts; repeated rows get places of their own.
    """
    spark, names = pieces.sparkSession, pieces.columns
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = plan_packing(counts, capacity)
    places = np.array(sorted(plan.places), np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast(places)

    sizes = F.broadcast(spark.createDataFrame(  # at most `capacity` rows
        [(n, -(-c // CELL_ROWS)) for n, c in counts.items()], "length long, cells long"))
    celled = pieces.join(sizes, "length").withColumn(
        "cell", F.pmod(F.xxhash64(*ids), F.col("cells"))).drop("cells")
    before = celled.groupBy("length", "cell").count().select(
        "length", "cell", (F.sum("count").over(Window.partitionBy("length").orderBy("cell"))
                           - F.col("count")).alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "cell").orderBy(*ids))
    ranked = celled.withColumn("number", number).join(before, ["length", "cell"]).withColumn(
        "rank", F.col("before") + F.col("number") - 1).select(*names, "rank")

    def run(batches):
        table = shared.value
        starts = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            at = np.searchsorted(starts, (lengths << 44) + ranks, "right") - 1
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(table[at, 2] + ranks - table[at, 1]), pa.array(table[at, 3])],
                [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def packed_documents(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every document, tokenized
    and cut into pieces of at most `length` tokens, with its places. Null text counts as empty
    (the end token alone); rows that repeat a doc_id are packed each; a null doc_id stays null."""
    pieces = cut(piece_table(documents, length))
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], length)
