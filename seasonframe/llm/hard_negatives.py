"""Hard negatives with exact scores from a residue-number-system matrix product.

Components are whole numbers. Their residues modulo several small primes, centred on zero, are
multiplied as float32 matrices; sums stay under 2^24 and so are exact. Chinese remaindering (in
mixed radix) puts the signed score together from its residues. Rows and anchors meet block by
block; a block returns the few best of each window, and the windows' best are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonframe.storage import cut

ANCHOR_BLOCK, ROW_BLOCK = 4096, 8192
BLOCK_BYTES = 32 << 20
ANCHORS_AT_ONCE = 128
WIDTH = 256  # components multiplied at a time
LARGEST = 509  # (LARGEST // 2) ** 2 * WIDTH < 2 ** 24


def _primes() -> list[int]:
    """Primes up to LARGEST, from the largest down."""
    return [p for p in range(LARGEST, 2, -2) if all(p % q for q in range(3, int(p**0.5) + 1, 2))]


def moduli(bound: int) -> list[int]:
    """The fewest primes whose product tells scores from -bound to bound apart."""
    out, product = [], 1
    for p in _primes():
        out.append(p)
        product *= p
        if product > 2 * bound:
            return out
    raise OverflowError("scores need more residues than there are primes")


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Centred residues; fmod of doubles is exact."""
    r = np.fmod(x, p)
    r[r > p // 2] -= p
    r[r < -(p // 2)] += p
    return r.astype(np.float32)


def _product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, from 0; both hold residues."""
    total = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, a.shape[1], WIDTH):
        total += (a[:, at:at + WIDTH] @ b[:, at:at + WIDTH].T).astype(np.int64)
    return total % p


def score_bound(anchors: np.ndarray, rows: np.ndarray) -> int:
    """No score is further from zero: the product of the largest components times their number."""
    top = lambda x: int(np.abs(x).max(initial=0))
    return top(anchors) * top(rows) * max(rows.shape[1], 1)


class Scores:
    """Exact inner products of blocks of rows, prepared once for all anchors."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray) -> None:
        self.primes = moduli(score_bound(anchors, rows))
        self.anchors = [residues(anchors, p) for p in self.primes]
        self.rows = [residues(rows, p) for p in self.primes]

    def of(self, some: slice) -> np.ndarray:
        """Scores of some anchors against all rows: 64-bit, those beyond held at its ends."""
        digits, known = [], []
        for p, a, b in zip(self.primes, self.anchors, self.rows):
            digit = _product(a[some], b, p)
            weight = 1
            for q, d in zip(known, digits):  # what the digits so far account for
                digit -= d * (weight % p)
                weight *= q
            digit = digit % p * pow(weight, -1, p) % p
            digits.append(digit)
            known.append(p)
        product = int(np.prod(np.array(self.primes, object)))
        kind = np.int64 if product < 2**62 else object
        total, weight = 0, 1
        for p, d in zip(self.primes, digits):
            total = total + d.astype(kind) * weight
            weight *= p
        total = np.where(total > product // 2, total - product, total)
        return np.clip(total, -2**63, 2**63 - 1).astype(np.int64)


def _best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int):
    """(row of the matrix, column) of the k highest allowed scores of every row, ties to the
    smaller id; ids ascend."""
    for i, mask in enumerate(allowed):
        at = np.flatnonzero(mask)
        if len(at) > k:
            s = scores[i, at]
            least = s[np.argpartition(s, len(s) - k)[len(s) - k]]
            at = at[s >= least]
        at = at[np.argsort(-scores[i, at].astype(object) if scores[i, at].min(initial=0) == -2**63
                           else -scores[i, at], kind="stable")][:k]
        yield from ((i, j) for j in at.tolist())


def _side(block: pd.DataFrame, asks: bool, d: int) -> pd.DataFrame:
    return block[block["asks"] == asks].sort_values("vec_id", kind="stable")


def _matrix(rows: pd.DataFrame, d: int) -> np.ndarray:
    return np.array(rows["v"].tolist(), float).reshape(len(rows), d)


def block_positives(block: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of an anchor's label in a block."""
    d = int(block["d"].iloc[0])
    anchors, rows = _side(block, True, d), _side(block, False, d)
    out = []
    if len(anchors) and len(rows):
        scores, ids, labels = Scores(_matrix(anchors, d), _matrix(rows, d)), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        for at in range(0, len(anchors), ANCHORS_AT_ONCE):
            part = anchors.iloc[at:at + ANCHORS_AT_ONCE]
            own, found = part["vec_id"].to_numpy(), scores.of(slice(at, at + ANCHORS_AT_ONCE))
            allowed = (labels == part["label"].to_numpy()[:, None]) & (ids != own[:, None])
            out += ((own[i], ids[j], found[i, j]) for i, j in _best(found, allowed, ids, k))
    return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"])


def block_negatives(block: pd.DataFrame, k: int, low: int, high: int) -> pd.DataFrame:
    """For each anchor's positives, the k best rows of another label within the window."""
    d = int(block["d"].iloc[0])
    anchors, rows = _side(block, True, d), _side(block, False, d)
    out = []
    if len(anchors) and len(rows):
        scores, ids, labels = Scores(_matrix(anchors, d), _matrix(rows, d)), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        for at in range(0, len(anchors), ANCHORS_AT_ONCE):
            part = anchors.iloc[at:at + ANCHORS_AT_ONCE]
            found = scores.of(slice(at, at + ANCHORS_AT_ONCE))
            other = labels != part["label"].to_numpy()[:, None]
            for i, (own, positives) in enumerate(zip(part["vec_id"], part["positives"])):
                for p in positives:
                    # whole-number window: low/100 p <= s <= high/100 p
                    floor, ceiling = -(-low * p["score"] // 100), high * p["score"] // 100
                    if floor > ceiling:
                        continue
                    mask = other[i] & (found[i] >= floor) & (found[i] <= ceiling)
                    out += ((own, p["id"], p["score"], ids[j], found[i, j])
                            for _, j in _best(found[i:i + 1], mask[None], ids, k))
    return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score", "negative_id",
                                      "negative_score"])


def _block_of(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks).cast("int")


def _meet(anchors: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """Every block of anchors with every block of rows of their dimension, one group each."""
    def sized(table: DataFrame, most: int, name: str) -> DataFrame:
        fit = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(
            F.lit(BLOCK_BYTES) / (8 * F.greatest("d", F.lit(1))))))
        return table.groupBy("d").agg(F.count("*").alias("n")).select(
            "d", F.ceil(F.col("n") / fit).alias(name))

    grid = sized(anchors, ANCHOR_BLOCK, "q").join(sized(rows, ROW_BLOCK, "p"), "d")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    asked = anchors.join(grid, "d").select(
        "d", _block_of(F.col("vec_id"), F.col("q")).alias("i"), every("p").alias("j"),
        F.lit(True).alias("asks"), "vec_id", "v", "label", "positives")
    there = rows.join(grid, "d").select(
        "d", every("q").alias("i"), _block_of(F.col("vec_id"), F.col("p")).alias("j"),
        F.lit(False).alias("asks"), "vec_id", "v", "label",
        F.lit(None).cast("array<struct<id:bigint,score:bigint>>").alias("positives"))
    # by number, as adaptive execution would put small blocks, which take long, into one task
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return asked.unionByName(there).repartition(tasks, "d", "i", "j").groupBy(
        "d", "i", "j").applyInPandas(run, schema)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5,
                   low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `vectors` has vec_id, label and v (array<double> of whole numbers). An anchor's positives are
    its best rows of the same label with another vec_id; a positive's negatives are the best rows
    of another label whose score is from `low` to `high` percent of the positive's. Ties go to the
    smaller vec_id. Null ids, labels and vectors take no part, and vectors of different length do
    not meet. Rows that repeat a vec_id all count as rows, but ask once, with the least label and
    vector. Scores beyond 64 bits are held at its ends. A negative positive score has an empty
    window, a score of 0 the window 0 to 0.
    """
    rows = cut(vectors.where("vec_id IS NOT NULL AND v IS NOT NULL AND label IS NOT NULL").select(
        "vec_id", "label", "v", F.size("v").alias("d")))
    asked = rows.where(is_anchor).groupBy("vec_id").agg(
        F.min(F.struct("label", "v")).alias("a")).select(
        "vec_id", "a.label", "a.v", F.size("a.v").alias("d"))
    empty = F.lit(None).cast("array<struct<id:bigint,score:bigint>>").alias("positives")
    near = _meet(asked.withColumn("positives", empty), rows,
                 lambda block: block_positives(block, positives),
                 "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    chosen = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct(
        F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    far = _meet(cut(asked.join(chosen, "vec_id").select("vec_id", "label", "v", "d", "positives")),
                rows, lambda block: block_negatives(block, negatives, low, high),
                "anchor_id long, positive_id long, positive_score long, negative_id long, "
                "negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(
        F.desc("negative_score"), "negative_id")
    return far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def scaled(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of every component; rows with a null label, a null
    vector, or a null or non-finite component are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) < F.lit(float("inf"))))
    return embeddings.where(F.col("embedding").isNotNull() & F.col("label").isNotNull() & finite
                            ).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("double"))
        .alias("v"))


def negatives_report(embeddings: DataFrame) -> DataFrame:
    """Hard negatives for the rows whose vec_id is divisible by 100; where it is divisible by 7,
    the label first becomes (label + 1) % 10."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(scaled(embeddings).withColumn("label", shifted), F.col("vec_id") % 100 == 0)
