"""Exact top-k by inner product with multi-resolution segment statistics.

For a segment of n components with means m and deviations s, Cauchy-Schwarz gives
<q, x> <= n (m_q m_x + s_q s_x); summed over segments that bounds the score (and so bounds the
distance |q|^2 + |x|^2 - 2 <q, x> from below). Bounds are taken with few long segments first and
more, shorter ones for what is left; exact scores are computed for the survivors only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, ROW_BLOCK = 2048, 8192
BLOCK_BYTES = 64 << 20
QUERIES_AT_ONCE, PAIRS_AT_ONCE = 64, 8192
LEVELS = (1, 4, 16)


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row sqrt(n) times means, then sqrt(n) times deviations: their products are the bound."""
    parts = np.array_split(x, min(segments, max(x.shape[1], 1)), axis=1)
    root = np.sqrt([p.shape[1] for p in parts])
    means = np.stack([p.mean(axis=1) if p.shape[1] else np.zeros(len(p)) for p in parts], axis=1)
    spread = np.stack([p.std(axis=1) if p.shape[1] else np.zeros(len(p)) for p in parts], axis=1)
    return np.concatenate([means * root, spread * root], axis=1)


def _exact(queries: np.ndarray, rows: np.ndarray, small: bool) -> np.ndarray:
    """Integer inner products of pairs (last axis); beyond the range of doubles with Python's
    integers, kept in 64 bits."""
    if small:
        return np.einsum("...d,...d->...", queries, rows).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    sums = (whole(queries) * whole(rows)).sum(axis=-1) if rows.shape[-1] else np.zeros(rows.shape[:-1])
    return np.clip(sums, -2**63, 2**63 - 1).astype(np.int64)


def _reached(bound, left, queries, rows, k: int, small: bool) -> np.ndarray:
    """For every query a score that k of the rows left reach, -inf if too few are found. Rows are
    parted into 2 k groups (one row each, if fewer), and the most promising of each is scored."""
    edges = np.linspace(0, bound.shape[1], min(2 * k, bound.shape[1]) + 1).astype(int)
    if len(edges) <= k:
        return np.full(len(bound), -np.inf)
    open_ = np.where(left, bound, -np.inf)
    best = np.stack([open_[:, a:b].argmax(axis=1) + a for a, b in zip(edges, edges[1:])], axis=1)
    scores = _exact(queries[:, None], rows[best], small).astype(float)
    scores[~np.take_along_axis(left, best, axis=1)] = -np.inf
    floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    return np.where(floor <= -2.0**63, -np.inf, floor)  # what is held there ties, whatever its bound


def _best(of: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores of each query, ties to the smaller id."""
    order = np.lexsort((ids, ~scores, of))  # ~ turns the order round within 64 bits
    place = np.arange(len(of)) - np.searchsorted(of[order], of[order])
    return order[place < k]


def block_top(query_ids, queries, row_ids, rows, k: int) -> pd.DataFrame:
    """The k best rows of a block for every query, ties to the smaller id.

    Bounds, floors and scores are taken for many queries at once, as matrix products. Queries with
    like means go together, and rows that none of them needs are left out of finer levels.
    """
    out = []
    peak = max(np.abs(queries).max(initial=0), np.abs(rows).max(initial=0))
    largest = peak * peak * max(rows.shape[1], 1)
    small = largest < 2**53
    kind = np.float32 if largest < 2**24 else np.float64  # sums of whole numbers are exact
    # the last product is more than the others may be off by, even where their terms cancel
    off = 1e3 * np.finfo(kind).eps
    statistics = [tuple(np.column_stack([segment_statistics(side, n), weight * np.linalg.norm(
        side, axis=1)]).astype(kind) for side, weight in ((queries, off), (rows, 1))) for n in LEVELS]
    near = np.lexsort(statistics[1][0][:, ::-1].T)
    queries, rows = queries.astype(kind), rows.astype(kind)
    for at in range(0, len(near), QUERIES_AT_ONCE):
        some = near[at:at + QUERIES_AT_ONCE]
        asked, floor, there = queries[some], np.full(len(some), -np.inf), np.arange(len(rows))
        left = row_ids != query_ids[some][:, None]
        for of_queries, of_rows in statistics:
            bound = of_queries[some] @ of_rows[there].T
            left &= ~(bound < floor[:, None])
            floor = np.maximum(floor, _reached(bound, left, asked, rows[there], k, small))
            left &= ~(bound < floor[:, None])
            needed = left.any(axis=0)
            if 4 * np.count_nonzero(needed) < 3 * len(needed):
                there, left = there[needed], left[:, needed]
        if small and 16 * np.count_nonzero(left) > left.size:
            found = asked @ rows[there].T
            of, which = np.nonzero(left & (found >= floor[:, None]))
            scores = found[of, which].astype(np.int64)
        else:
            of, which = np.nonzero(left)
            parts = [slice(i, i + PAIRS_AT_ONCE) for i in range(0, len(of), PAIRS_AT_ONCE)]
            scores = np.concatenate([np.empty(0, np.int64)] + [
                _exact(asked[of[x]], rows[there[which[x]]], small) for x in parts])
        ids = row_ids[there[which]]
        best = _best(of, ids, scores, k)
        out.append(pd.DataFrame({"query_id": query_ids[some][of[best]], "vec_id": ids[best],
                                 "score": scores[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def _block(key: Column, rows: Column) -> Column:
    return F.pmod(F.xxhash64(key), rows).cast("int")


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows (vec_id, v: array<double> of whole numbers)
    where is_query holds, against all rows with another vec_id; ties go to the smaller vec_id.

    Queries and rows are dealt into blocks by hash, and every query block meets every row block
    once. Vectors of different length do not meet. Rows that repeat a vec_id all count as rows,
    but ask once, with the least of their vectors. Null ids and vectors take no part.
    """
    rows = vectors.where("vec_id IS NOT NULL AND v IS NOT NULL").withColumn("d", F.size("v"))
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn(
        "d", F.size("v"))

    def sized(table: DataFrame, most: int, name: str) -> DataFrame:
        fit = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(
            F.lit(BLOCK_BYTES) / (8 * F.greatest("d", F.lit(1))))))
        return table.groupBy("d").agg(F.count("*").alias("n")).select(
            "d", F.ceil(F.col("n") / fit).alias(name))

    grid = sized(rows, ROW_BLOCK, "p").join(sized(queries, QUERY_BLOCK, "q"), "d")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    asked = queries.join(grid, "d").select(
        "d", _block(F.col("vec_id"), F.col("q")).alias("i"), every("p").alias("j"),
        F.lit(True).alias("asks"), "vec_id", "v")
    there = rows.join(grid, "d").select(
        "d", every("q").alias("i"), _block(F.col("vec_id"), F.col("p")).alias("j"),
        F.lit(False).alias("asks"), "vec_id", "v")

    def run(block: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for asks in (True, False):
            part = block[block["asks"] == asks]
            sides += [part["vec_id"].to_numpy(np.int64),
                      np.array(part["v"].tolist(), float).reshape(len(part), int(block["d"].iloc[0]))]
        return block_top(*sides, k)

    # by number, as adaptive execution would put small blocks, which take long, into one task
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partial = asked.unionByName(there).repartition(tasks, "d", "i", "j").groupBy("d", "i", "j").applyInPandas(
        run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; vectors that are null or hold a null or
    non-finite component are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) < F.lit(float("inf"))))
    return embeddings.where(F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("double"))
        .alias("v"))


def embedding_neighbours(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k best rows for each vector whose id is divisible by `every`."""
    return exact_top_k(quantised(embeddings), F.col("vec_id") % every == 0, k)
