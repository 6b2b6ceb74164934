"""Exact distance-weighted k-nearest-neighbour regression over a two-level pivot index.

Training rows are split into cells around about sqrt(n) pivots, and pivots into groups around
about sqrt(pivots) of them. A query first asks the nearest cells that hold k rows; the k-th
distance found there is its reach, and the triangle inequality then names the other groups and
cells that can hold anything nearer. Cells are searched in chunks of bounded size, copied once per
block of queries that ask for them, and not at all where nobody does. A ranked window merges the
blocks, so no task ever holds a cell or the training set. Several searches, such as the folds of a
cross-validation, are one run: their cells have numbers of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .moments import quoted

CHUNK_ROWS = 1024
QUERY_ROWS = 16384
PIVOTS = 65536  # at most; bounds what the driver and each task keep of the index

_FOUND = "no int, qid string, dist double, tie long, y double"


def _distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact differences column by column: equal rows are at distance exactly 0."""
    squared = np.zeros((len(rows), len(others)))
    for j in range(rows.shape[1]):
        squared += (rows[:, j, None] - others[None, :, j]) ** 2
    return np.sqrt(squared)


def _vector(features, center, scale) -> Column:
    return F.array(*[
        (F.col(c).cast("double") - float(m)) / float(s)
        for c, m, s in zip(quoted(features), center, scale)])


class PivotIndex:
    """Pivots in groups; once the cells are filled, their sizes and radii too."""

    def __init__(self, pivots: np.ndarray):
        tops = pivots[:ceil(sqrt(len(pivots)))]
        group = np.concatenate([
            _distances(pivots[i:i + CHUNK_ROWS], tops).argmin(axis=1)
            for i in range(0, len(pivots), CHUNK_ROWS)])
        used = np.unique(group)  # equal pivots all belong to the first of them
        self.pivots, self.tops = pivots, tops[used]
        self.members = [np.flatnonzero(group == g) for g in used]

    def _by_top(self, v: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        nearest = _distances(v, self.tops).argmin(axis=1)
        for top in np.unique(nearest):
            yield int(top), np.flatnonzero(nearest == top)

    def cells(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of the nearest group, and its distance."""
        cell, dist = np.zeros(len(v), dtype="int64"), np.zeros(len(v))
        for top, rows in self._by_top(v):
            d = _distances(v[rows], self.pivots[self.members[top]])
            best = d.argmin(axis=1)
            cell[rows], dist[rows] = self.members[top][best], d[np.arange(len(rows)), best]
        return cell, dist

    def filled(self, sizes: np.ndarray, radii: np.ndarray, k: int) -> PivotIndex:
        """With the cells' sizes and radii; `near` lists the pivots that a group's queries try
        first: its own and, while those hold fewer than k rows, the next groups'."""
        self.sizes, self.radii, self.need = sizes, radii, min(k, int(sizes.sum()))
        between = _distances(self.tops, self.tops)
        self.near, self.spread = [], np.zeros(len(self.tops))
        for top, members in enumerate(self.members):
            away = _distances(self.tops[top:top + 1], self.pivots[members])[0]
            self.spread[top] = (away + radii[members]).max()
            near, held = [], 0
            for other in between[top].argsort(kind="stable"):
                near.append(self.members[other])
                held += sizes[self.members[other]].sum()
                if held >= self.need:
                    break
            self.near.append(np.concatenate(near))
        return self

    def homes(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) pairs: each row's nearest cells that together hold enough rows."""
        pairs = []
        for top, rows in self._by_top(v):
            near = self.near[top]
            order = _distances(v[rows], self.pivots[near]).argsort(axis=1, kind="stable")
            held = self.sizes[near][order].cumsum(axis=1)
            before = held - self.sizes[near][order]
            at, place = np.nonzero((before < self.need) & (held > before))
            pairs.append((rows[at], near[order[at, place]]))
        return _joined(pairs)

    def beyond(self, v: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) pairs of the other cells that may hold a row within reach."""
        limit = reach * (1 + 1e-9) + 1e-12
        pairs = []
        may = _distances(v, self.tops) - self.spread <= limit[:, None]
        for top, members in enumerate(self.members):
            rows = np.flatnonzero(may[:, top])
            if len(rows):
                low = _distances(v[rows], self.pivots[members]) - self.radii[members]
                at, place = np.nonzero((low <= limit[rows, None]) & (self.sizes[members] > 0))
                pairs.append((rows[at], members[place]))
        rows, cells = _joined(pairs)
        home_rows, home_cells = self.homes(v)
        width = len(self.pivots)
        new = np.setdiff1d(rows * width + cells, home_rows * width + home_cells)
        return new // width, new % width


def _joined(pairs) -> tuple[np.ndarray, np.ndarray]:
    nothing = (np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64"))
    return tuple(np.concatenate(part) for part in zip(nothing, *pairs))


def _lists(rows: np.ndarray, cells: np.ndarray, n: int) -> pd.Series:
    ends = np.bincount(rows, minlength=n).cumsum()
    ordered = cells[rows.argsort(kind="stable")].astype("int32")
    return pd.Series(np.split(ordered, ends[:-1]), dtype=object)


def _per_search(indexes: Sequence[PivotIndex | None], no: pd.Series) -> Iterator:
    """(index, first cell, positions) of every search that a batch has rows of."""
    first = np.cumsum([0, *(len(i.pivots) if i else 0 for i in indexes)])
    numbers = no.to_numpy()
    for n in np.unique(numbers):
        if indexes[n]:
            yield indexes[n], int(first[n]), np.flatnonzero(numbers == n)


def _rows_of(vectors: pd.Series, at: np.ndarray) -> np.ndarray:
    return np.stack(vectors.to_numpy()[at])


def _cell_of(indexes):
    @F.pandas_udf("cell int, dist double")
    def cell_of(no: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        cell, dist = np.zeros(len(no), dtype="int64"), np.zeros(len(no))
        for index, first, at in _per_search(indexes, no):
            own, dist[at] = index.cells(_rows_of(vectors, at))
            cell[at] = own + first
        return pd.DataFrame({"cell": cell, "dist": dist})
    return cell_of


def _homes(indexes):
    @F.pandas_udf("array<int>")
    def homes(no: pd.Series, vectors: pd.Series) -> pd.Series:
        pairs = []
        for index, first, at in _per_search(indexes, no):
            rows, cells = index.homes(_rows_of(vectors, at))
            pairs.append((at[rows], cells + first))
        return _lists(*_joined(pairs), len(no))
    return homes


def _beyond(indexes):
    @F.pandas_udf("array<int>")
    def beyond(no: pd.Series, vectors: pd.Series, reach: pd.Series) -> pd.Series:
        pairs = []
        for index, first, at in _per_search(indexes, no):
            rows, cells = index.beyond(_rows_of(vectors, at), reach.to_numpy()[at])
            pairs.append((at[rows], cells + first))
        return _lists(*_joined(pairs), len(no))
    return beyond


def _best_in_chunk(k: int):
    def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({
                "no": pd.Series(dtype="int32"), "qid": pd.Series(dtype=object),
                "dist": pd.Series(dtype=float), "tie": pd.Series(dtype="int64"), "y": pd.Series(dtype=float)})
        d = _distances(np.stack(queries["v"].to_numpy()), np.stack(rows["v"].to_numpy()))
        tie = rows["tie"].to_numpy()
        take = min(k, d.shape[1])
        picked = np.lexsort((np.broadcast_to(tie, d.shape), d), axis=1)[:, :take]
        return pd.DataFrame({
            "no": np.repeat(queries["no"].to_numpy(), take),
            "qid": np.repeat(queries["qid"].to_numpy(), take),
            "dist": np.take_along_axis(d, picked, axis=1).ravel(),
            "tie": tie[picked].ravel(),
            "y": rows["y"].to_numpy()[picked].ravel(),
        })
    return best


def _ranked(found: DataFrame, k: int) -> DataFrame:
    nearest_first = Window.partitionBy("no", "qid").orderBy("dist", "tie")
    return found.withColumn("RANK", F.row_number().over(nearest_first)).filter(F.col("RANK") <= k)


def _searched(visits: DataFrame, cells: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The k best of every (query, chunk): queries visit all chunks of the cells they name, and a
    cell's chunks are copied once per QUERY_ROWS of its visitors."""
    blocks = F.broadcast(visits.groupBy("cell").agg(  # a row per cell: PIVOTS a search at most
        F.ceil(F.count(F.lit(1)) / QUERY_ROWS).alias("groups")).join(F.broadcast(chunks), "cell"))
    left = visits.join(blocks, "cell").select(
        "cell", "no", "qid", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
        .alias("chunk"), F.pmod(F.xxhash64("qid"), "groups").alias("grp"))
    right = cells.join(blocks, "cell").select(
        "cell", "tie", "v", "y", F.pmod(F.xxhash64("tie"), "chunks").alias("chunk"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("grp"))
    key = ["cell", "chunk", "grp"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_best_in_chunk(k), _FOUND)


@dataclass(frozen=True)
class Search:
    """Which rows to search, which to search for, by which features, shifted and scaled how."""

    features: Sequence[str]
    center: Sequence[float]
    scale: Sequence[float]
    train: Column | None = None  # conditions; None: all rows
    asked: Column | None = None


def _prepared(df: DataFrame, searches: Sequence[Search], side: str, *more: Column) -> DataFrame:
    """One row per search that a row takes part in: its number and the vector."""
    parts = []
    for no, s in enumerate(searches):
        takes_part = F.lit(True) if getattr(s, side) is None else getattr(s, side)
        for c in quoted(s.features):
            takes_part &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        parts.append(F.when(takes_part, F.struct(
            F.lit(no).alias("no"), _vector(s.features, s.center, s.scale).alias("v"))))
    rows = df.select(F.explode(F.array_compact(F.array(*parts))).alias("_s"), *more)
    return rows.select("_s.*", *[c for c in rows.columns if c != "_s"])


def _indexes(points: DataFrame, n_searches: int) -> list[PivotIndex | None]:
    """An index per search around about sqrt(rows) pivots, chosen by a hash of the vector."""
    counts = {r["no"]: r["n"] for r in points.groupBy("no").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [None] * n_searches
    wanted = [min(PIVOTS, ceil(sqrt(counts.get(no, 0)))) for no in range(n_searches)]
    share = F.element_at(F.array(*[  # a few more, so that hardly any search gets none
        F.lit((w + 8) / max(counts.get(no, 0), 1)) for no, w in enumerate(wanted)]),
        F.col("no") + 1)
    draw = F.pmod(F.xxhash64(F.lit(7), "v"), F.lit(1 << 30)) / float(1 << 30)
    pivots = {}
    for r in points.filter(draw < share).select("no", "v").distinct().collect():
        pivots.setdefault(r["no"], []).append(r["v"])
    for no in counts.keys() - pivots.keys():  # none drawn, as where all rows are alike: one cell
        pivots[no] = [points.filter(F.col("no") == no).select("v").first()["v"]]
    return [PivotIndex(np.array(sorted(pivots[no])[:PIVOTS])) if no in pivots else None
            for no in range(n_searches)]


def search_all(queries: DataFrame, train: DataFrame, searches: Sequence[Search], label: str,
               ids: Sequence[str], k: int) -> DataFrame:
    """(no, qid, dist, tie, y, RANK): the k nearest training rows of every query row, for all
    searches at once; `no` is the search's place in the list.

    `qid` packs the id columns as JSON. Rows with a missing feature have no neighbours, and
    nobody has any without training rows. Equal distances go by a hash of the ids.
    """
    points = _prepared(train, searches, "train", F.xxhash64(*ids).alias("tie"),
                       F.col(label).cast("double").alias("y"))
    asked = _prepared(queries, searches, "asked", F.to_json(F.struct(*ids)).alias("qid"))
    spark = queries.sparkSession
    indexes = _indexes(points, len(searches))
    n_cells = sum(len(i.pivots) for i in indexes if i)
    if not n_cells:
        return spark.createDataFrame([], f"{_FOUND}, RANK int")

    # of equal rows only the first k can be among the nearest, however many there are
    same = Window.partitionBy("no", "v").orderBy("tie")
    few = points.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k)
    cells = cut(few.withColumn("_c", _cell_of(indexes)("no", "v")).select(
        "v", "tie", "y", "_c.cell", "_c.dist"))
    sizes, radii = np.zeros(n_cells, dtype="int64"), np.zeros(n_cells)
    for r in cells.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius")).collect():
        sizes[r["cell"]], radii[r["cell"]] = r["n"], r["radius"]
    first = 0
    for index in filter(None, indexes):
        own = slice(first, first := first + len(index.pivots))
        index.filled(sizes[own], radii[own], k)
    chunks = spark.createDataFrame(
        [(int(c), -(-int(sizes[c]) // CHUNK_ROWS)) for c in np.flatnonzero(sizes)],
        "cell int, chunks long")

    visits = asked.withColumn("cell", F.explode(_homes(indexes)("no", "v")))
    home = cut(_ranked(_searched(visits, cells, chunks, k), k))
    reach = home.groupBy("no", "qid").agg(F.max("dist").alias("reach"))
    visits = asked.join(reach, ["no", "qid"]).withColumn(
        "cell", F.explode(_beyond(indexes)("no", "v", "reach")))
    return _ranked(home.drop("RANK").unionByName(_searched(visits, cells, chunks, k)), k)


def nearest_neighbours(queries: DataFrame, train: DataFrame, features: Sequence[str], label: str,
                       ids: Sequence[str], k: int, center=None, scale=None) -> DataFrame:
    """(qid, dist, tie, y, RANK) of one search over all rows; see `search_all`."""
    one = Search(features, np.zeros(len(features)) if center is None else center,
                 np.ones(len(features)) if scale is None else scale)
    return search_all(queries, train, [one], label, ids, k).drop("no")


def weighted(k: int) -> Column:
    """Of a query's neighbours: the k nearest labels weighted by inverse distance; rows at
    distance 0 count alone when there are any."""
    near, hit = F.col("RANK") <= k, F.col("dist") == 0
    weight = F.when(near & ~hit, 1 / F.nullif(F.col("dist"), F.lit(0.0)))
    exact = F.avg(F.when(near & hit, F.col("y")))
    return F.coalesce(exact, F.sum(weight * F.col("y")) / F.sum(weight)).alias(f"K{k}")


def knn_predictions(queries: DataFrame, train: DataFrame, features: Sequence[str], label: str,
                    ids: Sequence[str], ks: Sequence[int], center=None, scale=None) -> DataFrame:
    """(qid, K<k> for every k)."""
    found = nearest_neighbours(queries, train, features, label, ids, max(ks), center, scale)
    return found.groupBy("qid").agg(*map(weighted, ks))


def with_knn(queries: DataFrame, train: DataFrame, features: Sequence[str], label: str,
             ids: Sequence[str], k: int, center=None, scale=None,
             output: str = "YIELD_PRED") -> DataFrame:
    """The query rows plus the prediction column."""
    found = knn_predictions(queries, train, features, label, ids, [k], center, scale)
    keyed = queries.withColumn("qid", F.to_json(F.struct(*ids)))
    return keyed.join(found, "qid", "left").withColumnRenamed(f"K{k}", output).drop("qid")
