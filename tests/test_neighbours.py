"""The pivot index and the search over it, against all distances at once."""

import numpy as np
import pytest

from seasonframe.operators import models, neighbours
from seasonframe.operators.neighbours import PivotIndex

D = 5
NAMES = [f"f{j}" for j in range(D)]


def clustered(n, seed=7):
    """Rows around 12 centres, some far apart; a third of all rows are equal."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, D)) * 20
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, D))
    x[rng.random(n) < 1 / 3] = centres[0]
    return x, rng.normal(50, 5, n)


def all_distances(q, x):
    return np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))


@pytest.mark.parametrize("n,k", [(1, 3), (7, 9), (900, 1), (900, 9), (900, 400)])
def test_index_names_every_cell_that_matters_and_few_others(n, k):
    x, _ = clustered(n)
    q, _ = clustered(60, seed=8)
    index = PivotIndex(x[:int(np.ceil(np.sqrt(n)))])
    cell, dist = index.cells(x)
    assert dist == pytest.approx(np.sqrt(((x - index.pivots[cell]) ** 2).sum(1)))
    sizes = np.bincount(cell, minlength=len(index.pivots))
    radii = np.zeros(len(index.pivots))
    np.maximum.at(radii, cell, dist)
    index.filled(sizes, radii, k)

    d = all_distances(q, x)
    home = set(zip(*(a.tolist() for a in index.homes(q))))
    reach = np.array([np.sort(d[i, [(i, c) in home for c in cell]])[min(k, n) - 1]
                      for i in range(len(q))])
    more = set(zip(*(a.tolist() for a in index.beyond(q, reach))))
    assert not home & more
    for i, row in enumerate(d):
        for j in row.argsort(kind="stable")[:k]:
            assert (i, cell[j]) in home | more or row[j] >= reach[i]
    if n == 900 and k < 10:
        assert len(home | more) < 0.5 * len(q) * len(index.pivots)


def frames(spark, n):
    x, y = clustered(n)
    kinds = "IDREGION string, FYEAR int, " + ", ".join(f"{f} double" for f in NAMES)
    train = spark.createDataFrame(
        [(f"R{i}", 2000, *map(float, row), float(v)) for i, (row, v) in enumerate(zip(x, y))],
        kinds + ", YIELD double")
    q = np.concatenate([clustered(40, seed=9)[0], x[:5]])
    asked = spark.createDataFrame(
        [(f"Q{i}", 2001, *map(float, row)) for i, row in enumerate(q)], kinds)
    return train, asked, x, q


@pytest.mark.parametrize("n,chunk", [(3, 1024), (500, 16)])
def test_distances_of_the_nearest_rows(spark, monkeypatch, n, chunk):
    """Small chunks and query blocks force several of both, hot rows included."""
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", chunk)
    train, asked, x, q = frames(spark, n)
    found = {}
    for r in neighbours.nearest_neighbours(
            asked, train, NAMES, "YIELD", models.IDS, 9).collect():
        found.setdefault(r["qid"], []).append((r["RANK"], r["dist"]))
    want = np.sort(all_distances(q, x), axis=1)[:, :9]
    for i, row in enumerate(want):
        got = sorted(found[f'{{"IDREGION":"Q{i}","FYEAR":2001}}'])
        assert [rank for rank, _ in got] == list(range(1, len(row) + 1))
        assert [d for _, d in got] == pytest.approx(row, abs=1e-9)


def test_chunks_are_copied_only_where_asked_for(spark, monkeypatch):
    """One far query: a search over its home cells moves these cells' rows and no others."""
    moved = []
    searched = neighbours._searched

    def spy(visits, cells, chunks, k):
        named = {r["cell"] for r in visits.select("cell").collect()}
        moved.append((len(named), cells.select("cell").distinct().count()))
        return searched(visits, cells, chunks, k)

    monkeypatch.setattr(neighbours, "_searched", spy)
    train, asked, _, _ = frames(spark, 500)
    neighbours.nearest_neighbours(asked.limit(1), train, NAMES, "YIELD", models.IDS, 3).collect()
    assert len(moved) == 2 and all(named < 0.6 * cells for named, cells in moved)


def test_without_training_rows_nobody_has_neighbours(spark):
    train, asked, _, _ = frames(spark, 3)
    assert neighbours.nearest_neighbours(
        asked, train.filter("false"), NAMES, "YIELD", models.IDS, 3).count() == 0
    out = neighbours.with_knn(asked, train.filter("false"), NAMES, "YIELD", models.IDS, 3)
    assert {r["YIELD_PRED"] for r in out.collect()} == {None}
