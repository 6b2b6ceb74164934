"""Residue products against whole numbers, and hard negatives against a plain loop."""

import numpy as np
import pytest

from seasonframe.llm.hard_negatives import (
    Scores, _primes, hard_negatives, moduli, negatives_report, residues)
from seasonframe.llm.workers import importable
from pyspark.sql import functions as F


def test_primes_and_moduli():
    assert all(p % q for p in _primes() for q in range(2, p))
    primes = moduli(10**30)
    assert np.prod(np.array(primes, object)) > 2 * 10**30
    assert np.prod(np.array(primes[:-1], object)) <= 2 * 10**30
    x = np.arange(-2000.0, 2000)
    r = residues(x, 509)
    assert np.abs(r).max() <= 254 and ((x - r) % 509 == 0).all()


@pytest.mark.parametrize("size, d", [(5, 3), (300, 64), (300, 700), (2**40, 9), (2**52, 30)])
def test_scores_are_exact(size, d):
    rng = np.random.default_rng(d)
    a, b = (rng.integers(-size, size + 1, (n, d)).astype(float) for n in (7, 11))
    want = [[min(max(sum(int(x) * int(y) for x, y in zip(p, q)), -2**63), 2**63 - 1) for q in b]
            for p in a]
    assert Scores(a, b).of(slice(0, 7)).tolist() == want


def plain(rows, is_anchor, k=5):
    """rows: (vec_id, label, v)."""
    out = []
    for a, la, va in rows:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, lab) for i, lab, v in rows
                        if i != a and len(v) == len(va))
        for s, i, _ in [x for x in scored if x[2] == la][:k]:
            p = -s
            fits = [x for x in scored if x[2] != la and 80 * p <= -100 * x[0] <= 100 * p][:k]
            out += [(a, i, n, j, p, -t) for n, (t, j, _) in enumerate(fits, 1)]
    return sorted(out)


def test_hard_negatives_against_a_plain_loop(spark):
    importable(spark)
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), [int(x) for x in rng.integers(-4, 9, 3 if i % 9 else 5)])
            for i in range(200)]
    rows += [(200 + i, 1, rows[20][2]) for i in range(30)]  # ties
    df = spark.createDataFrame([(i, la, [float(x) for x in v]) for i, la, v in rows],
                               "vec_id long, label long, v array<double>").repartition(5)
    got = sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 4 == 0).collect()))
    assert got == plain(rows, lambda i: i % 4 == 0)
    assert got


def test_what_takes_no_part(spark):
    importable(spark)
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.9, 0.0]), (3, None, [1.0, 1.0]),
            (None, 2, [1.0, 0.0]), (4, 2, None), (5, 2, [1.0, nan]), (6, 2, [1.0, inf]),
            (8, 2, [1.0, None]), (9, 2, []), (100, 1, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    # anchor 0 becomes label 2, so row 2 is its positive and row 1 the negative beyond its window
    assert [tuple(r) for r in negatives_report(df).collect()] == []
    df = df.where("vec_id != 0").union(spark.createDataFrame(
        [(0, 0, [1.0, 1.0])], "vec_id long, label int, embedding array<float>"))
    got = [tuple(r) for r in negatives_report(df).collect()]
    assert got == [(0, 1, 1, 2, 65536, 256 * 230)]
    assert negatives_report(df.limit(0)).count() == 0
