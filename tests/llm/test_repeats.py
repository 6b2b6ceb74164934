"""Suffix arrays against sorted suffixes, and removal of repeated strings against a plain count."""

import hashlib
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from seasonframe.llm import repeats
from seasonframe.llm import suffix_array as module
from seasonframe.llm.repeats import cover, repeats_report, widths, without_repeats
from seasonframe.llm.suffix_array import permuted_common_prefixes, suffix_array
from seasonframe.llm.workers import importable
from seasonframe.storage import cut


@pytest.mark.parametrize("symbols", [3, 1024])
def test_suffix_array_and_common_prefixes(monkeypatch, symbols):
    monkeypatch.setattr(module, "SMALL", 4)
    monkeypatch.setattr(module, "SYMBOLS", symbols)
    rng = np.random.default_rng(1)
    for trial in range(200):
        text = rng.integers(0, rng.integers(1, 6), rng.integers(1, 200)).astype(np.uint8)
        if trial % 3 == 0:
            text = np.tile(text[:max(1, len(text) // 7)], 7)
        data = text.tobytes()
        order = suffix_array(text)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        before, shared = permuted_common_prefixes(text, order)
        for i, j in zip(order[1:].tolist(), order[:-1].tolist()):
            assert before[i] == j
            n = shared[i]
            assert data[i:i + n] == data[j:j + n] and data[i + n:i + n + 1] != data[j + n:j + n + 1]


def test_common_prefixes_do_not_depend_on_how_many_are_compared_at_once(monkeypatch):
    text = np.random.default_rng(2).integers(0, 3, 5000).astype(np.uint8)
    order = suffix_array(text)
    want = permuted_common_prefixes(text, order)
    monkeypatch.setattr(module, "COMPARED", 7)
    for a, b in zip(permuted_common_prefixes(text, order), want):
        assert a.tolist() == b.tolist()


def test_memory_of_a_shard():
    """A worker keeps what a shard took, so it counts for all that follows."""
    rng = np.random.default_rng(4)
    words = rng.integers(97, 123, (3000, 8)).astype(np.uint8)
    text = words[rng.integers(0, 3000, 1 << 16)].ravel()
    suffix_array(text)  # what is kept for the next shard is there
    tracemalloc.start()
    try:
        order = suffix_array(text)
        sorting = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        permuted_common_prefixes(text, order)
        comparing = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert max(sorting, comparing) < 40 * len(text)


def test_suffix_array_of_nothing():
    assert suffix_array(np.empty(0, np.uint8)).tolist() == []


def test_widths_end_at_the_whole_string():
    for length in (1, 2, 5, 40, 400):
        steps = widths(length)
        assert steps[-1] == length and all(a < b for a, b in zip(steps, steps[1:]))


def test_cover_joins_touching_spans():
    assert cover([(5, 6), (0, 1), (30, 30)], 4) == [(0, 10), (30, 34)]


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        left = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    def word(n):
        return "".join(rng.choice(list("abcdeé "), n))
    passages = [word(int(n)) for n in rng.integers(15, 120, 12)]
    texts = [None, "", "short", "é" * 50, "ab" * 60, "a" * 300, "a" * 41, passages[0], passages[0]]
    for _ in range(120):
        parts = [word(int(rng.integers(0, 80)))]
        for _ in range(int(rng.integers(0, 4))):
            parts += [passages[int(rng.integers(0, 12))], word(int(rng.integers(0, 40)))]
        texts.append("".join(parts))
    common = word(60)  # in a third of the texts, with other text around it
    return texts + [word(30) + common + word(30) for _ in range(60)] + texts[20:40]


@pytest.mark.parametrize("group_bytes, shard_bytes", [(1 << 20, 1 << 20), (500, 3000)])
def test_repeats_against_a_plain_count(spark, group_bytes, shard_bytes):
    """With small groups, frequent grams are dealt anew by wider ones, down to whole strings."""
    importable(spark)
    texts = corpus(3)
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string").repartition(3)
    got = repeats_report(docs, 40, group_bytes=group_bytes, shard_bytes=shard_bytes).collect()
    want = Counter((r[0], *p) for r, p in zip(rows, plain(texts, 40)))
    assert Counter(map(tuple, got)) == want


def test_rest_keeps_other_columns_and_empty_tables(spark):
    importable(spark)
    text = "0123456789" * 3
    docs = spark.createDataFrame([(1, "ab" + text, 5), (2, text + "cd", 6), (3, None, 7), (4, "x", 8)],
                                 "doc_id long, text string, k1 int")
    got = {r.doc_id: (bytes(r.rest) if r.rest is not None else None, r.k1)
           for r in without_repeats(docs, 30).collect()}
    assert got == {1: (b"ab", 5), 2: (b"cd", 6), 3: (None, 7), 4: (b"x", 8)}
    assert repeats_report(docs.limit(0), 30).count() == 0


def python_steps(plan: str) -> int:
    """Most Python steps that one task runs at the same time, each in a worker of its own."""
    above, most = [], 0  # (depth, steps) from the root to the line before
    for line in plan.splitlines():
        depth = re.search(r"[A-Za-z(]|\Z", line.replace("*(", "  ")).start()
        while above and above[-1][0] >= depth:
            above.pop()
        steps = 0 if "Exchange" in line or not above else above[-1][1]
        steps += bool(re.search(r"MapIn|FlatMapGroups|EvalPython", line))
        above.append((depth, steps))
        most = max(most, steps)
    return most


def test_a_task_has_one_python_worker(spark, monkeypatch):
    importable(spark)
    plans = []
    monkeypatch.setattr(repeats, "cut", lambda df: plans.append(df) or cut(df))
    docs = spark.createDataFrame([(i, word * 9) for i, word in enumerate(["abcde", "bcdea", "x"])],
                                 "doc_id long, text string")
    plans.append(repeats_report(docs, 10))
    found = [python_steps(p._jdf.queryExecution().executedPlan().toString()) for p in plans]
    assert max(found) == 1
