"""The trie of rebuilt conversations and tree contraction against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from seasonframe.llm import prefix_trie as module
from seasonframe.llm.prefix_trie import trie_report
from seasonframe.llm.tree_contraction import subtree_totals
from seasonframe.llm.workers import importable


def plain(rows):
    """rows: (conv_id, turn, role, text) without ties of different turns."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        whole = turns.get(c - c % 100, [])[:h] + turns[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        last = len(node[-1][1]) if node else 0
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * last
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]),
                   leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
                  for n, m in members.items())


def compared(spark, rows):
    importable(spark)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in trie_report(df.repartition(5)).collect()),
                 key=lambda r: (r[0], r[1]))
    assert got == sorted(plain(rows), key=lambda r: (r[0], r[1]))
    return got


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 30), *range(100, 108), *range(250, 260)]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "", "ccc"])))
    copy = [(t, r, x) for c, t, r, x in rows if c == 7]
    rows += [(c, *x) for c in range(400, 430) for x in copy]  # copies of one conversation
    rows += [(100, None, "user", "first"), (5, 50, None, None), (None, 1, "user", "x")]
    return rows


def test_trie_against_a_plain_version(spark):
    assert len(compared(spark, conversations(4))) > 50


def test_trie_of_one_long_conversation(spark, monkeypatch):
    """Numbered and summed in parts; its chain is skipped in steps of four."""
    monkeypatch.setattr(module, "PART", 16)
    rows = [(3, t, "user", str(t % 7)) for t in range(150)]
    rows += [(9, t, "user", str(t % 7) if t < 90 else "x") for t in range(120)]
    compared(spark, rows + conversations(5))


def test_turnless_members_and_empty_table(spark):
    rows = [(c, 0, "user", "t") for c in range(1, 40)]  # no source, so many lose their only turn
    got = compared(spark, rows)
    assert got[0][1] == 0 and got[0][3] == 39
    importable(spark)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie_report(none).collect() == []


@pytest.mark.parametrize("shape", ["random", "path", "star", "broom", "binary"])
def test_subtree_totals(spark, shape):
    rng, n = random.Random(shape), 120
    parent = {0: None}
    for i in range(1, n):
        parent[i] = {"random": rng.randrange(i), "path": i - 1, "star": 0,
                     "broom": i - 1 if i < 60 else 59, "binary": (i - 1) // 2}[shape]
    rows = [(i, p, i, None if i % 5 == 0 else 1) for i, p in parent.items()] + [(500, None, 9, 9)]
    want = {i: [v, w or 0] for i, _, v, w in rows}
    for i in range(n - 1, 0, -1):
        for k in (0, 1):
            want[parent[i]][k] += want[i][k]
    df = spark.createDataFrame(rows, "id long, parent long, x long, y long")
    got = {r.id: [r.x, r.y] for r in subtree_totals(df, ["x", "y"]).collect()}
    assert got == want
