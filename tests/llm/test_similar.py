"""Near duplicates, decontamination, vector search, quality sampling: brute force on small tables."""

import collections
import itertools
import math
import random
import re
import sys

import numpy as np
import pytest

import corpus_pipeline
import seasonframe.llm.importance as importance
import seasonframe.llm.near_dedup as near
import seasonframe.llm.vector_search as vector_search
from seasonframe.llm.components import connected_components
from seasonframe.llm.decontaminate import benchmark_hits, least_hits
from seasonframe.llm.hashing import shingles, words
from seasonframe.llm.importance import kth_largest, quality_sample
from seasonframe.llm.near_dedup import least_matches, near_duplicates
from seasonframe.llm.vector_search import block_top, exact_top_k, quantised, segment_statistics
from seasonframe.llm.workers import importable


@pytest.fixture(autouse=True)
def on_path(spark):
    importable(spark)


def plain_set(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain_components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


# hashing and components

def test_words_and_shingles_count_as_plain_ones():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(["a", "B", "ä", " ", "\t", "\x0b", " ", "cd"])
                       for _ in range(rng.randint(0, 60)))
        assert len(set(words(text).tolist())) == len(set(text.encode().lower().split()))
        for n in (1, 2, 5):
            assert len(shingles(words(text), n)) == len(plain_set(text, n))


def test_long_texts_hash_as_their_parts(monkeypatch):
    monkeypatch.setattr("seasonframe.llm.hashing._PIECE", 50)
    text = "some words " * 30 + "x" * 200 + " tail"
    cut = words(text)
    monkeypatch.undo()
    assert (cut == words(text)).all()


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 60)]
    links += [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(7, 7), (3, 0)]
    data = spark.createDataFrame([*links, (None, 5)], "a long, b long")
    got = dict(tuple(r) for r in connected_components(data).collect())
    want = plain_components(links, {x for link in links for x in link})
    assert {k: v for k, v in want.items() if k in got} == got
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}
    assert connected_components(data.limit(0)).collect() == []


# near duplicates

def near_copies(seed, groups=12, copies=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for _ in range(copies):
            edited = [rng.choice(vocabulary) if rng.random() < rng.choice([0, .02, .05, .1]) else w
                      for w in base]
            texts.append(" ".join(edited))
    return texts + [None, "", " \n ", "single", "SINGLE", "two words", "Two  Words"]


def plain_near(texts, n):
    sets = {i: plain_set(t, n) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = plain_components(links, sets)
    return {(i, len(sets[i]), roots[i], roots[i] == i) for i in sets}


@pytest.mark.parametrize("n, block", [(2, 256), (5, 256), (2, 3)])
def test_near_duplicates(spark, monkeypatch, n, block):
    """Small blocks make every component a large one, so both ways of comparing blocks run."""
    monkeypatch.setattr(near, "BLOCK_ROWS", block)
    texts = near_copies(n + block)
    data = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, component_id string, kept int")
    assert {tuple(r) for r in near_duplicates(data, n).collect()} == plain_near(texts, n)


def test_near_duplicate_edges(spark):
    data = spark.createDataFrame([(None, "a b c"), (None, None), (4, "a b c"), (4, "a b c"),
                                  (2, "A  b c")], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(data, 2).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (None, 0, None, True), (4, 2, 2, False),
                          (4, 2, 2, False), (2, 2, 2, True)], key=str)
    assert near_duplicates(data.limit(0)).collect() == []


def test_near_dedup_stage_decides_row_by_row(spark):
    rng = random.Random(4)
    copied, alone, small, lone = (" ".join(rng.choices("abcdefghijklmnop", k=40)) for _ in range(4))
    data = [(7, copied), (7, copied), (None, copied), (None, lone), (None, lone),
            (3, small), (9, small), (9, alone), (5, None), (5, ""), (None, " ")]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr(
        "doc_id", "text", "1 AS _row")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and {r["_row"] for r in kept.collect()} == {1}
    assert sorted(map(repr, (r[:2] for r in kept.collect()))) == sorted(map(repr, [
        (7, copied), (None, lone), (3, small), (9, alone), (5, None), (5, ""), (None, " ")]))


def test_pruning_keeps_pairs_at_the_threshold():
    floors = least_matches(0.8, 1e-9)
    rng = np.random.default_rng(1)
    equal = (rng.random((20_000, 200)) < 0.8).reshape(20_000, -1, near.BATCH).sum(axis=2)
    assert (equal.cumsum(axis=1) >= floors).all()
    low = (rng.random((2000, 200)) < 0.4).reshape(2000, -1, near.BATCH).sum(axis=2)
    assert (low.cumsum(axis=1) < floors).any(axis=1).all()


# decontamination

def plain_hits(docs, items, n=5, percent=80):
    def cut(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    return {(d, i, len(cut(t) & cut(x)), len(cut(x))) for d, t in docs for i, x in items
            if d is not None and i is not None and cut(x)
            and 100 * len(cut(t) & cut(x)) >= percent * len(cut(x))}


def test_benchmark_hits(spark):
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(300)]
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    items = [(i, " ".join(say(rng.choice([2, 5, 8, 15, 40, 90])))) for i in range(40)]
    items += [(99, None), (98, ""), (None, "word1 word2")]
    docs = []
    for d in range(150):
        words_ = say(rng.choice([0, 3, 50, 800]))
        i, item = items[rng.randrange(40)]
        part = [w if rng.random() > rng.choice([0, .02, .1]) else "other" for w in item.split()]
        at = rng.randint(0, len(words_))
        docs.append((d, " ".join(words_[:at]) + "\n" + ", ".join(part).upper() + ". "
                     + " ".join(words_[at:])))
    docs += [(200, None), (201, ""), (None, items[3][1])]
    got = benchmark_hits(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, h int"),
                         spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r)[:4] for r in got.collect()} == plain_hits(docs, items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert benchmark_hits(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0


def test_benchmark_hits_run_no_python(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string").cache()
    plan = benchmark_hits(docs, docs.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution()
    assert "Python" not in plan.toString().replace("PythonRDD", "")


def test_least_hits():
    assert least_hits(16, 0.8, 0.5) > least_hits(16, 0.8, 1e-9) >= 1


# vector search

def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(60, 21)) * 50)
    for n in (1, 4, 16):
        stats = segment_statistics(x, n)
        assert (stats @ stats.T >= x @ x.T - 1e-6).all()


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr("seasonframe.llm.vector_search.ROW_BLOCK", 64)
    monkeypatch.setattr("seasonframe.llm.vector_search.QUERY_BLOCK", 4)
    rng = np.random.default_rng(5)
    vectors = np.floor(rng.normal(size=(300, 8)) * 2)  # many ties
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(vectors)]
    rows += [(1000, [1.0, 2.0]), (1020, [3.0, 1.0]), (2000, []), (None, [1.0] * 8), (2040, None)]
    data = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = {}
    for r in exact_top_k(data, data["vec_id"] % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 300, 20):
        scores = (vectors @ vectors[q]).astype(int)
        order = [i for i in np.lexsort((np.arange(300), -scores)) if i != q][:20]
        assert sorted(got[q]) == [(k + 1, i, scores[i]) for k, i in enumerate(order)]
    assert got[1000] == [(1, 1020, 5)] and got[1020] == [(1, 1000, 5)]
    assert not {2000, 2040, None} & set(got)
    assert exact_top_k(data.limit(0), data["vec_id"] % 20 == 0).collect() == []


def test_quantised_leaves_out_unusable_vectors(spark):
    data = spark.createDataFrame(
        [(1, [0.5, -0.01]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]),
         (5, [float("inf"), 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in quantised(data).collect()] == [(1, [32.0, -1.0])]


def test_scores_beyond_doubles_are_exact():
    rows = np.array([[2.0**40, 1.0], [2.0**40, 3.0], [2.0**40, 2.0]])
    got = block_top(np.array([9]), np.array([[2.0**22, 1.0]]), np.array([1, 2, 3]), rows, 2)
    assert list(got["vec_id"]) == [2, 3] and list(got["score"]) == [2**62 + 3, 2**62 + 2]


# quality sampling

def plain_top(query_ids, queries, row_ids, rows, k):
    out = []
    for query_id, query in zip(query_ids, queries):
        scores = [min(max(sum(int(x) * int(y) for x, y in zip(query, row)), -2**63), 2**63 - 1)
                  for row in rows]
        out += [(int(query_id), int(i), -s) for s, i in sorted(
            (-s, i) for s, i in zip(scores, row_ids) if i != query_id)[:k]]
    return sorted(out)


@pytest.mark.parametrize("scale", [1, 64, 4000, 2.0**30, 2.0**61])
def test_block_top_against_plain_scores(scale):
    """Ties, copies, ids that repeat and components whose products no double holds."""
    rng = np.random.default_rng(7)
    for trial in range(30):
        d, n, k = int(rng.choice([1, 3, 17, 40])), int(rng.integers(0, 120)), int(rng.choice([1, 3, 20]))
        rows = np.floor(rng.normal(size=(n, d)) * scale)
        if trial % 3 == 0:
            rows[n // 2:] = rows[:n - n // 2]
        ids = rng.permutation(2 * n)[:n] if trial % 2 else rng.integers(0, n // 2 + 1, n)
        query_ids = rng.permutation(2 * n + 9)[:9]
        queries = rows[rng.integers(0, n, 9)] if n and trial % 4 else np.floor(rng.normal(size=(9, d)) * scale)
        got = block_top(query_ids, queries, ids, rows, k)
        assert sorted(zip(*(got[c].tolist() for c in ("query_id", "vec_id", "score")))) == plain_top(
            query_ids, queries, ids, rows, k)


def test_bounds_of_like_vectors_leave_few_pairs_to_score(monkeypatch):
    """Queries whose rows are few, all in one of many groups, are scored with little else."""
    rng = np.random.default_rng(8)
    rows = np.repeat(np.floor(rng.choice([-60, 60], (200, 16))).repeat(4, axis=1), 30, axis=0)
    rows += rng.integers(-2, 3, rows.shape)
    scored, exact = [], vector_search._exact
    monkeypatch.setattr(vector_search, "_exact", lambda q, r, small: (
        scored.append(np.prod(np.broadcast_shapes(q.shape, r.shape)[:-1])), exact(q, r, small))[1])
    queries = np.arange(0, len(rows), 100)
    got = block_top(queries, rows[queries], np.arange(len(rows)), rows, 20)
    assert (got["vec_id"].to_numpy() // 30 == got["query_id"].to_numpy() // 30).all()
    assert 0 < sum(scored) < 0.2 * len(queries) * len(rows)


def test_queries_share_their_steps():
    """On vectors that no bound tells apart, too: no chain of small calls for every query."""
    rng = np.random.default_rng(9)
    rows, queries = np.floor(rng.normal(size=(4096, 64)) * 8), np.floor(rng.normal(size=(512, 64)) * 8)
    calls = collections.Counter()
    sys.setprofile(lambda frame, event, argument: calls.update([event]))
    try:
        got = block_top(-1 - np.arange(512), queries, np.arange(4096), rows, 20)
    finally:
        sys.setprofile(None)
    assert len(got) == 512 * 20
    assert calls["call"] + calls["c_call"] < 40 * 512


def test_kth_largest(spark):
    rng = random.Random(8)
    values = [rng.randint(-2**62, 2**62) for _ in range(200)] + [-1, 0, 0, 0, 1, 5, -2**63, 2**63 - 1]
    data = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    for k in (1, 2, 50, 105, len(values)):
        assert kth_largest(data, "v", k) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(data, "v", len(values) + 1) is None


def test_quality_sample(spark):
    rng = random.Random(4)
    good, bad = ([f"{p}{i}" for i in range(60)] for p in ("good", "bad"))
    docs, labels = [], []
    for i in range(300):
        fine = i % 2 == 0
        docs.append((i, " ".join(rng.choice(good if fine else bad) for _ in range(rng.randint(5, 400)))))
        if i < 100:
            labels.append((i, int(fine), 0))
    docs += [(900, None), (901, ""), (902, docs[0][1]), (902, docs[0][1])]
    labels += [(1, 1, 1), (None, 1, 0), (5, None, None)]
    data = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, selected string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_sample(data, marks).collect()
    assert len(got) == len(docs)
    chosen = {r["doc_id"] for r in got if r["selected"]}
    assert len([i for i in chosen if i % 2 == 0 and i < 300]) > 140 and not chosen & {900, 901}
    known = [r["gumbel_key"] for r in got if r["gumbel_key"] is not None]
    last = sorted(known, reverse=True)[round(len(known) / 2) - 1]
    assert all(r["selected"] == (r["gumbel_key"] is not None and r["gumbel_key"] >= last) for r in got)
    assert quality_sample(data.limit(0), marks).collect() == []


def test_quality_sample_counts_all_targets(spark, monkeypatch):
    seen, count = [], importance.count_model
    monkeypatch.setattr(importance, "count_model", lambda rows: seen.append(
        rows.count()) or count(rows))
    data = spark.range(20_500).selectExpr("id AS doc_id", "concat('word ', id) AS text")
    marks = spark.range(20_500).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert quality_sample(data, marks).count() == 20_500
    assert seen == [20_500, 20_500]


@pytest.mark.parametrize("bits", [importance.FILTER_BITS, 64])
def test_target_texts_are_exact_at_any_filter_size(spark, monkeypatch, bits):
    monkeypatch.setattr(importance, "FILTER_BITS", bits)
    data = spark.createDataFrame(
        [(i, f"t{i}") for i in [-7, -7, *range(300)]] + [(None, "n"), (4, None)],
        "doc_id long, text string")
    ids = spark.createDataFrame([(-7,), (4,), (9,), (1000,)], "doc_id long")
    got = importance.target_texts(data, ids).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in got) == [
        (-7, "t-7"), (-7, "t-7"), (4, ""), (4, "t4"), (9, "t9")]


def test_quality_sample_against_plain_counts_and_weights(spark):
    rng = random.Random(12)
    vocabulary = ["alpha", "beta", "gamma", "\u4f60\u597d", "x"]
    docs = [(f"d{i}" if i % 9 else None,
             " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    docs += [("-5", None), ("d1", "alpha alpha"), ("d1", docs[1][1]), ("long", "beta gamma " * 5000)]
    good = {"d1", "d2", "d4", "long"}
    data = spark.createDataFrame([(*d, 1) for d in docs], "doc_id string, text string, place int")
    marks = spark.createDataFrame([(g, 1, 0) for g in good] + [("d5", 1, 1), ("d7", 0, 0)],
                                  "doc_id string, quality int, toxic int")

    def grams(text):
        return [int(b) for b in importance.ngram_buckets(text)]

    def plain(chosen):
        counts = collections.Counter(b for t in chosen for b in grams(t))
        total = sum(counts.values()) + importance.BUCKETS
        return lambda b: math.log((counts[b] + 1) / total)
    p, q = plain([t for i, t in docs if i in good]), plain([t for _, t in docs])
    want = sorted((i or "", round(sum(p(b) - q(b) for b in grams(t)), 6) if grams(t) else None)
                  for i, t in docs if grams(t))
    rows = quality_sample(data, marks, fraction=0.25).collect()
    assert len(rows) == len(docs)
    known = [r for r in rows if r["log_weight"] is not None]
    assert sorted((r["doc_id"] or "", round(r["log_weight"], 6)) for r in known) == want
    top = sorted((r["gumbel_key"] for r in known), reverse=True)[:round(len(known) / 4)]
    assert all(r["selected"] == (r["log_weight"] is not None and r["gumbel_key"] >= top[-1])
               for r in rows)
    words = "alpha beta gamma".split()
    assert len(grams(" ".join(words))) == 5  # three words, two pairs


def test_quality_noise_is_standard_gumbel(spark):
    data = spark.range(4000).selectExpr("id - 2000 AS doc_id", "'same words here' AS text")
    keys = [r["gumbel_key"] - r["log_weight"] for r in importance.weigh(
        data, np.zeros(importance.BUCKETS)).collect()]
    assert len(set(keys)) == 4000
    assert abs(np.mean(keys) - 0.5772) < 0.1 and abs(np.var(keys) - math.pi**2 / 6) < 0.2
