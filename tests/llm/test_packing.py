"""Tokens, packing, matrices, sharding: exact round trips and bounds."""

import random
import zlib

import numpy as np
import pytest

from seasonframe.llm.packing import pack, packed_documents, plan_packing
from seasonframe.llm.sharding import fisher_yates, shard_report, shuffle_into_shards, write_shards
from seasonframe.llm.token_matrix import best_fit_decreasing, token_matrix, write_token_matrix
from seasonframe.llm.tokens import token_bytes
from seasonframe.llm.workers import importable

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = [(1, "One short text."), (2, None), (3, ""), (4, "word " * 5000), (5, "Tie one"),
         (6, "Tie two"), (6, "Tie two"), (None, "no id"), (8, "x" * 3000), (9, "\n\t , . ")]


@pytest.fixture(autouse=True)
def on_path(spark):
    importable(spark)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, 7, "z") for i, t in TEXTS],
                                 "doc_id long, text string, length int, sequence_id string")


def test_token_ids_are_the_tokenizers():
    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    parts = ["A", "bc", "É", "é", " ", "\n", ",", ".", "'s", "'S", "1", "ab1", "\t", "\x1c",
             " ", "ΑΣ", "İ", "ß", "<|endoftext|>", "<", "\U0001f600", "don't",
             "_", "-", "　", "WORD."]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(12))
        ids = whole.encode(text, add_special_tokens=False).ids
        assert token_bytes(text) == np.array([*ids, 0], "<u4").tobytes(), text


def check_plan(counts, capacity):
    plan = plan_packing(counts, capacity)
    filled = {}
    for length in counts:
        runs = sorted(p[1:] for p in plan.places if p[0] == length)
        ends = [r[0] for r in runs[1:]] + [counts[length]]
        assert runs[0][0] == 0
        for (rank, sequence, offset), end in zip(runs, ends):
            for k in range(end - rank):
                filled.setdefault(sequence + k, []).append((offset, length))
    for segments in filled.values():
        at = 0
        for offset, length in sorted(segments):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(filled) == plan.sequences
    return plan.sequences


def test_plans_are_valid_and_near_the_bound():
    rng = random.Random(1)
    for capacity, draws in ((10, 30), (64, 500), (2048, 3000)):
        for _ in range(4):
            counts = {}
            for _ in range(draws):
                length = min(capacity, int(rng.paretovariate(0.7) * capacity / 20) + 1)
                counts[length] = counts.get(length, 0) + 1
            used = check_plan(counts, capacity)
            lengths = [x for x, n in counts.items() for _ in range(n)]
            assert used <= len(best_fit_decreasing(lengths, capacity)) + 1
    assert check_plan({6: 5, 5: 1, 4: 5}, 10) == 6
    assert check_plan({2048: 100_000, 7: 3}, 2048) == 100_001
    assert plan_packing({}, 10).sequences == 0
    with pytest.raises(ValueError):
        plan_packing({11: 1}, 10)


def test_packed_documents(spark, docs):
    got = packed_documents(docs).toPandas()
    ids = {}
    for i, text in TEXTS:
        ids.setdefault(i, []).append(token_bytes(text))
    for i, whole in ids.items():
        rows = got[got["doc_id"].isna() if i is None else got["doc_id"] == i]
        assert rows["length"].sum() == sum(len(b) // 4 for b in whole)
        for r in rows.itertuples():
            piece = whole[0][4 * r.start:4 * (r.start + r.length)]
            assert (r.start, r.ids_crc32) == (2048 * r.piece, zlib.crc32(piece))
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert list(rows["offset"]) == [0, *np.cumsum(rows["length"])][:-1]
        assert rows["length"].sum() <= 2048
    assert packed_documents(docs.limit(0)).collect() == []


def test_pack_numbers_a_hot_length_in_cells(spark, monkeypatch):
    monkeypatch.setattr("seasonframe.llm.packing.CELL_ROWS", 50)
    rows = spark.range(3000).selectExpr("id", "if(id < 2000, 5L, id % 10 + 1) AS length")
    got = pack(rows, ["id"], 10).toPandas()
    assert len(got) == 3000 and not got.duplicated(["sequence_id", "offset"]).any()
    assert got.groupby("sequence_id")["length"].sum().max() <= 10


def test_best_fit_decreasing_against_a_plain_version():
    rng = random.Random(2)
    for _ in range(200):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(0, 40))]
        bins = best_fit_decreasing(lengths, 20)
        free = []
        for length in sorted(lengths, reverse=True):
            fits = [f for f in free if f >= length]
            if fits:
                free.remove(min(fits))
            free.append((min(fits) if fits else 20) - length)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert sorted(20 - sum(lengths[i] for i in b) for b in bins) == sorted(free)


def test_token_matrix_round_trip(spark, docs, tmp_path):
    write_token_matrix(docs.repartition(2), str(tmp_path / "m"), window=5000)
    found = {}
    for r in spark.read.parquet(str(tmp_path / "m")).collect():
        ids, places = (np.frombuffer(r[c], "<u2") for c in ("ids", "position_ids"))
        ends = r["cu_seqlens"]
        assert len(ids) == len(places) == 2048 and ends[-1] == r["n_tokens"] <= 2048
        assert not ids[r["n_tokens"]:].any()
        for k, (doc_id, piece) in enumerate(zip(r["doc_ids"], r["pieces"])):
            span = slice(ends[k], ends[k + 1])
            assert list(places[span]) == list(range(ends[k + 1] - ends[k]))
            found.setdefault((doc_id, piece), []).append(ids[span].astype("<u4").tobytes())
    for i, text in TEXTS:
        whole = token_bytes(text)
        count = -(-len(whole) // (4 * 2048))
        assert b"".join(found[i, k][0] for k in range(count)) == whole
    assert len(found[6, 0]) == 2
    assert token_matrix(docs.limit(0)).collect() == []


def test_fisher_yates_is_uniform():
    rng = np.random.default_rng(4)
    seen = {}
    for _ in range(6000):
        order = tuple(fisher_yates(3, rng))
        seen[order] = seen.get(order, 0) + 1
    assert len(seen) == 6 and all(850 < n < 1150 for n in seen.values())
    assert list(fisher_yates(0, rng)) == [] and list(fisher_yates(1, rng)) == [0]


def test_shards(spark, docs, tmp_path):
    got = shard_report(docs, 3).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(TEXTS) and sizes.max() - sizes.min() <= 1
    for _, rows in got.groupby("shard"):
        assert sorted(rows["slot"]) == list(range(len(rows)))
    crcs = {zlib.crc32((t or "").encode()) for _, t in TEXTS}
    assert set(got["text_crc32"]) == crcs and got["size"].min() == 1
    assert shard_report(docs.limit(0)).collect() == []
    write_shards(docs, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(TEXTS) and back.select("shard").distinct().count() == 3


def test_repeated_rows_scatter_over_buckets(spark):
    same = spark.range(4000).selectExpr("1L AS doc_id", "'x' AS text")
    got = shuffle_into_shards(same, 8, bucket_bytes=16_000).toPandas()
    assert got.groupby("shard").size().nunique() == 1 and len(got) == 4000
    assert not got.duplicated(["shard", "slot"]).any()


def test_shards_keep_columns_with_clashing_names(spark):
    rows = [(i, f"t{i}", i % 3, "b", "c", 9, 9) for i in range(50)]
    df = spark.createDataFrame(
        rows, "doc_id long, text string, _bucket int, _place string, `a.b` string, shard int, slot int")
    got = shuffle_into_shards(df, 4, bucket_bytes=500).toPandas()
    assert sorted(got["doc_id"]) == list(range(50))
    assert (got["_bucket"] == got["doc_id"] % 3).all() and (got["_place"] == "b").all()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_records_move_once(spark):
    """One exchange writes the buckets; numbering them reads the written table in place."""
    df = spark.range(1000).selectExpr("id AS doc_id", "repeat('x', 20) AS text")
    plan = shuffle_into_shards(df, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
