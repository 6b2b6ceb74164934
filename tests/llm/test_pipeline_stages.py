"""Each stage, and run, with null and repeated ids, clashing names and empty tables."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import seasonframe.llm.membership as membership
from seasonframe.storage import checkpoint_dir

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, _row string, "
           "_found string, _found_score string, _redacted string")


def sentence(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(n))


ITEM = sentence(1, 30)


def docs_of(spark, texts):
    """texts: (doc_id, text); the clashing columns say where a row comes from."""
    rows = [(i, t, "en", "s", None if t is None else len(t), f"r{n}", f"f{n}", f"p{n}", f"x{n}")
            for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


def kept(df):
    """Numbers of the rows that stayed, whose clashing columns are as they were."""
    rows = df.collect()
    for r in rows:
        n = r["_row"][1:]
        assert (r["_found"], r["_found_score"], r["_redacted"]) == (f"f{n}", f"p{n}", f"x{n}")
    return sorted(int(r["_row"][1:]) for r in rows)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(0, ITEM), (None, sentence(90)), (1, None)],
                          "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_language_keeps_what_has_a_letter(spark, sf_dir):
    texts = [(1, "the cat"), (1, "12 34"), (None, "der hund"), (2, None), (3, ""), (4, "é")]
    got = corpus_pipeline.language(spark, docs_of(spark, texts), sf_dir)
    assert kept(got) == [0, 2, 5] and got.columns == docs_of(spark, texts[:1]).columns


def test_near_dedup_by_row(spark, sf_dir):
    a, b, c = sentence(11), sentence(12), sentence(13)
    texts = [(5, a), (3, a + " z"), (5, b), (None, b), (None, c), (None, c), (7, None), (7, ""), (8, "")]
    got = kept(corpus_pipeline.near_dedup(spark, docs_of(spark, texts), sf_dir))
    assert got[:2] == [1, 2] and len(set(got) & {4, 5}) == 1 and set(got) >= {6, 7, 8}
    assert 0 not in got and 3 not in got


def plain_near_dedup(rows):
    """Numbers of the rows that stay, of (doc_id, text) in which every doc_id and text is its own,
    comes with equal rows only, or has no doc_id."""
    sets = {}
    for i, (_, text) in enumerate(rows):
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}
    for i in sets:
        for k in range(i):
            both = sets[i] & sets[k]
            if both and 100 * len(both) >= 80 * len(sets[i] | sets[k]) and group[i] != group[k]:
                old = group[i]
                group = {x: group[k] if g == old else g for x, g in group.items()}
    first = {}
    for i, g in group.items():
        rank = (rows[i][0] is None, rows[i][0] or 0, i)
        first[g] = min(first.get(g, rank), rank)
    return [rank[2] for rank in first.values()]


def many_texts(seed, words_each=60):
    """Texts alone, in copies, in near copies, and without a word; ids ascend against the rows."""
    rng, out = random.Random(seed), []
    for g in range(25):
        base = sentence(f"{seed} {g}", words_each).split()
        for _ in range(rng.choice([1, 1, 2, 5])):
            out.append(" ".join(rng.choice([base, base[:-1], base[1:]])))
    out += [None, None, "", "", " \n", "\u00a0", "\u00a0"]
    return [(None if i % 11 == 5 else 1000 - i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("bits", [1 << 24, 64])
def test_near_dedup_against_a_plain_version(spark, monkeypatch, bits):
    """With 64 bits the filter lets every row through, and the joins decide alone."""
    monkeypatch.setattr(membership, "FILTER_BITS", bits)
    rows = many_texts(bits)
    got = kept(corpus_pipeline.near_dedup(spark, docs_of(spark, rows).repartition(5), ""))
    want = plain_near_dedup(rows)
    both = [sorted((str(rows[i][0]), str(rows[i][1])) for i in x) for x in (got, want)]
    assert both[0] == both[1] and len(want) < len(rows)


def test_near_dedup_writes_and_shuffles_no_copy_of_all_texts(spark):
    """Tables written on the way are smaller than the texts; the result shuffles likely rows only."""
    rows = [(i, sentence(f"long {i}", 6000)) for i in range(30)] + [(99, sentence("long 3", 6000))]
    size = sum(len(t) for _, t in rows)
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    got = corpus_pipeline.near_dedup(spark, docs_of(spark, rows), "")
    assert sum(p.stat().st_size for p in folder.rglob("*.parquet")) - before < size / 4
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == list(range(30))


def test_text_keys_that_collide_are_dealt_anew(spark, monkeypatch):
    true = corpus_pipeline._hashed
    monkeypatch.setattr(corpus_pipeline, "_hashed", lambda *first: F.lit(5).cast("long")
                        if first == (0,) else true(*first))
    texts = [(1, sentence(51)), (2, sentence(52)), (3, sentence(51))]
    assert kept(corpus_pipeline.near_dedup(spark, docs_of(spark, texts), "")) == [0, 1]


def test_filter_lets_all_keys_through_and_few_others(spark):
    among = membership.may_be_among(spark.range(0, 5000, 5).toDF("k"), "k")
    got = {r["id"] for r in spark.range(5000).where(among(F.col("id"))).collect()}
    assert got >= set(range(0, 5000, 5)) and len(got) < 1010


def test_decontaminate_by_row(spark, sf_dir):
    holder = f"{sentence(21)} {ITEM} {sentence(22)}"
    texts = [(1, holder), (1, sentence(23)), (None, holder), (2, sentence(24)), (None, sentence(25)),
             (3, None), (4, ITEM.upper())]
    assert kept(corpus_pipeline.decontaminate(spark, docs_of(spark, texts), sf_dir)) == [1, 3, 4, 5]


def test_secrets_are_replaced_and_nothing_else(spark, sf_dir):
    texts = [(1, "password = abcdefgh12 end"), (1, "clean"), (None, None), (2, "")]
    got = corpus_pipeline.secrets(spark, docs_of(spark, texts), sf_dir)
    assert kept(got) == [0, 1, 2, 3]
    by_row = {r["_row"]: (r["text"], r["n_chars"]) for r in got.collect()}
    assert by_row == {"r0": ("[SECRET] end", 12), "r1": ("clean", 5), "r2": (None, None), "r3": ("", 0)}


def test_packing_has_every_row(spark, sf_dir):
    texts = [(1, "one"), (1, "two"), (None, "three"), (2, None)]
    got = corpus_pipeline.packing(spark, docs_of(spark, texts), sf_dir).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "2", "None"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, sf_dir, name, stage):
    assert stage(spark, docs_of(spark, [(1, "x")]).limit(0), sf_dir).collect() == []


def test_run_over_all_stages(spark, sf_dir):
    a = sentence(31)
    texts = [(1, a), (2, a), (3, f"{sentence(32)} {ITEM}"), (4, "12 34"), (None, sentence(33)),
             (6, "token: abcdefgh12345 " + sentence(34))]
    docs_of(spark, texts).drop("_row", "_found", "_found_score", "_redacted").write.parquet(
        f"{sf_dir}/documents.parquet")
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "6", "None"]
    assert len({r["sequence_id"] for r in got}) == 1
