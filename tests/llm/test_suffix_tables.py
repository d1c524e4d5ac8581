import random
import zlib

import pytest

from propensity_spark.llm import queries, suffix_tables, suffix_tree
from tests.llm.test_suffix_tree import corpus

FLOORS = dict(frequent=0.0, often=0.0, entry=0.0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("held", [1 << 19, 64])
def test_the_tables_score_as_the_tree_without_shares(spark, monkeypatch, held):
    monkeypatch.setattr(suffix_tables, "HELD", held)
    monkeypatch.setattr(suffix_tables, "PAIRS", 500)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    counts = suffix_tree.word_counts(docs)
    tree = suffix_tree.train(docs, counts, **FLOORS)
    assert all(x.kept.sum() > 0 for x in tree.levels[:2])
    tables = suffix_tables.train(docs, counts)
    assert (tables.train_tokens, tables.vocabulary) == (tree.train_tokens, tree.vocabulary)
    new = corpus(9, 40) + [(900, ""), (901, None), (902, "unseen words only"), (903, "a b unseen A b"), (None, "a b c")]
    new = spark.createDataFrame(new, "doc_id long, text string")
    want, got = by_id(suffix_tree.score(new, tree, counts)), by_id(suffix_tables.score(new, tables))
    assert got.keys() == want.keys() and len(want) == 45
    for k, r in got.items():
        assert tuple(r)[:3] == tuple(want[k])[:3]
        assert tuple(r)[3:] == pytest.approx(tuple(want[k])[3:], abs=1e-6)


def test_a_repeated_passage_counts_however_large_the_corpus(spark, tmp_path):
    """A passage that is learned five times, beside 640,000 tokens of which 1e-5 are more than that."""
    rng, passage = random.Random(3), "lorem ipsum dolor sit amet consectetur adipiscing elit sed do"
    copies = [i for i in range(5000, 5100) if zlib.crc32(str(i).encode()) % 5 != 1][:5]
    rows = [(i, " ".join(rng.choices("abcdefgh", k=500))) for i in range(1600)] + [(i, passage) for i in copies]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_suffix_tree(spark, str(tmp_path)).where("doc_id >= 5000").first()
    assert got["train_tokens"] > 600_000
    assert got["score"] > 0.5 * got["base_score"]


def test_odd_rows(odd_docs, no_docs):
    counts = suffix_tree.word_counts(odd_docs)
    tables = suffix_tables.train(odd_docs, counts, least=2)
    got = suffix_tables.score(odd_docs, tables)
    assert got.count() == odd_docs.count() and got.where("n_tokens <> n_known OR score IS NULL OR isnan(score)").count() == 0
    assert suffix_tables.score(no_docs, tables).count() == 0
    empty = suffix_tables.train(no_docs, suffix_tree.word_counts(no_docs))
    got = suffix_tables.score(odd_docs, empty)
    assert got.count() == odd_docs.count() and got.where("n_known <> 0").count() == 0


def test_tokens_are_told_apart_as_plain_python_does():
    rng = random.Random(5)
    words = ["a", "b" * 8, "b" * 9, "b" * 17, "c" * 256, "c" * 257, "c" * 5000, "É", "é", "x\x00", "x", "\x00"]
    texts = ["", " ", "A a\x0bB\x1cb"] + [rng.choice(" \t\n\r\f\v").join(rng.choices(words, k=30)) for _ in range(50)]
    texts = [t.encode() for t in texts]
    keys, end, sizes = suffix_tables.tokens(texts)
    plain = [suffix_tree.tokens(t) for t in texts]
    flat = [w for t in plain for w in t]
    assert sizes.tolist() == [len(t) for t in plain] and end.tolist() == [w == suffix_tree.END for w in flat]
    pairs = set(zip(flat, map(tuple, keys.T.tolist())))
    assert len(pairs) == len(set(flat)) == len({k for _, k in pairs})


def test_keys_without_a_free_slot_are_held_too():
    keys = suffix_tables.hashed(bytes(range(256)) * 4 + bytes(8), suffix_tables.np.arange(256), suffix_tables.np.full(256, 2))
    keys[1] %= 4
    held = suffix_tables.Held(keys[:, :200], suffix_tables.np.zeros(200, suffix_tables.ADDED))
    assert held(keys).tolist() == [*range(200), *[-1] * 56]
