import random

import pytest
from pyspark.sql import functions as F

from propensity_spark.llm import decontaminate
from tests.llm.conftest import by_id


def brute(docs, items, size):
    """Every window compared at every place."""
    out = []
    for doc_id, text in docs:
        w = decontaminate.words((text or "").encode())
        hit, names = set(), set()
        for item, body in items:
            b = decontaminate.words((body or "").encode())
            n = min(size, len(b))
            windows = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if b else set()
            for i in range(len(w) - n + 1 if windows else 0):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    names |= set() if item is None else {str(item)}
        out.append((doc_id, len(w), len(hit), sorted(names)))
    return sorted(out, key=repr)


def made(seed):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choices(["a", "b", "C", "dé", "1"], k=n))
    items = [(i % 9, say(rng.randint(0, 9))) for i in range(14)] + [(None, "a b"), (None, "C 1 C 1 a"), (20, None), (21, "...")]
    docs = [(i, say(rng.randint(0, 60))) for i in range(40)] + [(40, None), (41, ""), (3, "a, B! c"), (3, "a, B! c")]
    return docs, items


@pytest.mark.parametrize("seed,block", [(1, 1 << 20), (2, 300), (3, 90)])
def test_equals_brute_force_in_one_and_in_many_blocks(spark, seed, block):
    docs, items = made(seed)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(
        items, "item_id long, text string")
    got = decontaminate.decontaminate(*frames, ["doc_id"], size=5, block_bytes=block)
    assert by_id(got.select("doc_id", "n_words", "n_hit", "items")) == [
        (a, b, c, d) for a, b, c, d in brute(docs, items, 5)]
    for r in got.collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_items_without_an_id_and_a_frequent_id(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([(1, passage + " own"), (2, "nothing here"), (3, "x70 y z")], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage)] + [(7, f"x{i} y z") for i in range(200)], "item_id long, text string")
    sizes, make = [], decontaminate.Index.__init__
    monkeypatch.setattr(decontaminate.Index, "__init__", lambda self, rows, size: sizes.append(len(rows)) or make(self, rows, size))
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, items, ["doc_id"], block_bytes=4000).collect()}
    assert (got[1]["n_hit"], got[1]["items"]) == (14, []) and got[2]["n_hit"] == 0
    assert (got[3]["n_hit"], got[3]["items"]) == (3, ["7"])
    assert sum(sizes) == 201 and max(sizes) < 120  # the frequent id is dealt to several blocks


def test_shifts_skip_what_cannot_end_a_window():
    windows = {tuple(f"w{i}".encode() for i in range(13)): [0]}
    table = decontaminate.WuManber(windows, 13)
    text = [b"x"] * 1000 + [f"w{i}".encode() for i in range(13)] + [b"x"] * 5
    looks = []

    class Seen(dict):
        def get(self, key, other):
            looks.append(key)
            return super().get(key, other)

    table.shift = Seen(table.shift)
    assert list(table.search(text)) == [(1000, [0])]
    assert len(looks) < 100


def test_odd_rows(odd_docs, no_docs, spark):
    items = spark.createDataFrame([("b", "B c, d"), ("b", "quick brown"), ("a", "one")], "item_id string, text string")
    got = {(r["doc_id"], r["text"]): r for r in decontaminate.decontaminate(
        odd_docs, items, ["doc_id", "text"]).collect()}
    assert got[3, "one"]["items"] == ["a"] and got[5, "a b c d e f g"]["n_hit"] == 3
    assert got[11, odd_docs.where("doc_id = 11").first()["text"]]["n_hit"] == 80
    assert got[0, None]["n_words"] == 0 and got[0, None]["items"] == []
    assert decontaminate.decontaminate(no_docs, items, ["doc_id"]).count() == 0
    none = decontaminate.decontaminate(odd_docs, items.where("false"), ["doc_id"])
    assert none.count() == odd_docs.count() and none.agg(F.sum("n_hit")).first()[0] == 0
