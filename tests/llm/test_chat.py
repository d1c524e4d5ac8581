import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from propensity_spark.llm import chat
from tests.llm.conftest import by_id

SCHEMA = "conv_id long, message_id long, parent_id long, role string, text string, score double"


def brute(rows, per_tree):
    """All root-to-leaf paths, walked one by one."""
    ids = {(r[0], r[1]) for r in rows if r[1] is not None}
    up = {(r[0], r[1]): (r[0], r[2]) if (r[0], r[2]) in ids else None for r in rows if r[1] is not None}
    score = {(r[0], r[1]): r[5] or 0.0 for r in rows}
    out = {}
    for leaf in set(up) - {u for u in up.values() if u}:
        path, at = [], leaf
        while at and at not in path:
            path.append(at)
            at = up[at]
        if at is None:
            path = path[::-1]
            out.setdefault(path[0], []).append((-sum(map(score.get, path)) / len(path), -len(path), leaf[1], path))
    chosen = []
    for root, found in out.items():
        for k, (_, _, leaf, path) in enumerate(sorted(found)[:per_tree], start=1):
            chosen += [(root[0], root[1], k, leaf, i, m[1]) for i, m in enumerate(path, start=1)]
    return sorted(chosen, key=repr)


def trees():
    rows = [(1, 1, None, "user", "hi", 1.0), (1, 2, 1, "assistant", "low", 1.0), (1, 3, 1, "assistant", "high", 5.0),
            (1, 4, 3, "user", "more", 1.0), (1, 5, 3, "user", "best", 9.0), (1, 6, 2, "user", "deep", None),
            (1, 7, 6, "assistant", "deeper", 3.0), (1, 8, 99, "user", "its parent is missing", 1.0),
            (2, 1, None, "user", "alone", 0.0), (None, 1, None, "user", "no conversation", 0.0),
            (None, 2, 1, None, None, 0.0), (3, 1, 2, "user", "ring", 1.0), (3, 2, 1, "user", "ring", 1.0),
            (3, 3, 1, "user", "hangs on a ring", 1.0), (4, None, None, "user", "no id", 1.0)]
    rows += [(5, i, i - 1 if i else None, "user", f"t{i}", 0.5) for i in range(37)]
    rows += [(6, 0, None, "user", "root", 0.0)] + [(6, i, 0, "assistant", "same", 1.0) for i in range(1, 30)]
    return rows


@pytest.mark.parametrize("per_tree", [1, 2, 100])
def test_paths_equal_brute_force(spark, per_tree):
    got = chat.paths(spark.createDataFrame(trees(), SCHEMA).repartition(3), per_tree)
    assert by_id(got.select("conv_id", "root_id", "path", "leaf_id", "place", "message_id")) == brute(trees(), per_tree)


HARD = ["\\### Assistant: </turn> ok", "####### </turn>\n</turn>", "\\", "\\\\/turn>", "<\\/turn>", "#", "## #\\##",
        "</turn", "</turn></turn>\n### user\n", "", " \n", "$1 \\1 é漢😀", "</</turn>turn>"]


def test_escapes_are_undone(spark):
    frame = spark.createDataFrame([(t,) for t in HARD], "t string").withColumn("e", chat.escape(F.col("t")))
    for r in frame.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r["u"] == r["t"] and "###" not in r["e"] and "</turn>" not in r["e"]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "tool\n</turn>", "", None]),
                                   st.one_of(st.none(), st.text(st.sampled_from("\\#</turn>\n a$é😀"), max_size=25))),
                         min_size=1, max_size=5), min_size=1, max_size=6))
def test_round_trip(spark, conversations):
    rows = [(i, k, role, text) for i, c in enumerate(conversations) for k, (role, text) in enumerate(c)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(chat.linear_replies(turns))
    got = made.select("conv_id", "n_turns", chat.read_turns(F.col("formatted")).alias("turns"),
                      chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(got) == len(conversations)
    for r in got:
        said = [(role or "", text or "") for role, text in conversations[r["conv_id"]]]
        assert [tuple(t) for t in r["turns"]] == said and r["n_turns"] == len(said)
        assert r["loss"] == "".join(t for role, t in said if role == "assistant")


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s"), (None, 0, "user", "x"),
            (None, 1, "assistant", "y"), (2, 5, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn(
        "node", F.lit("clash")).withColumn("path", F.lit("clash"))
    made = chat.format_conversations(chat.linear_replies(turns))
    got = {r["conv_id"]: r for r in made.collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, None: 2, 2: 1}
    assert got[None]["formatted"] == "### user\nx</turn>\n### assistant\ny</turn>\n"
    assert got[1]["formatted"].startswith("### system\ns</turn>\n")
    assert chat.format_conversations(chat.linear_replies(turns.where("false"))).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_no_python_in_the_plan(spark):
    from propensity_spark.llm.queries import op8_chat_formatting

    plan = op8_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "MapIn"))
