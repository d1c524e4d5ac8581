import math
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from propensity_spark.llm import shared_search as ss
from propensity_spark.llm.decontaminate import words


def brute(docs, items, top=10):
    """Rows (item, rank, doc, score) in plain Python. docs and items: (id, text)."""
    texts = [(d, words((t or "").encode())) for d, t in docs]
    having = [Counter(w) for _, w in texts]
    n_docs, total = sum(bool(w) for _, w in texts), sum(len(w) for _, w in texts)
    df = Counter(t for h in having for t in h)
    out = []
    for item, text in items:
        found = []
        for (doc, w), tf in zip(texts, having):
            if w:
                m = 25 + 75 * len(w) * n_docs // total
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                            * (1000000000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in words((text or "").encode()) if tf[t])
                if score > 0:
                    found.append((-score, doc is None, doc or 0, doc))
        out += [(item, i, f[3], -f[0]) for i, f in enumerate(sorted(found, key=lambda f: f[:3])[:top], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@given(st.lists(st.lists(st.sampled_from("abcdefghij"), max_size=12), max_size=8))
@settings(max_examples=200, deadline=None)
def test_dag_adds_up(items):
    """Every item's score is the sum over its terms, repeats included, whatever is shared."""
    named = [(str(i), [t.encode() for t in item]) for i, item in enumerate(items)]
    dag = ss.mine(named)
    assert dag.items == [name for name, terms in named if terms]
    if not dag.items:
        return
    table = np.random.default_rng(0).integers(0, 1000, (len(dag.words), 5))
    got = dag.scores(table)
    at = {t: i for i, t in enumerate(dag.words)}
    for row, (_, terms) in zip(got, [x for x in named if x[1]]):
        assert row.tolist() == table[[at[t] for t in terms]].sum(axis=0).tolist()


def test_shared_sets_are_summed_once():
    """Fifty items of twenty common terms and one own: 19 additions for the common set and one per item."""
    common = [b"c%d" % i for i in range(20)]
    dag = ss.mine([(str(i), [*common, b"own%d" % i]) for i in range(50)])
    assert dag.additions() == 19 + 50
    halves = ss.mine([("a", common), ("b", common[:10] + [b"x"]), ("c", common[10:] + [b"x"]), ("d", common + [b"x"])])
    assert halves.additions() < sum(map(len, ([0] * 19, [0] * 10, [0] * 10, [0] * 20)))


def test_equals_brute_force_in_one_and_many_blocks(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    pick = lambda n: " ".join(rng.choice(vocabulary, n, p=_zipf(60)))
    docs = [(i, pick(int(rng.integers(0, 40)))) for i in range(300)] + [(400 + i, "w1 w2 w3") for i in range(30)]
    items = [(i, pick(int(rng.integers(0, 15)))) for i in range(25)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert rows(ss.search(d, q)) == want
    assert rows(ss.search(d, q, block_bytes=200, pass_bytes=2000)) == want
    assert rows(ss.search(d, q, top=3)) == brute(docs, items, 3)


def _zipf(n):
    p = 1 / np.arange(1, n + 1)
    return p / p.sum()


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    items = [(1, "One two, three"), (1, "word id"), (None, "the quick FOX"), (2, None), (3, ""), (4, "one"), (5, "one"),
             (6, "nowhere else"), (7, "Élan ß " * 3), (8, "one " * 2000 + "word")]
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    q = q.withColumn("score", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = ss.search(odd_docs, q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(got) == brute(docs, items)
    assert rows(ss.search(no_docs, q)) == [] and rows(ss.search(odd_docs, q.where("false"))) == []
    same = ss.search(odd_docs.withColumnRenamed("doc_id", "id"), q.withColumnRenamed("item_id", "id"), doc_id="id", item_id="id")
    assert same.columns == ["id", "rank", "_id", "score"]


def test_a_very_long_text_and_ties_between_copies(spark):
    docs = [(1, "a b " * 200000 + "c")] + [(10 + i, "c d") for i in range(40)] + [(None, "c d"), (10, "c d")]
    items = [(1, "c"), (2, "a c d")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(ss.search(d, spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)
