import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from propensity_spark.llm import substrings as sub

ROW = "doc_id long, text string"


def brute(docs, window):
    """Rows (doc_id, n_words, removed words, kept) in plain Python; docs have unique ids or are equal rows."""
    texts = [(d is None, d or 0, (t or "").encode().split()) for d, t in docs]
    first = {}
    for none, d, w in texts:
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            first[key] = min(first.get(key, (none, d, i)), (none, d, i))
    out = []
    for (none, d, w), (doc, _) in zip(texts, docs):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < (none, d, i):
                gone |= set(range(i, i + window))
        out.append((doc, len(w), sorted(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def removed(df):
    return sorted(((r["doc_id"], r["n_words"], [i for a, b in r["removed"] for i in range(a, b)], r["kept"])
                   for r in df.select("doc_id", "n_words", "removed", "kept").collect()), key=repr)


@given(st.lists(st.lists(st.integers(0, 2), max_size=14), max_size=6), st.integers(1, 5))
@settings(max_examples=400, deadline=None)
def test_first_windows(spans, window):
    seen, want = set(), []
    for s in spans:
        new = []
        for i in range(len(s) - window + 1):
            key = tuple(s[i:i + window])
            new.append(key not in seen)
            seen.add(key)
        want.append(new)
    assert [x.tolist() for x in sub.first_windows(spans, window)] == want


@given(st.lists(st.lists(st.integers(0, 3), max_size=30), max_size=5))
@settings(max_examples=300, deadline=None)
def test_equal_windows_share_an_anchor_that_is_counted_at_their_places(texts):
    window = 4
    made = sub.Anchors([b" \t".join(b"w%d" % s * (s + 1) for s in t) + b" " for t in texts], window)
    owner, values = made.places()
    assert made.first.tolist() == np.cumsum([0, *map(len, texts)]).tolist()
    n = dict(zip(*np.unique(values, return_counts=True)))
    anchors, places = {}, {}
    for i, (a, inside) in enumerate(zip(made.least.view(np.int64).tolist(), made.inside.tolist())):
        text = int(made.owner[i])
        words = tuple(texts[text][i - int(made.first[text]):][:window])
        assert inside == (len(words) == window)
        if inside:
            anchors.setdefault(words, set()).add(a)
            places[words] = places.get(words, 0) + 1
    for words, found in anchors.items():
        assert len(found) == 1 and n[found.copy().pop()] >= min(2, places[words])


def test_an_anchor_does_not_depend_on_the_other_texts():
    text = b"one two  three four five six seven eight nine ten eleven twelve"
    alone = sub.Anchors([text], 5).least
    for before, after in ((b"x", b""), (b"", b"some more words"), (b"a b " * 1000, b"z")):
        made = sub.Anchors([before, text, after], 5)
        first = int(made.first[1])
        assert made.least[first:first + len(alone)].tolist() == alone.tolist()


def test_spans_are_the_runs_of_known_anchors():
    texts = [b"a b c d e f g h", b"", b"c d e f x y", b"q"]
    made = sub.Anchors(texts, 3)
    known = np.unique(made.least.view(np.int64)[made.inside])
    assert made.spans(known, known, 1) == [[(0, 6, 0)], [], [(0, 4, 0)], []]
    assert made.spans(known[:0], known[:0], 1) == [[], [], [], []]


def make_docs():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: rng.choice(words, n).tolist()
    common, line, long = text(90), text(23), text(400)
    docs = []
    for i in range(120):
        body = text(int(rng.integers(0, 120)))
        if i % 3 == 0:
            body += common
        if i % 4 == 0:
            body = body[:30] + line + body[30:]
        if i % 5 == 0:
            near = list(long)
            for at in rng.integers(0, 400, 3):
                near[at] = f"edit{i}"
            body = near
        if i % 7 == 0:
            body += body[5:60]
        if i % 11 == 0:
            body += ["same"] * 50
        docs.append((i * 7 % 120, " ".join(body)))
    return docs + [(200 + i, " ".join(long)) for i in range(10)]


def test_equals_brute_force(spark):
    docs = make_docs()
    df = spark.createDataFrame(docs, ROW).repartition(6)
    want = brute(docs, 20)
    assert removed(sub.remove_repeats(df, ["doc_id"])) == want
    assert removed(sub.remove_repeats(df, ["doc_id"], shard_words=300)) == want  # many automata in a shard
    assert removed(sub.remove_repeats(df, ["doc_id"], window=5)) == brute(docs, 5)


def test_spans_are_cut(spark, monkeypatch):
    docs = [(1, " ".join(f"x{i}" for i in range(300))), (2, " ".join(f"x{i}" for i in range(10, 290)))]
    monkeypatch.setattr(sub, "SPAN", 16)
    assert removed(sub.remove_repeats(spark.createDataFrame(docs, ROW), ["doc_id"])) == brute(docs, 20)


def test_odd_documents(spark, odd_docs, no_docs):
    got = sub.remove_repeats(odd_docs, odd_docs.columns, window=3, names=("n", "gone", "rest"))
    assert got.columns == odd_docs.columns + ["n", "gone", "rest"]
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    plain = got.select("doc_id", F.col("n").alias("n_words"), F.col("gone").alias("removed"), F.col("rest").alias("kept"))
    assert removed(plain) == brute(rows, 3)
    assert sub.remove_repeats(no_docs, ["doc_id"]).count() == 0


def test_equal_rows_are_one_document_and_null_ids_come_last(spark):
    text = " ".join(f"x{i}" for i in range(30))
    docs = [(None, text), (5, text), (5, text), (9, "before " + text)]
    got = removed(sub.remove_repeats(spark.createDataFrame(docs, ROW), ["doc_id"]))
    assert got == brute(docs, 20)
    assert [r for r in got if r[0] == 5] == [(5, 30, [], text)] * 2
    assert [r[2] for r in got if r[0] is None] == [list(range(30))]
    strings = spark.createDataFrame([("b", text), ("a", text)], "doc_id string, text string")
    assert {r[0]: len(r[2]) for r in removed(sub.remove_repeats(strings, ["doc_id"]))} == {"a": 0, "b": 30}


def test_a_very_long_text(spark):
    docs = [(1, " ".join(f"x{i}" for i in range(100000))), (2, " ".join(f"x{i}" for i in range(50, 60000)))]
    got = removed(sub.remove_repeats(spark.createDataFrame(docs, ROW), ["doc_id"]))
    assert got[0][2] == [] and got[1][2] == list(range(59950)) and got[1][3] == ""
