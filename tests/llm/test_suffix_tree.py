import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from propensity_spark.llm import suffix_tree
from propensity_spark.llm.suffix_tree import END, tokens


def corpus(seed=1, n=300):
    """Sentences of a second-order source, so that longer contexts say more than shorter ones."""
    rng, rows = random.Random(seed), []
    words = "a b c d e".split()
    for i in range(n):
        out = [rng.choice(words), rng.choice(words)]
        for _ in range(rng.randint(3, 40)):
            k = (ord(out[-1][0]) * 2 + ord(out[-2][0])) % 5
            out.append(words[k] if rng.random() < 0.8 else rng.choice([*words, f"rare{rng.randrange(40)}"]))
        rows.append((i, " ".join(out)))
    return rows


ALL = dict(frequent=1e-3, often=1e-3, entry=1e-4, least=2)


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    counts = suffix_tree.word_counts(docs)
    return docs, counts, suffix_tree.train(docs, counts, **ALL)


def brute(rows, tree, depth=3):
    """The kept contexts' distributions from plain counts of the texts, as a function of context and word."""
    grams = Counter()
    for _, text in rows:
        t = tokens(text.encode())
        for n in range(1, depth + 2):
            for i in range(len(t) - n + 1):
                grams[tuple(t[i:i + n])] += 1
    total = sum(v for k, v in grams.items() if len(k) == 1)
    kinds = sum(len(k) == 1 for k in grams)
    names = list(tree.words)
    room = len(names) + 1
    known = [{} for _ in tree.levels]  # context (furthest word first) -> (kept, entries)
    for d, level in enumerate(tree.levels):
        spelled = []
        for k in level.contexts.tolist():
            spelled.append((names[k],) if d == 0 else (names[k % room], *known[d - 1]["order"][k // room]))
        known[d]["order"] = spelled
        entries = {}
        for e in level.entries.tolist():
            entries.setdefault(spelled[e // len(names)], set()).add(names[e % len(names)])
        known[d]["kept"] = {s: entries.get(s, set()) for s, k in zip(spelled, level.kept.tolist()) if k}
    after = Counter()
    for k, v in grams.items():
        after[k[:-1]] += v

    def p(context, word):
        out = (grams[(word,)] + 0.5) / (total + 0.5 * (kinds + 1))
        for d in range(1, depth + 1):
            s = context[-d:]
            if len(context) >= d and s in known[d - 1]["kept"]:
                kept, n, mu = known[d - 1]["kept"][s], after[s], suffix_tree.MU
                if word in kept:
                    out = (grams[(*s, word)] + mu * out) / (n + mu)
                else:
                    short = {w: p(context[-d + 1:] if d > 1 else (), w) for w in kept}
                    left = 1 - sum((grams[(*s, w)] + mu * q) / (n + mu) for w, q in short.items())
                    out *= left / (1 - sum(short.values()))
        return out

    return p, grams, total, kinds


def test_scores_equal_the_definition(learned, spark):
    docs, counts, tree = learned
    p, grams, total, kinds = brute(corpus(), tree)
    assert tree.train_tokens == total and tree.vocabulary == kinds
    assert [int(x.kept.sum()) > 0 for x in tree.levels] == [True, True, False] or tree.levels[1].kept.sum() > 0
    new = corpus(9, 25) + [(900, ""), (901, None), (902, "unseen words only"), (903, "a b unseen A b")]
    got = suffix_tree.score(spark.createDataFrame(new, "doc_id long, text string"), tree, counts).collect()
    assert len(got) == len(new)
    texts = dict(new)
    for r in got:
        t = tokens((texts[r["doc_id"]] or "").encode())
        base = sum(math.log10((grams[(w,)] + 0.5) / (total + 0.5 * (kinds + 1))) for w in t)
        own = sum(math.log10(p(tuple(t[:i]), w)) for i, w in enumerate(t))
        assert r["n_tokens"] == len(t) and r["n_known"] == sum(grams[(w,)] > 0 for w in t)
        assert r["base_score"] == pytest.approx(base, abs=1e-8)
        assert r["score"] == pytest.approx(own, abs=1e-6)
    seen = [r for r in got if r["doc_id"] < 900]
    assert sum(r["score"] for r in seen) > 0.8 * sum(r["base_score"] for r in seen)


def test_every_state_is_a_distribution(learned):
    docs, _, tree = learned
    p, grams, total, kinds = brute(corpus(), tree)
    unknown = 0.5 / (total + 0.5 * (kinds + 1))
    for context in [(), (b"a",), (b"a", b"b"), (b"e", b"c", b"d"), (b"rare1",)]:
        words = [k[0] for k in grams if len(k) == 1]
        rest = p(context, b"never seen")
        assert rest / unknown > 0
        assert sum(p(context, w) for w in words) + rest == pytest.approx(1, abs=1e-9)


def test_contexts_without_news_are_not_retained(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=60))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tree = suffix_tree.train(docs, suffix_tree.word_counts(docs), **ALL)
    assert sum(int(x.kept.sum()) for x in tree.levels) <= 0.1 * sum(len(x.kept) for x in tree.levels)


def test_odd_rows(odd_docs, no_docs):
    counts = suffix_tree.word_counts(odd_docs)
    assert {bytes(r["word"]): r["c"] for r in counts.collect()}[END] == odd_docs.count()
    tree = suffix_tree.train(odd_docs, counts, least=2)
    got = suffix_tree.score(odd_docs, tree, counts)
    assert got.count() == odd_docs.count() and got.where(F.isnan("score") | F.col("score").isNull()).count() == 0
    assert got.where("n_tokens <> n_known").count() == 0
    assert suffix_tree.score(no_docs, tree, counts).count() == 0
    none = suffix_tree.word_counts(no_docs)
    empty = suffix_tree.train(no_docs, none)
    got = suffix_tree.score(odd_docs, empty, none)
    assert got.count() == odd_docs.count() and got.agg(F.sum("n_known")).first()[0] == 0
