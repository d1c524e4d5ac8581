import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from propensity_spark.llm import simhash
from propensity_spark.llm.common import stored
from propensity_spark.llm.components import components
from tests.llm.conftest import TEXTS, by_id


def brute_print(text, k=4):
    """Bit by bit, from the definition."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def brute_groups(edges, nodes):
    up = {n: n for n in nodes}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near(fps, distance):
    x = np.array(fps, np.int64).astype(np.uint64)
    return [(fps[i], fps[int(j) + i + 1]) for i in range(len(x))
            for j in np.flatnonzero(np.bitwise_count(x[i + 1:] ^ x[i]) <= distance)]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == brute_print(text)


def test_long_text_is_hashed_whole():
    rng = random.Random(3)
    text = " ".join(rng.choices(["ab", "C", "é", "d,"], k=2 * simhash.CHUNK + 77))
    assert simhash.fingerprint(text.encode()) == brute_print(text)


@pytest.mark.parametrize("distance,count", [(4, 3), (4, 2), (4, 5), (3, 4), (6, 3), (0, 1)])
def test_segments_leave_no_pair_out(distance, count):
    parts = simhash.segments(distance, count)
    rng = random.Random(1)
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), distance))
        assert any((flips >> s & ((1 << w) - 1)).bit_count() <= r for s, w, r in parts)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_brute_force(spark, seed):
    """Chains, dense groups and strangers; the dense group is far larger than the representatives of a slot."""
    rng = random.Random(seed)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    fps = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(3):
        centre = rng.getrandbits(64)
        fps |= {flip(centre, rng.randint(0, 4)) for _ in range(150)}
        chain = rng.getrandbits(64)
        for _ in range(12):
            chain = flip(chain, rng.choice([3, 4, 4, 5]))
            fps.add(chain)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    got = simhash.link(spark.createDataFrame([(x,) for x in fps], "fp long"))
    assert {r["node"]: r["component"] for r in got.collect()} == brute_groups(near(fps, 4), fps)


def test_a_large_group_costs_its_size_times_the_strangers(spark):
    """Groups around one centre with three strangers in the centre's slots: candidates grow with the group, not its
    square, and every link is still found."""
    rng = random.Random(4)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    centre, parts, rows = rng.getrandbits(64), simhash.segments(4, 3), []
    strangers = [centre ^ (rng.getrandbits(64 - w - s if s + w < 64 else s) << (s + w if s + w < 64 else 0))
                 for s, w, _ in parts]
    for n in (500, 1000, 2000):
        group = set()
        while len(group) < n:
            group.add(signed(flip(centre, rng.randint(0, 4))))
        fps = sorted(group | set(map(signed, strangers)))
        known = [(x, min(group) if x in group else x) for x in fps]
        made = simhash.candidates(spark.createDataFrame(known, "fp long, group long"), parts)
        rows.append(made.count())
        assert rows[-1] < 200 * n
    assert rows[2] < 3 * rows[1] < 9 * rows[0]


def test_what_explode_made_is_not_broadcast(spark, monkeypatch):
    """A fingerprint has 46 entries to look up, but Spark takes them for as small as the table of fingerprints."""
    plans = []

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(simhash, "stored", noted)
    monkeypatch.setattr(simhash, "components", lambda df, *names: noted(components(noted(df, "links"), *names), "joined"))
    simhash.link(spark.range(50).select(F.xxhash64("id").alias("fp")))
    exploded = [p for p in plans if "Generate explode" in p]
    assert len(exploded) >= 3 and not [p for p in exploded if "BroadcastExchange" in p]


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    rows = odd_docs.collect()
    assert sorted((r["doc_id"], r["fingerprint"]) for r in got if r["doc_id"] is not None) == sorted(
        (r["doc_id"], brute_print(r["text"])) for r in rows if r["doc_id"] is not None)
    fps = sorted({brute_print(r["text"]) for r in rows})
    groups = brute_groups(near(fps, 4), fps)
    least = {}
    for r in rows:
        if r["doc_id"] is not None:
            g = groups[brute_print(r["text"])]
            least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == least.get(groups[r["fingerprint"]]) for r in got)
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(25)] + [(100 + i, 101 + i) for i in range(30)]
    edges += [(500, 600 + i) for i in range(50)] + [(7, 7), (None, 3), (3, None), (2, 1), (2, 1)]
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert by_id(got) == sorted(brute_groups(real, {x for e in real for x in e}).items(), key=repr)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
