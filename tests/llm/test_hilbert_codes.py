import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from propensity_spark.llm import hilbert_codes as hc


def brute(rows, parts=4, entries=256, rounds=4):
    """{row index: (code, error)} and the codebooks, in plain Python integers. rows: (id, vector)."""
    kept = [(i, k, [math.floor(1024 * x) for x in v]) for i, (k, v) in enumerate(rows)
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda t: (t[1] is None, t[1] or 0, t[2]))
    width = len(kept[0][2]) // parts if kept else 0
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for _, _, v in order[:entries]] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, _, v in kept:
                groups.setdefault(best(cut(v, p), book)[1], []).append(cut(v, p))
            for i, g in groups.items():
                book[i] = [sum(c) // len(g) for c in zip(*g)]
    found = {}
    for i, _, v in kept:
        near = [best(cut(v, p), books[p]) for p in range(parts)]
        found[i] = ("".join(f"{e:02x}" for _, e in near), min(hc.LARGEST, sum(d for d, _ in near)))
    return found, books


def encoded(spark, rows, **options):
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "at int, vec_id long, embedding array<float>")
    made = hc.encode(df, ["at"], **options)
    return {r["at"]: (r["code"], r["error"]) for r in made.vectors.collect()}, made


@pytest.mark.parametrize("bits,dims", [(4, 2), (2, 3), (1, 5), (3, 4)])
def test_curve_visits_neighbours(bits, dims):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = hc.hilbert_keys(points, bits)
    assert sorted(keys.tolist()) == list(range(len(points)))
    walk = points[np.argsort(keys)]
    assert (abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shortlist_loses_no_nearest_entry():
    rng = np.random.default_rng(1)
    for _ in range(50):
        entries = rng.integers(-50, 50, (30, 3))
        box = rng.integers(-30, 30, 3) + rng.integers(-4, 5, (20, 3))
        few = hc.shortlist(box.min(axis=0), box.max(axis=0), entries)
        code, _ = hc.nearest(box, entries)
        assert set(code.tolist()) <= set(few.tolist())


def test_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 8))
    rows = [(int(k), (centres[k % 12] + 0.1 * rng.normal(size=8)).tolist()) for k in rng.permutation(400)]
    got, made = encoded(spark, rows, entries=32)
    want, books = brute(_single(rows), entries=32)
    assert got == want and made.codebooks == books
    flat = ",".join(str(x) for p in books for e in p for x in e)
    assert made.digest() == hashlib.sha256(flat.encode()).hexdigest()


def _single(rows):
    """The vectors as single precision holds them."""
    return [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows]


def test_odd_vectors(spark):
    """NULL vectors and components, infinities, NULL and repeated ids, equal vectors, ties, very large components."""
    rows = [(None, [1.0, 2.0, 3.0, 4.0]), (5, None), (6, [1.0, None, 3.0, 4.0]), (7, [math.inf, 0.0, 0.0, 0.0]),
            (8, [math.nan, 0.0, 0.0, 0.0]), (1, [0.0, 0.0, 0.0, 0.0]), (1, [0.5, -0.5, 0.0, 0.0]),
            (2, [0.5, -0.5, 0.0, 0.0]), (2, [0.5, -0.5, 0.0, 0.0]), (3, [-0.0001, 0.25, 1.0, 2.0]),
            (4, [3e6, -3e6, 1e6, 7.0]), (9, [2e6, -3e6, 1e6, 7.0]), (10, [0.25, -0.25, 0.5, 1.0])]
    for entries in (2, 3, 256):
        got, made = encoded(spark, rows, entries=entries)
        want, books = brute(_single(rows), entries=entries)
        assert got == want and made.codebooks == books


def test_no_vectors_and_bad_lengths(spark):
    got, made = encoded(spark, [(1, None), (2, [None])])
    assert got == {} and made.codebooks == [[], [], [], []]
    got, made = encoded(spark, [(1, []), (2, [])])
    assert got == {0: ("00000000", 0), 1: ("00000000", 0)}
    for rows in ([(1, [1.0, 2.0, 3.0])], [(1, [1.0] * 4), (2, [1.0] * 8)]):
        with pytest.raises(ValueError):
            encoded(spark, rows)


def test_clashing_columns_and_group_errors(spark):
    rows = [(1, [0.0] * 4, None), (2, [1.0] * 4, None), (3, [2.0] * 4, 7), (4, [9.0] * 4, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for name in ("row", "v", "id", "part", "code", "error", "x", "key"):
        df = df.withColumn(name, F.lit("clash"))
    made = hc.encode(df, [c for c in df.columns if c not in ("code", "error")], entries=2, rounds=0).vectors
    out = hc.group_errors(made, "label").orderBy("vec_id").collect()
    assert [r["row"] for r in out] == ["clash"] * 4
    error = [r["error"] for r in out]
    assert error == [0, 0, 4 * 1024 ** 2, 4 * (8 * 1024) ** 2]
    assert [r["label_error"] for r in out] == [0, 0, sum(error[2:]), sum(error[2:])]
