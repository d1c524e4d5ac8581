import pickle

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from propensity_spark.llm import cover_tree
from tests.llm.conftest import by_id


def brute(rows, cosine):
    """(vec_id, links, component, kept) from all pairs."""
    ok = [i for i, (_, x) in enumerate(rows) if x is not None and None not in x and np.isfinite(x).all() and np.any(x)]
    near = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if i != j and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                near[i].add(j)
    out = []
    for i, (v, _) in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - reach
            reach |= new
            todo += new
        least = min((rows[j][0] for j in reach if rows[j][0] is not None), default=None)
        out.append((v, len(near[i]), least, v == least))
    return sorted(out, key=repr)


def vectors(seed, n=160, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    x = centres[rng.integers(0, 8, n)] + rng.normal(scale=rng.choice([0.0, 0.1, 0.3, 2.0], size=(n, 1)), size=(n, dim))
    return [(i, r) for i, r in enumerate(x.astype(np.float32).astype(float).tolist())]


@pytest.mark.parametrize("seed,cells,block", [(1, 4, 1000), (2, 16, 30), (3, 3, 12), (4, 1, 40)])
def test_equals_brute_force(spark, seed, cells, block):
    rows = vectors(seed)
    got = cover_tree.similar(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cosine=0.95,
                             cells=cells, block=block)
    assert by_id(got) == brute(rows, 0.95)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None),
            (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [1.0]), (10, [1.0, 0.0, 0.0]),
            (None, [1.0, 0.0]), (11, [None, 1.0]), (12, [-1.0, 0.0]), (13, [1e300, 0.0]), (14, [1e-200, 1e-210])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("value", F.lit(1))
    frame = frame.withColumn("n", F.lit(2)).withColumn("component", F.lit("x"))
    got = by_id(cover_tree.similar(frame))
    rows = [(v, None if x == [] else [1.0, 0.0] if v in (13, 14) else x) for v, x in rows]
    assert got == brute(rows, 0.95)
    none = cover_tree.similar(frame.where("false"))
    assert none.count() == 0 and none.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_a_vector_without_id_links_others(spark):
    """1 and 3 are linked through the one between them only."""
    turn = lambda a: [float(np.cos(a)), float(np.sin(a))]
    rows = [(1, turn(0.0)), (None, turn(0.25)), (3, turn(0.5)), (None, turn(2.0)), (None, turn(2.1))]
    got = by_id(cover_tree.similar(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got == brute(rows, 0.95)
    assert (3, 1, 1, False) in got and (None, 2, 1, False) in got and got.count((None, 1, None, True)) == 2


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(2, 5))
def test_trees_are_nested_and_cover(seed, n, dim):
    rng = np.random.default_rng(seed)
    x = cover_tree.unit(rng.normal(size=(n, dim)) * rng.choice([0.05, 1], size=(n, 1)) + np.eye(dim)[0])
    tree, order = cover_tree.build(x)
    assert sorted(order.tolist()) == list(range(n)) and np.allclose(tree.x, x[order])
    for radius, level, finer in zip(cover_tree.RADII, tree.levels, [*tree.levels[1:], None]):
        for c, r, s, e in zip(level.centre, level.radius, level.start, level.stop):
            far = np.linalg.norm(tree.x[s:e] - c, axis=1).max()
            assert far <= r + 1e-7 and r <= radius + 1e-3
        assert finer is None or set(level.start) <= set(finer.start)


def test_far_nodes_are_cut_off():
    rng = np.random.default_rng(2)
    x = cover_tree.unit(rng.normal(size=(400, 64)))
    tree, _ = cover_tree.build(x)
    rows, cols = cover_tree.top_pairs(tree.levels[0], tree.levels[0], cover_tree.chord(0.95))
    assert len(rows) < 0.02 * len(tree.levels[0].centre) ** 2


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 40))
def test_shadows_are_never_further_apart(seed, dim):
    rng = np.random.default_rng(seed)
    x = cover_tree.unit(rng.normal(size=(50, dim)) * rng.choice([0.05, 1], size=(50, 1)) + np.eye(dim)[0])
    low = cover_tree.shadows(x, cover_tree.leading(x[:20]))
    assert low.shape[1] <= cover_tree.LEADING + 1 and (low @ low.T >= x @ x.T - cover_tree.SLACK).all()


@pytest.mark.parametrize("near", [0.0, 0.02, 0.06])
def test_vectors_without_structure_are_not_traversed(monkeypatch, near):
    """Few and many links among random vectors, over a block and itself and over two blocks."""
    rng = np.random.default_rng(5)
    x = cover_tree.unit(rng.normal(size=(700, 64)))
    x[500:] = cover_tree.unit(x[500:600].repeat(2, axis=0) + rng.normal(scale=near, size=(200, 64)))
    x[600:] = x[0] if near == 0.02 else x[600:]
    weights = rng.integers(1, 4, 700)
    parts = [np.arange(0, 700, 2), np.arange(1, 700, 2)]
    trees = [cover_tree.build(x[p], cover_tree.leading(x)) for p in parts]
    monkeypatch.setattr(cover_tree, "near_nodes", lambda *args: pytest.fail("node pairs are looked at one by one"))
    for one, two in ((0, 1), (1, 1)):
        (a, rows), (b, cols) = trees[one], trees[two]
        wa, wb = weights[parts[one]][rows], weights[parts[two]][cols]
        hit = a.x @ b.x.T >= 0.95
        if one == two:
            np.fill_diagonal(hit, False)
        na, nb, edges = cover_tree.links(a, b, wa, wb, 0.95, one == two)
        assert (na == hit @ wb).all() and (one == two or (nb == wa @ hit).all())
        shift = 0 if one == two else len(a.x)
        n = shift + len(b.x)
        every = np.zeros((n, n), bool)
        every[:len(a.x), shift:] = hit
        assert all((every | every.T)[i, j] for i, j in edges)
        forest = cover_tree._Forest(n)
        for i, j in np.argwhere(every):
            forest.join(i, np.array([j]))
        assert len(edges) == len(forest.edges)
    again = pickle.loads(pickle.dumps(trees[0][0]))
    assert all((m.centre == n.centre).all() for m, n in zip(again.levels, trees[0][0].levels))
