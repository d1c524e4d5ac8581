"""Exact near-duplicates of vectors by cosine: cover trees traversed in pairs."""

from __future__ import annotations

import functools
import math
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from propensity_spark.functions.session import scratch_path
from propensity_spark.llm.common import stored
from propensity_spark.llm.components import components

#: Cells: at most so many centres of the upper levels are found, in a sample of at most SAMPLE vectors.
CELLS, SAMPLE = 256, 4096
#: Vectors in a block, for which one tree is built.
BLOCK = 4096
#: Block pairs that one task traverses.
PAIRS = 8
#: Directions of the widest spread, in which vectors are compared first where a tree has no structure.
LEADING = 16
#: Radii of the levels inside a block; below the last one, the vectors themselves.
RADII = (1.0, 0.5, 0.25)
#: Allows for rounding where a bound is taken in single precision.
SLACK = 1e-4


def chord(cosine: float) -> float:
    """Distance of two unit vectors with this cosine."""
    return math.sqrt(max(0.0, 2 - 2 * cosine))


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def nested(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres (rows of x) more than `radius` apart, and the centre of every row, within it. First rows lead."""
    owner = np.full(len(x), -1)
    centres = []
    least = 1 - radius * radius / 2
    for i in range(len(x)):
        if owner[i] < 0:
            free = np.flatnonzero(owner < 0)
            owner[free[x[free] @ x[i] >= least]] = len(centres)
            owner[i] = len(centres)
            centres.append(i)
    return np.array(centres, int), owner


@dataclass
class Node:
    """One level of a tree: centres, covering radii and, in `order` from start to stop, the members below each."""

    centre: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    stop: np.ndarray


@dataclass
class Tree:
    x: np.ndarray  # unit vectors in tree order: the members of every node lie together
    levels: list[Node]
    low: np.ndarray  # shadows of x, see shadows()

    def __getstate__(self) -> tuple:
        """Without the centres, which are rows of x."""
        return self.x, [(n.radius, n.start, n.stop) for n in self.levels], self.low

    def __setstate__(self, state: tuple) -> None:
        self.x, levels, self.low = state
        self.levels = [Node(self.x[start], radius, start, stop) for radius, start, stop in levels]

    def flat(self) -> bool:
        """Whether the first level has nearly every vector as a centre, so that the levels cut off little."""
        return 2 * len(self.levels[0].centre) > len(self.x)


def leading(sample: np.ndarray) -> np.ndarray:
    """At most LEADING orthonormal directions (columns) in which unit vectors like these spread most."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, :LEADING]


def shadows(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The coordinates of unit vectors along the basis, and the length of the rest as one more.

    The rests of two vectors have at most the product of their lengths as dot product, so the dot product of two
    shadows is never less than that of the vectors.
    """
    p = x @ basis
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", p, p)))
    return np.column_stack([p, rest]).astype(np.float32)


def build(x: np.ndarray, basis: np.ndarray | None = None) -> tuple[Tree, np.ndarray]:
    """Cover tree of unit vectors, and the order in which it holds them.

    The centres of a level are spread by more than its radius and each is a member of its own node, so the centres of
    a level are among those of the next. Radii halve; the covering radius kept is the true one.
    """
    owners, order = [], np.arange(len(x))
    groups = [order]
    for radius in RADII:
        split, owner, n = [], np.empty(len(x), int), 0
        for group in groups:
            centres, own = nested(x[group].astype(np.float32), radius) if len(group) > 1 else (None, np.zeros(1, int))
            owner[group] = own + n
            split += [group[own == c] for c in range(own.max() + 1)] if len(group) > 1 else [group]
            n += int(own.max()) + 1
        owners.append(owner)
        groups = split
    order = np.concatenate(groups) if groups else order
    y = x[order]
    levels = []
    for owner in owners:
        starts = np.flatnonzero(np.append(True, np.diff(owner[order]) != 0))
        stops = np.append(starts[1:], len(y))
        centre = y[starts]
        dist = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", y, np.repeat(centre, stops - starts, axis=0))))
        levels.append(Node(centre, np.maximum.reduceat(dist, starts) if len(y) else dist, starts, stops))
    return Tree(y, levels, shadows(y, np.eye(x.shape[1])[:, :LEADING] if basis is None else basis)), order


def near_nodes(a: Node, b: Node, rows: np.ndarray, cols: np.ndarray, reach: float) -> np.ndarray:
    """Which of the node pairs (rows[i], cols[i]) can hold a pair within reach."""
    keep = np.zeros(len(rows), bool)
    for i in range(0, len(rows), 1 << 17):
        r, c = rows[i:i + (1 << 17)], cols[i:i + (1 << 17)]
        dist = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", a.centre[r], b.centre[c])))
        keep[i:i + (1 << 17)] = dist <= reach + a.radius[r] + b.radius[c] + SLACK
    return keep


def top_pairs(a: Node, b: Node, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Node pairs of the first level that can hold a pair within reach; b is taken by classes of its radii."""
    rows, cols = [np.zeros(0, int)], [np.zeros(0, int)]
    for low, high in zip((-1.0, 0.0, 0.2, 0.4, 0.6), (0.0, 0.2, 0.4, 0.6, np.inf)):
        some = np.flatnonzero((b.radius > low) & (b.radius <= high))
        if not len(some):
            continue
        right, widest = b.centre[some].astype(np.float32).T, float(b.radius[some].max())
        for i in range(0, len(a.centre), 512):
            bound = np.minimum(reach + a.radius[i:i + 512] + widest + SLACK, 2)
            least = (1 - bound * bound / 2 - SLACK).astype(np.float32)
            r, c = np.nonzero(a.centre[i:i + 512].astype(np.float32) @ right >= least[:, None])
            ok = near_nodes(a, b, r + i, some[c], reach)
            rows.append(r[ok] + i)
            cols.append(some[c[ok]])
    return np.concatenate(rows), np.concatenate(cols)


def children(parent: Node, child: Node) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 child of every node."""
    return np.searchsorted(child.start, parent.start), np.searchsorted(child.start, parent.stop)


def links(a: Tree, b: Tree, wa: np.ndarray, wb: np.ndarray, cosine: float, same: bool):
    """Traverse both trees from the top: (links of each row of a, of b, pairs that connect what is linked).

    A node pair whose centres lie further apart than the reach and both covering radii is cut off with all below; the
    vectors below the rest are compared in double precision. Rows of b are counted behind those of a in the pairs. A
    linked row counts as many times as its weight says. With `same`, a is b. Two trees without structure, in which
    every node pair would be looked at, are compared by their vectors' shadows instead.
    """
    if a.flat() and b.flat():
        return flat_links(a, b, wa, wb, cosine, same)
    reach = chord(cosine)
    na, nb = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    shift = 0 if same else len(a.x)
    forest = _Forest(shift + len(b.x))
    rows, cols = top_pairs(a.levels[0], b.levels[0], reach)
    for level in range(1, len(RADII) + 1):
        if same:
            half = rows <= cols
            rows, cols = rows[half], cols[half]
        if level == len(RADII):
            break
        (fa, la), (fb, lb) = (children(t.levels[level - 1], t.levels[level]) for t in (a, b))
        wide, high = (la - fa)[rows], (lb - fb)[cols]
        pair = np.repeat(np.arange(len(rows)), wide * high)
        within = np.arange(len(pair)) - np.repeat(np.cumsum(wide * high) - wide * high, wide * high)
        r, c = fa[rows[pair]] + within // high[pair], fb[cols[pair]] + within % high[pair]
        ok = near_nodes(a.levels[level], b.levels[level], r, c, reach)
        rows, cols = r[ok], c[ok]
    last_a, last_b = a.levels[-1], b.levels[-1]
    for r, c in zip(rows.tolist(), cols.tolist()):
        s, e, s2, e2 = last_a.start[r], last_a.stop[r], last_b.start[c], last_b.stop[c]
        for at in range(s, e, 512):
            stop = min(e, at + 512)
            hit = a.x[at:stop] @ b.x[s2:e2].T >= cosine
            if same and r == c:
                hit &= np.arange(at, stop)[:, None] != np.arange(s2, e2)
            else:
                nb[s2:e2] += (wa[at:stop].astype(float) @ hit).astype(np.int64)
            na[at:stop] += (hit @ wb[s2:e2].astype(float)).astype(np.int64)
            for i in np.flatnonzero(hit.any(1)).tolist():
                forest.join(at + i, np.flatnonzero(hit[i]) + s2 + shift)
    return (na + nb if same else na), nb, forest.pairs()


def _places(found: np.ndarray) -> np.ndarray:
    """np.flatnonzero() of a table of booleans with few True, read eight at a time."""
    flat = found.reshape(-1)
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    at = (words[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.concatenate([at[flat[at]], np.flatnonzero(flat[whole:]) + whole])


def flat_links(a: Tree, b: Tree, wa: np.ndarray, wb: np.ndarray, cosine: float, same: bool):
    """links() without the levels: pairs whose shadows are near enough are compared in double precision."""
    na, nb = np.zeros(len(a.x)), np.zeros(len(b.x))  # whole numbers
    shift = 0 if same else len(a.x)
    forest = _Forest(shift + len(b.x))
    for at in range(0, len(a.x), 256):
        stop, first = min(len(a.x), at + 256), at if same else 0
        near = a.low[at:stop] @ b.low[first:].T >= np.float32(cosine - SLACK)
        hits = _places(near)
        dense = 16 * len(hits) > near.size
        if dense:
            hits = np.flatnonzero(a.x[at:stop] @ b.x[first:].T >= cosine)
        r, c = np.divmod(hits, near.shape[1])
        r, c = r + at, c + first
        if same:
            r, c = r[r < c], c[r < c]
        if not dense:
            ok = [np.einsum("ij,ij->i", a.x[r[i:i + 4096]], b.x[c[i:i + 4096]]) >= cosine for i in range(0, len(r), 4096)]
            ok = np.concatenate([np.zeros(0, bool), *ok])
            r, c = r[ok], c[ok]
        na += np.bincount(r, wb[c], len(na))
        nb += np.bincount(c, wa[r], len(nb))
        rows, starts = np.unique(r, return_index=True)
        for i, to in zip(rows.tolist(), np.split(c + shift, starts[1:])):
            forest.join(i, to)
    na, nb = na.astype(np.int64), nb.astype(np.int64)
    return (na + nb if same else na), nb, forest.pairs()


class _Forest:
    """Spanning pairs of what has been joined; every member's set is known by its label."""

    def __init__(self, n: int):
        self.label, self.edges = np.arange(n), []

    def join(self, i: int, to: np.ndarray) -> None:
        """Join i with all of `to`."""
        label = self.label
        while len(to := to[label[to] != label[i]]):
            self.edges.append((i, int(to[0])))
            label[label == label[to[0]]] = label[i]

    def pairs(self) -> np.ndarray:
        return np.array(self.edges, np.int64).reshape(-1, 2)


def assign(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each unit vector, and the distance."""
    dot = x @ centres.T
    cell = dot.argmax(1)
    return cell, np.sqrt(np.maximum(0, 2 - 2 * dot[np.arange(len(x)), cell]))


def upper_levels(sample: np.ndarray, cells: int) -> np.ndarray:
    """At most `cells` centres: the first of the widest level that has so many."""
    for radius in (2.0, *RADII):
        centres, _ = nested(sample, radius)
        if len(centres) >= cells:
            break
    return sample[centres[:cells]]


def _vectors(column: pa.Array) -> np.ndarray:
    return unit(np.array(column.to_pylist(), float).reshape(len(column), -1))


VECTOR = StructType([
    StructField("node", LongType()), StructField("weight", LongType()), StructField("cell", LongType()),
    StructField("dist", DoubleType()), StructField("x", BinaryType())])
BLOCKS = StructType([StructField("block", LongType()), StructField("cell", LongType()), StructField("file", StringType())])
FOUND = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("n", LongType())])


def similar(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.95,
            cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors with at least this cosine), component_id, kept.

    Equal vectors are combined and counted first. The upper levels of the cover tree are centres found in a sample of
    at most SAMPLE vectors; every vector goes to the nearest, which gives cells with true covering radii. A cell is
    cut into blocks of about `block` vectors, and each block's lower levels are built once and written to the shared
    folder. Block pairs whose cells may hold a linked pair are then traversed, each reading its two trees; where the
    vectors have no structure, they are compared by a few leading coordinates and the length of the rest first. Per pair
    only counts and a spanning set of links come out, however many vectors are alike. The result is exact: the sample
    decides how much is cut off, not what is found. Vectors that are NULL, zero or hold NULL or non-finite numbers
    have no links and are their own component; vectors of different lengths never link; repeated ids keep their rows,
    and component_id is the least vec_id reachable, itself included. Rows without vec_id count and link like any
    other; a component that has no id at all has none as component_id, and its rows are kept.
    """
    spark = vectors.sparkSession
    value = F.col(embedding).cast("array<double>")
    bad = F.exists(value, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    zero = F.forall(value, lambda v: v == 0)
    usable = F.when(F.coalesce(~bad & ~zero, F.lit(False)), value)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), usable.alias("value"))
    distinct = rows.where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("weight"))
    distinct = stored(distinct.select(F.monotonically_increasing_id().alias("node"), "weight", "value"), "distinct")
    sizes = [r[0] for r in distinct.select(F.size("value")).distinct().collect()]  # lengths of vectors: a few
    found = None
    for size in sizes:
        part = _search(spark, distinct.where(F.size("value") == size), cosine, cells, block)
        found = part if found is None else found.unionByName(part)
    found = spark.createDataFrame([], FOUND) if found is None else found
    counts = found.where(F.col("n").isNotNull()).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    groups = components(found.where(F.col("b").isNotNull()))
    linked = distinct.join(counts, "node", "left").join(groups, "node", "left").select(
        "value", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component"))
    named = rows.join(linked, "value", "left")
    least = named.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = named.join(least, "component", "left").select(
        F.col("vec_id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col(vec_id).eqNullSafe(F.col("component_id")))


def _search(spark, distinct: DataFrame, cosine: float, cells: int, block: int) -> DataFrame:
    """Link counts (a, n) and spanning links (a, b) of distinct vectors of one length."""
    total = distinct.count()
    sample = distinct.orderBy(F.xxhash64("value"), "node").limit(SAMPLE).select("value").toPandas()
    sample = unit(np.array(sample["value"].tolist(), float))
    centres, basis = upper_levels(sample, min(cells, -(-total // block))), leading(sample)

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = _vectors(part.column(2))
            cell, dist = assign(x, centres)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(cell, pa.int64()), pa.array(dist, pa.float64()),
                 pa.array([v.tobytes() for v in x], pa.binary())], names=VECTOR.names)

    placed = stored(distinct.mapInArrow(place, VECTOR), "placed")
    known = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius")).toPandas()
    parts = {int(c): -(-int(n) // block) for c, n in zip(known["cell"], known["n"])}
    parts_of = F.create_map(*[F.lit(x).cast("long") for kv in parts.items() for x in kv])
    number = F.pmod(F.xxhash64("node"), parts_of[F.col("cell")])
    folder = scratch_path(spark, "trees")

    def plant(group: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(group["x"]), float).reshape(len(group), -1)
        tree, order = build(x, basis)
        held = (tree, group["node"].to_numpy()[order], group["weight"].to_numpy()[order])
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.tree"  # a task that runs again writes another file; the index names one
        with store.open_output_stream(f"{path}/{name}") as out:
            out.write(pickle.dumps(held))
        cell, at = int(group["cell"].iloc[0]), int(group["part"].iloc[0])
        return pd.DataFrame({"block": [cell * (1 << 32) + at], "cell": [cell], "file": [name]})

    trees = stored(placed.withColumn("part", number).groupBy("cell", "part").applyInPandas(plant, BLOCKS), "blocks")
    radius = dict(zip(known["cell"].astype(int), known["radius"]))
    reach = chord(cosine) + SLACK
    near = [(a, b) for a in radius for b in radius
            if np.linalg.norm(centres[a] - centres[b]) <= reach + radius[a] + radius[b]]
    # A pair is little to read and much to do, so the number of tasks is given.
    tasks = max(1, min(1 << 16, sum(parts[a] * parts[b] for a, b in near) // 2 // PAIRS))
    near = spark.createDataFrame(near or [(-1, -1)], "cell long, cell2 long")  # cells squared at most
    other = trees.select(F.col("block").alias("block2"), F.col("cell").alias("cell2"), F.col("file").alias("file2"))
    pairs = trees.join(near, "cell").join(other, "cell2").where("block <= block2")
    pairs = pairs.select("block", "block2", "file", "file2").repartition(tasks, "block", "block2")
    pairs = pairs.sortWithinPartitions("block", "block2")

    def traverse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)

        @functools.lru_cache(4)
        def load(name: str):
            with store.open_input_stream(f"{path}/{name}") as file:
                return pickle.loads(file.read())

        for part in parts:
            for one, two in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                (a, nodes, weights), (b, nodes2, weights2) = load(one), load(two)
                na, nb, edges = links(a, b, weights, weights2, cosine, one == two)
                every = nodes if one == two else np.concatenate([nodes, nodes2])
                n = na if one == two else np.concatenate([na, nb])
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([every[some], every[edges[:, 0]]]), pa.int64()),
                    pa.array([None] * len(some) + every[edges[:, 1]].tolist(), pa.int64()),
                    pa.array(n[some].tolist() + [None] * len(edges), pa.int64())], names=FOUND.names)

    return stored(pairs.mapInArrow(traverse, FOUND), "found")
