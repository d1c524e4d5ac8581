"""Product codes of vectors: integer codebooks learned over Hilbert-sorted flat blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, DecimalType, IntegerType, LongType, StructField, StructType)

from propensity_spark.llm.common import free_name, stored

#: Rows of a flat block.
BLOCK = 256
#: Bits of a Hilbert key; parts of more components than this are ordered by their first ones.
KEY_BITS = 60
#: Up to here sums of squares are exact in doubles; larger ones are computed with Python's integers.
EXACT = 1 << 53
LARGEST = (1 << 63) - 1


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Places of points (rows of components below 2^bits) on the Hilbert curve through their grid.

    The transform works on the transposed key: rotations are undone from the highest bit plane down, the Gray code
    is resolved, and the planes are interleaved.
    """
    x = x.astype(np.uint64)
    dims, one = x.shape[1], np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for i in range(dims):
            hit = (x[:, i] >> np.uint64(b)) & one == one
            swap = np.where(hit, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(hit, low, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, dims - 1] >> np.uint64(b)) & one == one, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= turn[:, None]
    key = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[:, i] >> np.uint64(b)) & one)
    return key


def curve_order(x: np.ndarray, low: int, high: int) -> np.ndarray:
    """Hilbert keys of integer vectors whose components lie between low and high. Any order gives the same codes."""
    dims = min(x.shape[1], KEY_BITS)
    if not dims:
        return np.zeros(len(x), np.int64)
    bits = min(16, KEY_BITS // dims)
    share = (x[:, :dims].astype(float) - float(low)) / max(1.0, float(high) - float(low))
    grid = np.clip(share * (1 << bits), 0, (1 << bits) - 1).astype(np.uint64)
    return hilbert_keys(grid, bits).astype(np.int64)


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as doubles where all sums of squares of differences stay exact, else as Python integers."""
    most = max((int(abs(int(f(a)))) for a in arrays if a.size for f in (np.min, np.max)), default=0)
    kind = float if 4 * most * most * max(1, arrays[0].shape[-1]) < EXACT else object
    return [a.astype(kind) for a in arrays]


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Indexes, ascending, of the entries that can be nearest to some point of the box [low, high].

    An entry farther from every point of the box than another one is from its farthest point cannot be.
    """
    low, high, entries = _exact(low, high, entries)
    below, above = low - entries, entries - high
    nearest = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=1)
    farthest = (np.maximum(abs(below), abs(above)) ** 2).sum(axis=1)
    return np.flatnonzero(nearest <= farthest.min())


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the first of equals) and its squared distance, for every row of x; exact."""
    a, e = _exact(x, entries)
    if a.dtype == float:
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ e.T) + (e * e).sum(axis=1)
    else:
        d = np.stack([((a - row) ** 2).sum(axis=1) for row in e], axis=1)
    best = np.array(d.argmin(axis=1), int)
    return best, d[np.arange(len(a)), best]


class Codes(NamedTuple):
    """vectors: `keep`, code, error of every kept vector. codebooks[part][entry][position]: the final integers."""

    vectors: DataFrame
    codebooks: list[list[list[int]]]

    def digest(self) -> str:
        """SHA-256 of all entries' components in decimal by part, entry and position, joined by commas."""
        flat = ",".join(str(x) for part in self.codebooks for entry in part for x in entry)
        return hashlib.sha256(flat.encode()).hexdigest()


BLOCKS = StructType([StructField("part", IntegerType()), StructField("n", IntegerType()),
                     StructField("rows", BinaryType()), StructField("values", BinaryType()),
                     StructField("low", ArrayType(LongType())), StructField("high", ArrayType(LongType())),
                     StructField("sums", ArrayType(DecimalType(38, 0)))])
PIECES = StructType([StructField("part", IntegerType()), StructField("key", LongType()),
                     StructField("row", LongType()), StructField("x", ArrayType(LongType()))])
SUMS = StructType([StructField("part", IntegerType()), StructField("entry", IntegerType()),
                   StructField("n", LongType()), StructField("sums", ArrayType(DecimalType(38, 0)))])
FOUND = StructType([StructField("row", LongType()), StructField("part", IntegerType()),
                    StructField("entry", IntegerType()), StructField("distance", DecimalType(38, 0))])


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _decimals(values) -> list[Decimal]:
    return [Decimal(int(v)) for v in values]


def _blocks(kept: DataFrame, dims: int, parts: int) -> DataFrame:
    """The parts of all vectors in Hilbert order, in flat blocks with their boxes and sums; a stored table."""
    from pyspark.sql.pandas.types import to_arrow_schema

    width = dims // parts
    limits = kept.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    low, high = (int(x or 0) for x in limits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(PIECES)
        for batch in batches:
            x = _lists(batch.column(1), dims)
            for p in range(parts):
                piece = np.ascontiguousarray(x[:, p * width:(p + 1) * width])
                offsets = np.arange(len(piece) + 1, dtype=np.int32) * width
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(piece), p, np.int32)), pa.array(curve_order(piece, low, high)),
                     batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(piece.ravel()))],
                    schema=arrow)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(BLOCKS)
        for batch in batches:
            part, row = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            x = _lists(batch.column(3), width)
            edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            made = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                for i in range(a, b, BLOCK):
                    v = x[i:min(i + BLOCK, b)]
                    made.append((int(part[i]), len(v), row[i:i + len(v)].tobytes(), v.tobytes(),
                                 v.min(axis=0).tolist(), v.max(axis=0).tolist(),
                                 _decimals(v.astype(object).sum(axis=0))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

    pieces = kept.select("row", "v").mapInArrow(cut, PIECES)
    ordered = pieces.repartitionByRange("part", "key", "row").sortWithinPartitions("part", "key", "row")
    return stored(ordered.mapInArrow(pack, BLOCKS), "blocks")


def _read(batch: pa.RecordBatch, width: int) -> Iterator[tuple]:
    """part, row numbers, values, low, high, sums of every block of a batch."""
    for r in batch.to_pylist():
        yield (r["part"], np.frombuffer(r["rows"], np.int64), np.frombuffer(r["values"], np.int64).reshape(r["n"], width),
               np.array(r["low"], np.int64), np.array(r["high"], np.int64), r["sums"])


def _totals(blocks: DataFrame, books, width: int) -> DataFrame:
    """(part, entry, n, s0, s1, ...): how many parts are nearest to each entry that is used, and their sums.

    A block whose shortlist is one entry adds its stored sums; of others the rows are compared with the shortlist.
    Each task hands out one row per entry it met.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            for part, _, x, low, high, sums in _read(batch, width):
                book = books.value[part]
                few = shortlist(low, high, book)
                if len(few) == 1:
                    used = [(int(few[0]), len(x), [int(s) for s in sums])]
                else:
                    code, _ = nearest(x, book[few])
                    used = [(int(few[e]), int((code == e).sum()), x[code == e].astype(object).sum(axis=0).tolist())
                            for e in np.unique(code)]
                for entry, n, total in used:
                    old = found.setdefault((part, entry), [0, [0] * width])
                    old[0] += n
                    old[1] = [a + b for a, b in zip(old[1], total)]
        rows = [(p, e, n, _decimals(s)) for (p, e), (n, s) in found.items()]
        if rows:
            arrow = to_arrow_schema(SUMS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    each = blocks.mapInArrow(run, SUMS)
    return each.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])


def _assigned(blocks: DataFrame, books, width: int) -> DataFrame:
    """(row, part, entry, distance) of every part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(FOUND)
        for batch in batches:
            for part, rows, x, low, high, _ in _read(batch, width):
                few = shortlist(low, high, books.value[part])
                code, distance = nearest(x, books.value[part][few])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), pa.array(np.full(len(x), part, np.int32)), pa.array(few[code].astype(np.int32)),
                     pa.array(_decimals(distance), arrow[3].type)], schema=arrow)

    return blocks.mapInArrow(run, FOUND)


def encode(
    vectors: DataFrame, keep: list[str], vec_id: str = "vec_id", vector: str = "embedding", parts: int = 4,
    entries: int = 256, rounds: int = 4, scale: int = 1024, code: str = "code", error: str = "error",
) -> Codes:
    """Integer product codes of all vectors: the columns `keep`, `code` and `error`, and the codebooks.

    A component x counts as floor(scale * x) (limited to the range of a long); vectors are cut into `parts` equal
    consecutive parts. The codebook of a part position starts as that part of the `entries` vectors with the smallest
    ids (NULL ids last, equal ids by their components). Each round assigns all parts to the nearest entry by squared
    Euclidean distance (ties to the lower index) and replaces each used entry by its parts' floored means; then parts
    are assigned once more. `code` has two hex digits, or as many as the largest index needs, per part; `error` is the
    sum of the final squared distances, or the largest long if that is less. All arithmetic is of integers.

    Vectors that are NULL or hold NULL or non-finite components are left out. Repeated ids and equal vectors are rows
    like any other. Without vectors, or with empty ones, codebooks are empty or of empty entries. Vectors of different
    lengths, or of a length that `parts` does not divide, raise ValueError.

    The parts lie sorted along a Hilbert curve in flat blocks of 256 with their boxes and sums, in one stored table.
    Every round reads it once, finds each block's shortlist of entries from box distances alone, and compares rows with
    that; only (part, entry) sums are shuffled. The driver holds the codebooks.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    integers = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    names = [f"_keep{i}" for i in range(len(keep))]
    kept = stored(vectors.where(F.col(vector).isNotNull() & fine).select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).alias("id"), integers.alias("v"),
        *[F.col(c).alias(n) for c, n in zip(keep, names)]), "vectors")
    sizes = kept.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    dims = sizes[0] or 0
    if sizes[0] != sizes[1] or dims % parts:
        raise ValueError(f"vectors of {sizes[0]} to {sizes[1]} components cannot be cut into {parts} equal parts")
    width = dims // parts
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.array([r["v"] for r in first], np.int64).reshape(len(first), dims)
    books = [start[:, p * width:(p + 1) * width].copy() for p in range(parts)]
    context = kept.sparkSession.sparkContext
    blocks = _blocks(kept, dims, parts)
    for _ in range(rounds if width else 0):
        sent = context.broadcast(books)
        totals = _totals(blocks, sent, width).collect()  # at most parts x entries rows
        sent.unpersist()
        for r in totals:
            books[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    found = _assigned(blocks, context.broadcast(books), width)
    digits = max(2, len(f"{entries - 1:x}"))
    one = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("part") == p, F.col("entry"))))), digits, "0") for p in range(parts)]
    total = F.least(F.sum("distance"), F.lit(Decimal(LARGEST))).cast("bigint")
    each = found.groupBy("row").agg(F.concat(*one).alias("_code"), total.alias("_error"))
    out = kept.join(each, "row").select(
        *[F.col(n).alias(c) for c, n in zip(keep, names)], F.col("_code").alias(code), F.col("_error").alias(error))
    return Codes(out, [b.tolist() for b in books])


def group_errors(coded: DataFrame, by: str, error: str = "error", name: str = "label_error") -> DataFrame:
    """Add the error summed over the rows with the same `by` (NULLs together); at most the largest long."""
    key, total = free_name("_by", coded.columns), free_name("_total", coded.columns)
    sums = coded.groupBy(F.col(by).alias(key)).agg(
        F.least(F.sum(F.col(error).cast("decimal(38,0)")), F.lit(Decimal(LARGEST))).cast("bigint").alias(total))
    return coded.join(sums, coded[by].eqNullSafe(sums[key])).withColumn(name, F.col(total)).drop(key, total)
