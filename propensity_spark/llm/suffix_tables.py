"""The suffix tree as partitioned tables: every context and next symbol that occurs LEAST times, at any corpus size."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from propensity_spark.llm.common import ROWS, discard, slices, stored
from propensity_spark.llm.suffix_tree import DEPTH, GAIN, LEAST, MU

#: Words, or runs of words, that a task gathers before it passes them on.
PAIRS = 1_000_000
#: Parts of scores, the most frequent ones, that every worker holds; the others are joined.
HELD = 1 << 20
#: Log2 of the bits, least and most, of a map that tells which keys cannot be in a table; whatever it lets through is
#: counted or joined.
BITS = 27, 29
#: Bytes of a key that is only counted to fill such a map, beside the bits that its bucket has.
SHORT = 5
#: Words of more bytes are digested one by one.
LONG = 256
#: What a part adds to a text's sums, and the sums.
ADDED = np.dtype([("base", "<f8"), ("own", "<f8"), ("known", "<i4")])
_A = np.array([[0x9E3779B97F4A7C15], [0xC2B2AE3D27D4EB4F]], np.uint64)
_B = np.array([[0xD6E8FEB86659FD93], [0xA0761D6478BD642F]], np.uint64)
_C = np.array([[0xBF58476D1CE4E5B9], [0x94D049BB133111EB]], np.uint64)
#: The second lane of a key has its upper half only.
_HALF = np.uint64(0xFFFFFFFF00000000)
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _stirred(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _C
    x ^= x >> np.uint64(29)
    x[1] &= _HALF
    return x


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """96-bit keys (two lanes) of the runs that begin with the runs a and end with the runs b, both one word shorter."""
    return _stirred(a * _A + b * _B)


def hashed(buffer: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """96-bit keys (two lanes) of pieces of a buffer that ends in eight bytes of no piece."""
    eight = np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))
    keys, done, at = sizes.astype(np.uint64) * _A + _B, 0, np.flatnonzero((sizes > 0) & (sizes <= LONG))
    keys[1] &= _HALF
    while len(at):
        piece = eight[starts[at] + done] & _MASK[np.minimum(sizes[at] - done, 8)]
        keys[:, at] = _stirred((keys[:, at] ^ piece) * _A)
        done += 8
        at = at[sizes[at] > done]
    for i in np.flatnonzero(sizes > LONG).tolist():
        piece = buffer[starts[i]:starts[i] + sizes[i]]
        keys[:, i] = np.frombuffer(blake2b(piece, digest_size=16).digest(), np.uint64)
        keys[1, i] &= _HALF
    return keys


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of the tokens (as suffix_tree.tokens) of all texts one after another, which of them are END, and the
    number of tokens of each text."""
    buffer = b"".join([b"\n", b"\n".join(texts).lower(), b"\n", bytes(8)])
    seen = np.frombuffer(buffer, np.uint8)[:-8]
    space = (seen - np.uint8(9) < 5) | (seen == 32)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts = edges[::2]
    words = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))
    end = np.zeros(len(starts) + len(texts), bool)
    end[words + np.arange(len(texts))] = True
    keys = np.empty((2, len(end)), np.uint64)
    keys[:, ~end] = hashed(buffer, starts, edges[1::2] - starts)
    keys[:, end] = hashed(bytes(8), np.zeros(1, np.int64), np.zeros(1, np.int64))
    return keys, end, np.diff(words, prepend=0) + 1


def _batches(parts: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple]:
    """Some rows, and the tokens() of their texts."""
    for part in parts:
        for few in slices(part, column):
            yield few, *tokens([x or b"" for x in few.column(column).cast(pa.binary()).to_pylist()])


def longer(keys: np.ndarray, fits: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the runs that end at each token, the runs one word longer, and whether they lie within one text."""
    out, ok = np.zeros_like(keys), np.zeros(len(fits), bool)
    out[:, 1:] = mixed(keys[:, :-1], keys[:, 1:])
    ok[1:] = fits[:-1] & fits[1:] & ~end[:-1]
    return out, ok


def runs_of(keys: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the runs of `size` words that end at each token, and whether they lie within one text."""
    fits = np.ones(len(end), bool)
    for _ in range(size - 1):
        keys, fits = longer(keys, fits, end)
    return keys, fits


class Bits:
    """Which keys may be in a table, by the first bits of their lanes. Sent packed, since a small table sets few."""

    def __init__(self, bits: np.ndarray, lanes: int = 1):
        self.bits, self.lanes = bits, lanes

    @property
    def log2(self) -> int:
        return len(self.bits).bit_length() + 2

    def __getstate__(self) -> tuple:
        return zlib.compress(self.bits, 1), self.lanes

    def __setstate__(self, state: tuple) -> None:
        self.bits, self.lanes = np.frombuffer(zlib.decompress(state[0]), np.uint8), state[1]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(keys.shape[1], bool)
        for lane in keys[:self.lanes]:
            left = np.flatnonzero(out)
            at = lane[left] >> np.uint64(64 - self.log2)
            out[left] = (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def map_size(rows: int) -> int:
    """Log2 of the bits that a map over so many rows has."""
    return min(max(BITS[0], rows.bit_length()), BITS[1])


def _blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of values, cut behind the values at `ends`."""
    offsets = (np.append(0, ends) * values.itemsize * values[:1].size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets),
                                                          pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _short(keys: np.ndarray, spread: int, least: int) -> pa.RecordBatch:
    """The first bits of the keys, up to `least` times each: a bucket, and SHORT bytes of every key in it."""
    keys = np.sort(keys)
    keep = np.ones(len(keys), bool)
    keep[least:] = keys[least:] != keys[:-least]
    keys = keys[keep]
    ends = np.searchsorted(keys >> np.uint64(64 - spread), np.arange(1 << spread), "right")
    some = np.flatnonzero(np.diff(ends, prepend=0))
    body = (keys << np.uint64(spread)) >> np.uint64(64 - 8 * SHORT)
    body = np.ascontiguousarray(body.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHORT])
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), _blobs(body, ends[some])], ["bucket", "keys"])


def _map(short: DataFrame, log2: int, spread: int, least: int, lanes: int = 1) -> Bits:
    """The map of the keys that the rows of _short() hold `least` times."""
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = defaultdict(list)
        for part in parts:
            for bucket, blob in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                buckets[bucket].append(blob)
        for bucket in list(buckets):
            body = np.frombuffer(b"".join(buckets.pop(bucket)), np.uint8).reshape(-1, SHORT)
            wide = np.zeros((len(body), 8), np.uint8)
            wide[:, :SHORT] = body
            keys = np.sort(wide.view("<u8")[:, 0])
            often = keys[least - 1:][keys[least - 1:] == keys[:max(0, len(keys) - least + 1)]]
            bits = np.zeros(1 << log2 - spread, bool)
            bits[often >> np.uint64(8 * SHORT - log2 + spread)] = True
            packed = zlib.compress(np.packbits(bits, bitorder="little"), 1)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([packed], pa.binary())],
                                             ["bucket", "keys"])

    out, length = np.zeros(1 << log2 - 3, np.uint8), 1 << log2 - spread - 3
    for bucket, packed in short.repartition("bucket").mapInArrow(count, short.schema).collect():
        out[bucket * length:(bucket + 1) * length] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return Bits(out, lanes)


def bits_of(table: DataFrame, log2: int, spread: int, lanes: int = 1) -> Bits:
    """The map of a table's keys, by so many lanes."""
    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x.to_numpy(zero_copy_only=False).view(np.uint64) for part in parts for x in part.columns]
        if held:
            yield _short(np.concatenate(held), spread, 1)

    keys = table.select(*["key0", "key1"][:lanes])
    return _map(keys.mapInArrow(gather, "bucket int, keys binary"), log2, spread, 1, lanes)


def _long(lane: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(lane).view(np.int64))


def _keys(part: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([part.column(first + i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2)])


def _fields(*names: str) -> list[StructField]:
    return [StructField(x, LongType()) for x in names]


def _tally(lanes: np.ndarray, by: np.ndarray) -> list[pa.Array]:
    """The distinct columns of `lanes`, which have equal values in `by`, and how often each occurs; two that share
    their value may be listed more than once."""
    order = np.argsort(by)
    lanes = lanes[:, order]
    first = np.flatnonzero(np.append(True, (lanes[:, 1:] != lanes[:, :-1]).any(0)))
    n = np.diff(first, append=len(by))
    return [*[_long(x[first]) for x in lanes], pa.array(n.astype(np.int64))]


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """key0, key1, n: how often each word and END occurs."""
    names = ["key0", "key1", "n"]

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gathered = [], 0
        for _, keys, end, _ in _batches(parts, 0):
            held.append(keys)
            gathered += len(end)
            if gathered > PAIRS:
                yield pa.RecordBatch.from_arrays(_tally(all_ := np.concatenate(held, 1), all_[0]), names)
                held, gathered = [], 0
        if gathered:
            yield pa.RecordBatch.from_arrays(_tally(all_ := np.concatenate(held, 1), all_[0]), names)

    found = texts.select(text).mapInArrow(count, StructType(_fields(*names)))
    return found.groupBy("key0", "key1").agg(F.sum("n").alias("n"))


def word_keys(counts: DataFrame) -> DataFrame:
    """key0, key1, n of a table of word counts (word, c)."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            words = part.column(0).cast(pa.binary()).to_pylist()
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            keys = hashed(b"".join([*words, bytes(8)]), np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([_long(keys[0]), _long(keys[1]), part.column(1)], ["key0", "key1", "n"])

    return counts.select("word", "c").mapInArrow(run, StructType(_fields("key0", "key1", "n")))


def frequent(texts: DataFrame, size: int, shorter, least: int, spread: int, text: str = "text") -> Bits:
    """A map of the runs of `size` words that occur `least` times, and of few others.

    `shorter` is a broadcast map of the runs one word shorter that do. Only the first bits of each key are counted: a
    task passes on, for each of 2^spread buckets, SHORT bytes of every key, up to `least` times from one block.
    """
    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may, held, gathered = shorter.value, [], 0
        for _, keys, end, _ in _batches(parts, 0):
            keys, fits = runs_of(keys, end, size - 1)
            often = np.zeros(len(end), bool)
            at = np.flatnonzero(fits)
            often[at] = may(keys[:, at])
            i = np.flatnonzero(often[:-1] & often[1:] & ~end[:-1])
            held.append(mixed(keys[:, i], keys[:, i + 1])[0])
            gathered += len(i)
            if gathered > 4 * PAIRS:
                yield _short(np.concatenate(held), spread, least)
                held, gathered = [], 0
        if gathered:
            yield _short(np.concatenate(held), spread, least)

    found = texts.select(text).mapInArrow(gather, "bucket int, keys binary")
    return _map(found, shorter.value.log2, spread, least)


def runs(texts: DataFrame, size: int, bits, least: int, text: str = "text") -> DataFrame:
    """ctx0, ctx1, suf0, suf1, key0, key1, n: the runs of `size` words that occur `least` times, as their first and last
    size - 1 words. `bits` is a broadcast map that lets them through; END is last or not there."""
    three, four = ["ctx0", "suf0", "halves"], ["ctx0", "ctx1", "suf0", "suf1"]

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may, held, named, gathered = bits.value, [], [], 0
        for _, keys, end, _ in _batches(parts, 0):
            keys, fits = runs_of(keys, end, size - 1)
            key, fits = longer(keys, fits, end)
            i = np.flatnonzero(fits)
            i = i[may(key[:, i])]
            held.append(np.stack([keys[0, i - 1], keys[0, i], keys[1, i - 1] | keys[1, i] >> np.uint64(32)]))
            named.append(key[0, i])
            gathered += len(i)
            if gathered > 4 * PAIRS // 3:
                yield pa.RecordBatch.from_arrays(_tally(np.concatenate(held, 1), np.concatenate(named)), [*three, "n"])
                held, named, gathered = [], [], 0
        if gathered:
            yield pa.RecordBatch.from_arrays(_tally(np.concatenate(held, 1), np.concatenate(named)), [*three, "n"])

    def name(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ctx0, suf0, halves = (part.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
            ctx, suf = np.stack([ctx0, halves & _HALF]), np.stack([suf0, halves << np.uint64(32)])
            yield pa.RecordBatch.from_arrays(
                [*map(_long, [*ctx, *suf, *mixed(ctx, suf)]), part.column(3)], [*four, "key0", "key1", "n"])

    found = texts.select(text).mapInArrow(count, StructType(_fields(*three, "n")))
    found = found.groupBy(*three).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return found.mapInArrow(name, StructType(_fields(*four, "key0", "key1", "n")))


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of the queries run inside go when a query ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass
class Tables:
    parts: DataFrame  # key0, key1, base, own, known, n: what a word or a run adds to a score wherever it ends
    train_tokens: int
    vocabulary: int

    @property
    def spread(self) -> int:
        """Log2 of the buckets that keys are dealt to."""
        return min(max(6, self.train_tokens.bit_length() - 18), 16)


def train(texts: DataFrame, counts: DataFrame, text: str = "text", depth: int = DEPTH, least: int = LEAST,
          mu: float = MU, gain: float = GAIN) -> Tables:
    """The tree of suffix_tree.train with `least` as the only floor, at any size of the corpus, in tables.

    A token's score after its longest kept contexts is a sum of parts: its word's base; for each length the factor
    alpha of a kept context; and where the context has the token as an entry, log10(p / (shorter * alpha)), p being
    the entry's probability and shorter the one after the context's suffix. A run is the entry of its last word, and
    the context of the next one, which there always is: END is in no context. So each run has one row with both.

    The parts are found level by level: runs of length + 1 words are counted where both shorter runs in them occur often
    enough, joined with the probability of their last word one level below, and summed up per context. Each length is
    counted twice: by the first bits of all keys, which tells the few that may be frequent, and then those exactly.
    The driver sees sums and maps of at most 2^29 bits. `counts` is a table of word_counts(), or of those of suffix_tree.
    """
    with shuffles_removed(texts.sparkSession):
        return _train(texts, counts, text, depth, least, mu, gain)


def _train(texts: DataFrame, counts: DataFrame, text: str, depth: int, least: int, mu: float, gain: float) -> Tables:
    context = texts.sparkSession.sparkContext
    words = stored(word_keys(counts) if "word" in counts.columns else counts, "words")
    total, kinds = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    tables = Tables(words, int(total or 0), int(kinds))
    seen = math.log10(tables.train_tokens + 0.5 * (tables.vocabulary + 1))
    base, none = F.log10(F.col("n") + 0.5) - F.lit(seen), F.lit(0.0)
    # A level has the runs of one length: how often, their last word's probability, and what they add as an entry.
    level = words.select("key0", "key1", "n", F.pow(F.lit(10.0), base).alias("p"), base.alias("base"), none.alias("entry"))
    handle = context.broadcast(bits_of(words.where(F.col("n") >= least), map_size(tables.train_tokens), tables.spread))
    made = []
    for size in range(2, depth + 2):
        last, handle = handle, context.broadcast(frequent(texts, size, handle, least, tables.spread, text))
        last.destroy()
        found = stored(runs(texts, size, handle, least, text), "runs")
        below = level.where(F.col("n") >= least)
        shorter = below.select(F.col("key0").alias("suf0"), F.col("key1").alias("suf1"), F.col("p").alias("shorter"))
        entries = stored(found.join(shorter, ["suf0", "suf1"]).drop("suf0", "suf1"), "entries")
        discard(found)
        n, s = F.col("n"), F.col("shorter")
        sums = entries.groupBy(F.col("ctx0").alias("key0"), F.col("ctx1").alias("key1")).agg(
            F.sum("n").alias("listed"), F.sum("shorter").alias("mass"), F.count(F.lit(1)).alias("entries"),
            F.sum(n * F.log((n + mu * s) / s)).alias("nats"))
        rest, mass = F.col("n") - F.col("listed"), F.greatest(1 - F.col("mass"), F.lit(1e-12))
        factor = (rest + mu * mass) / ((n + mu) * mass)
        gained = F.col("nats") - F.col("listed") * F.log(n + mu) + rest * F.log(factor)
        alpha = F.when(gained > gain * F.col("entries"), factor).alias("alpha")
        ended = stored(level.join(sums, ["key0", "key1"], "left").select("key0", "key1", "n", "base", "entry", alpha), "level")
        discard(level)
        made.append(ended)
        of = ended.where("alpha IS NOT NULL").select(
            F.col("key0").alias("ctx0"), F.col("key1").alias("ctx1"), F.col("n").alias("total"), "alpha")
        p = (n + mu * s) / (F.col("total") + mu)
        kept = F.col("alpha").isNotNull()
        level = stored(entries.join(of, ["ctx0", "ctx1"], "left").select(
            "key0", "key1", "n", F.when(kept, p).otherwise(s).alias("p"), none.alias("base"),
            F.when(kept, F.log10(p / s / F.col("alpha"))).otherwise(none).alias("entry")), "below")
        discard(entries)
    handle.destroy()
    made.append(level.withColumn("alpha", F.lit(None).cast("double")))
    own = F.col("entry") + F.coalesce(F.log10("alpha"), none)
    for at, x in enumerate(made):
        part = x.select("key0", "key1", "base", own.alias("own"), F.lit(int(at == 0)).alias("known"), "n")
        tables.parts = part if not at else tables.parts.unionByName(part.where("own <> 0"))
    return tables


class Held:
    """The most frequent parts in a table of slots; a key whose slot is taken has the next free one."""

    def __init__(self, keys: np.ndarray, added: np.ndarray):
        self.__setstate__((keys, added))

    def __getstate__(self) -> tuple:
        return self.keys, self.added

    def __setstate__(self, state: tuple) -> None:
        self.keys, self.added = state
        self.slots = np.full(4 << max(4, self.keys.shape[1].bit_length()), -1, np.int32)
        left, at = np.arange(self.keys.shape[1]), self._first(self.keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            more = self.slots[at] != left
            left, at = left[more], (at[more] + np.uint64(1)) & np.uint64(len(self.slots) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return keys[0] & np.uint64(len(self.slots) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is not held."""
        out = np.full(keys.shape[1], -1, np.int32)
        if not self.keys.shape[1]:
            return out
        left, at = np.arange(len(out)), self._first(keys)
        while len(left):
            found = self.slots[at]
            same = (self.keys[0][found] == keys[0, left]) & (self.keys[1][found] == keys[1, left]) & (found >= 0)
            out[left[same]] = found[same]
            more = ~same & (found >= 0)
            left, at = left[more], (at[more] + np.uint64(1)) & np.uint64(len(self.slots) - 1)
        return out


def most_frequent(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """At most HELD parts with the highest counts, and the others."""
    step = F.floor(F.log2("n") * 16).cast("long")
    sizes = sorted(parts.groupBy(step.alias("step")).count().collect(), reverse=True)
    sums = list(itertools.accumulate(r["count"] for r in sizes))
    floor = min((r["step"] for r, s in zip(sizes, sums) if s <= HELD), default=1 << 20)
    return parts.where(step >= floor), parts.where(step < floor)


def _added(part: pa.RecordBatch, first: int) -> np.ndarray:
    out = np.empty(part.num_rows, ADDED)
    for i, name in enumerate(ADDED.names):
        out[name] = part.column(first + i).to_numpy(zero_copy_only=False)
    return out


def _dealt(keys: np.ndarray, values: np.ndarray, spread: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Buckets by the first bits of the second lane, the first lanes of the keys in each, and their values."""
    bucket = keys[1] >> np.uint64(64 - spread)
    order = np.argsort((bucket << np.uint64(64 - spread)) | (keys[0] >> np.uint64(spread)))  # equal keys side by side
    ends = np.searchsorted(bucket[order], np.arange(1 << spread), "right")
    some = np.flatnonzero(np.diff(ends, prepend=0))
    return some, _blobs(keys[0][order], ends[some]), _blobs(values[order], ends[some])


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    rows, values = rows[order], values[order]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    out = np.empty(len(first), ADDED)
    for name in ADDED.names:
        out[name] = np.add.reduceat(values[name], first) if len(first) else 0
    return rows[first], out


def score(docs: DataFrame, tables: Tables, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per document row: doc_id, n_tokens, n_known, base_score, score, as suffix_tree.score gives.

    Parts that are held are added where the text is read. Keys that may be among the others go to the buckets of these,
    64 bits of each beside those that choose its bucket, and what is found there goes back to the block of texts.
    """
    with shuffles_removed(docs.sparkSession):
        return _score(docs, tables, doc_id, text, depth)


def _score(docs: DataFrame, tables: Tables, doc_id: str, text: str, depth: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    spread, (top, others) = tables.spread, most_frequent(tables.parts)
    top = top.select("key0", "key1", *ADDED.names).toArrow().combine_chunks().to_batches()
    held = [(_keys(x, 0), _added(x, 2)) for x in top]
    held = Held(np.concatenate([np.zeros((2, 0), np.uint64), *[k for k, _ in held]], 1),
                np.concatenate([np.zeros(0, ADDED), *[v for _, v in held]]))
    may = bits_of(others, map_size(tables.train_tokens), spread, 2)
    handle = docs.sparkSession.sparkContext.broadcast((held, may))
    source = docs.select(F.col(doc_id).alias("id"), text)
    sums = [*_fields("row", "n_tokens", "known"), StructField("base", DoubleType()), StructField("own", DoubleType())]
    schema = StructType([source.schema["id"], *_fields("block"), *sums, StructField("bucket", IntegerType()),
                         StructField("keys", BinaryType()), StructField("values", BinaryType())])
    arrow = to_arrow_schema(schema)

    def batch(n: int, **columns) -> pa.RecordBatch:
        given = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()}
        return pa.RecordBatch.from_arrays(
            [given[f.name].cast(f.type) if f.name in given else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, may = handle.value
        row = block = TaskContext.get().partitionId() << 40
        wanted, rows, gathered, n_blocks = [], [], 0, 0

        def emit() -> pa.RecordBatch:
            some, keys, values = _dealt(np.concatenate(wanted, 1), np.concatenate(rows), spread)
            return batch(len(some), block=np.full(len(some), block), bucket=some, keys=keys, values=values)

        for few, keys, end, sizes in _batches(parts, 1):
            n, of, fits = len(sizes), np.repeat(np.arange(len(sizes)), sizes), np.ones(len(end), bool)
            here = np.zeros(n, ADDED)
            for size in range(1, depth + 2):
                at = np.flatnonzero(fits)
                run = keys[:, at]
                found = held(run)
                some = np.flatnonzero(found >= 0)
                added, to = held.added[found[some]], of[at[some]]
                for name in ADDED.names[:1] + ADDED.names[2:] if size == 1 else ():
                    here[name] += np.bincount(to, added[name], n).astype(here[name].dtype)
                here["own"] += np.bincount(to, added["own"], n)
                rest = np.flatnonzero(found < 0)
                rest = rest[may(run[:, rest])]
                wanted.append(run[:, rest])
                rows.append((of[at[rest]] + (row - block)).astype(np.uint16))
                gathered += len(rest)
                keys, fits = longer(keys, fits, end)
            yield batch(n, id=few.column(0), block=np.full(n, block), row=np.arange(row, row + n), n_tokens=sizes,
                        known=here["known"], base=here["base"], own=here["own"],
                        bucket=np.full(n, n_blocks % (1 << spread)))
            row += n
            if gathered > PAIRS or row - block > (1 << 16) - ROWS - 1:
                if gathered:
                    yield emit()
                wanted, rows, gathered, n_blocks, block = [], [], 0, n_blocks + 1, row
        if gathered:
            yield emit()

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gathered = [], 0
        for part in itertools.chain(parts, [None]):
            if part is not None and part.num_rows:
                held.append((_keys(part, 0), _added(part, 2)))
                gathered += part.num_rows
            if gathered > PAIRS or (gathered and part is None):
                some, keys, values = _dealt(np.concatenate([k for k, _ in held], 1), np.concatenate([v for _, v in held]), spread)
                yield batch(len(some), block=np.full(len(some), -1), bucket=some, keys=keys, values=values)
                held, gathered = [], 0

    def look_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, wanted, blocks, found = defaultdict(list), defaultdict(list), set(), []
        for part in parts:
            whole = part.filter(part.column("row").is_valid())
            if whole.num_rows:
                yield whole
            part = part.filter(part.column("row").is_null())
            for block, bucket, keys, values in zip(*[part.column(c).to_pylist() for c in ("block", "bucket", "keys", "values")]):
                (table if block < 0 else wanted)[bucket].append((block, keys, values))
                blocks.add(block)
        for bucket, asked in wanted.items():
            entries = table.pop(bucket, [])
            keys = np.frombuffer(b"".join(k for _, k, _ in entries), np.uint64)
            values = np.frombuffer(b"".join(v for _, _, v in entries), ADDED)
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
            for block, want, rows in asked if len(keys) else ():
                want = np.frombuffer(want, np.uint64)
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == want)
                found.append(_summed(np.frombuffer(rows, np.uint16)[hit].astype(np.int64) + block, values[at[hit]]))
        if found:
            rows, values = _summed(*[np.concatenate(x) for x in zip(*found)])
            blocks = np.array(sorted(blocks - {-1}))
            ends = np.append(np.searchsorted(rows, blocks[1:]), len(rows))
            yield batch(len(blocks), block=blocks, keys=_blobs(rows, ends), values=_blobs(values, ends))

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, keys, values = [], [], []
        for part in parts:
            whole.append(part.filter(part.column("row").is_valid()).select(range(7)))
            part = part.filter(part.column("row").is_null())
            keys += part.column("keys").to_pylist()
            values += part.column("values").to_pylist()
        if not sum(x.num_rows for x in whole):
            return
        rows, values = _summed(np.frombuffer(b"".join(keys), np.int64), np.frombuffer(b"".join(values), ADDED))
        for x in whole:
            if not x.num_rows:
                continue
            at = np.searchsorted(rows, wanted := x.column("row").to_numpy())
            extra = np.append(values, np.zeros(1, ADDED))[at]
            extra[np.append(rows, -1)[at] != wanted] = 0
            columns = {c: x.column(c) for c in ("id", "block", "row", "n_tokens")}
            yield batch(x.num_rows, **columns, **{c: x.column(c).to_numpy() + extra[c] for c in ADDED.names})

    asked = source.mapInArrow(read, schema).unionByName(
        others.select("key0", "key1", *ADDED.names).mapInArrow(deal, schema))
    found = asked.repartition("bucket").mapInArrow(look_up, schema)
    out = stored(found.repartition("block").mapInArrow(add, schema).select("id", *[f.name for f in sums]), "scored")
    unknown = math.log10(0.5) - math.log10(tables.train_tokens + 0.5 * (tables.vocabulary + 1))
    base = F.col("base") + (F.col("n_tokens") - F.col("known")) * F.lit(unknown)
    return out.select(F.col("id").alias(doc_id), "n_tokens", F.col("known").alias("n_known"), base.alias("base_score"),
                      (base + F.col("own")).alias("score"))
