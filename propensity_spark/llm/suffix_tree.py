"""Language-model scoring with a probabilistic suffix tree over words."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, DoubleType, LongType, StructField, StructType)

from propensity_spark.llm.common import slices, stored

#: The end of a text; no word is empty.
END = b""
#: Words with this share of the training tokens are held by every worker, so at most 1 / FREQUENT of them.
FREQUENT = 1e-6
#: Contexts (words, or runs of up to DEPTH words) need this share: at most 1 / CONTEXT of each length.
CONTEXT = 1e-5
#: Next symbols of a context are kept from this share on: at most 1 / ENTRY for each length.
ENTRY = 2e-6
LEAST = 4
DEPTH = 3
#: Weight, in tokens, of the shorter context when a distribution is smoothed.
MU = 20.0
#: A context stays if its distribution gains more than this many nats over its suffix's, per kept next symbol.
GAIN = 2.0
#: Distinct words, and pairs, that a task gathers before it passes them on.
WORDS, PAIRS = 500_000, 3_000_000


def tokens(text: bytes) -> list[bytes]:
    """The words of the text, A-Z lower-cased and cut at ASCII space and tab to carriage return, and END."""
    return [*text.lower().split(), END]


def _batches(parts: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[int]]]:
    """Some rows, the tokens of all their texts one after another, and the number of tokens of each."""
    for part in parts:
        for few in slices(part, column):
            flat, sizes = [], []
            for x in few.column(column).cast(pa.binary()).to_pylist():
                words = tokens(x or b"")
                flat += words
                sizes.append(len(words))
            yield few, flat, sizes


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """word, c: how often each word and END occurs; each task adds up its own words before the shuffle."""
    schema = StructType([StructField("word", BinaryType()), StructField("c", LongType())])

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "c"])

        seen: Counter = Counter()
        for _, flat, _ in _batches(parts, 0):
            seen.update(flat)
            if len(seen) > WORDS:
                yield emit(seen)
                seen = Counter()
        if seen:
            yield emit(seen)

    return texts.select(text).mapInArrow(count, schema).groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Level:
    """Contexts of one length and their next symbols.

    A context is known by its place in `contexts`, whose sorted keys are: at length 1 the number of the word, beyond
    it the number of the word furthest back plus room * the number of the suffix one level below. Contexts that are
    not `kept` are passed over when texts are scored; longer ones may hang on them.
    """

    contexts: np.ndarray
    total: np.ndarray  # occurrences that a symbol follows
    kept: np.ndarray
    alpha: np.ndarray  # factor of the suffix's probability for symbols that are not entries
    entries: np.ndarray  # sorted keys: number of the context * words + next word
    counts: np.ndarray


@dataclass
class Tree:
    words: dict[bytes, int]  # frequent words, END among them
    base: np.ndarray  # log10 probability of each frequent word at the root
    levels: list[Level]
    train_tokens: int
    vocabulary: int

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.get, words, itertools.repeat(-1)), np.int64, len(words))


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted key, -1 where it is missing."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def states(tree: Tree, ids: np.ndarray, levels: int) -> list[np.ndarray]:
    """For each length the number of the context that ends before each token, -1 where it is not in the tree.

    ids may be those of several texts: END is in no context, so none reaches back into another text.
    """
    found, room = [], len(tree.words) + 1
    for length in range(1, levels + 1):
        keys = tree.levels[length - 1].contexts
        before = np.concatenate([np.full(min(length, len(ids)), -1), ids[:max(0, len(ids) - length)]])
        if length == 1:
            place = np.full(room, -1)  # of each word, and at the end of -1
            place[keys] = np.arange(len(keys))
            found.append(place[before])
            continue
        at = np.full(len(ids), -1)
        ok = np.flatnonzero((before >= 0) & (found[-1] >= 0))
        at[ok] = _find(keys, before[ok] + found[-1][ok] * room)
        found.append(at)
    return found


def next_counts(texts: DataFrame, tree, depth: int, floor: int, text: str = "text") -> DataFrame:
    """key, n: how often each (context of the deepest level, next frequent word) pair occurs, where n >= floor."""
    schema = StructType([StructField("key", LongType()), StructField("n", LongType())])

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, size = tree.value, [], 0

        def emit() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])

        for _, flat, _ in _batches(parts, 0):
            ids = model.ids(flat)
            state = states(model, ids, depth)[-1]
            ok = (state >= 0) & (ids >= 0)
            held.append(state[ok] * len(model.words) + ids[ok])
            size += len(held[-1])
            if size > PAIRS:
                yield emit()
                held, size = [], 0
        if held:
            yield emit()

    found = texts.select(text).mapInArrow(count, schema).groupBy("key").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= floor)


def train(texts: DataFrame, counts: DataFrame, text: str = "text", depth: int = DEPTH, frequent: float = FREQUENT,
          often: float = CONTEXT, entry: float = ENTRY, least: int = LEAST, mu: float = MU, gain: float = GAIN) -> Tree:
    """The tree of a corpus with its word counts.

    Level by level: contexts of length 1 are words, longer ones are the pairs of context and next symbol of the level
    before, if often enough. Next symbols are counted over the whole corpus. A context's distribution gives an entry
    (n + mu * p) / (N + mu), p being its probability after the suffix; other symbols share what is left in proportion
    to p. The context is retained if the likelihood of what follows it gains more than `gain` nats per entry over the
    suffix's distribution (N times their divergence). Only tables bounded by the shares meet the driver.
    """
    total, kinds = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    total, kinds = int(total or 0), int(kinds)
    at_least = lambda share: max(least, math.ceil(share * total))
    common = counts.where(F.col("c") >= at_least(frequent)).orderBy(F.desc("c"), "word").toPandas()
    words = {bytes(w): i for i, w in enumerate(common["word"])}
    c = common["c"].to_numpy(np.int64)
    tree = Tree(words, np.log10(c + 0.5) - math.log10(total + 0.5 * (kinds + 1)), [], total, kinds)
    room, n_words = len(words) + 1, max(1, len(words))
    keys = np.flatnonzero(c >= at_least(often))
    keys = keys[keys != words.get(END, -1)]  # nothing follows the end
    seen = c[keys]
    for length in range(1, depth + 1):
        empty, size = np.zeros(0, np.int64), len(keys)
        own = Level(keys, seen, np.zeros(size, bool), np.ones(size), empty, empty)
        tree.levels.append(own)
        if not size:
            continue
        handle = texts.sparkSession.sparkContext.broadcast(tree)
        found = next_counts(texts, handle, length, at_least(entry), text).toPandas().sort_values("key")
        handle.unpersist()
        own.entries, own.counts = found["key"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
        context, symbol = own.entries // n_words, own.entries % n_words
        n = own.counts.astype(float)
        shorter = 10 ** _probability(tree, _suffixes(tree, length, context), symbol, mu)
        add = lambda x, at=context, size=size: np.bincount(at, x, size)
        rest, mass = np.maximum(seen - add(n), 0), np.maximum(1 - add(shorter), 1e-12)
        own.alpha = (rest + mu * mass) / ((seen + mu) * mass)
        gained = add(n * np.log((n + mu * shorter) / (seen[context] + mu) / shorter)) + rest * np.log(own.alpha)
        entries = np.bincount(context, minlength=size)
        own.kept = (entries > 0) & (gained > gain * entries)
        keys, seen = _longer(tree, length, room, at_least(often))
    return tree


def _suffixes(tree: Tree, length: int, context: np.ndarray) -> list[np.ndarray]:
    """For contexts of a length, the numbers of their suffixes from length 1 up to one less."""
    out, room = [context], len(tree.words) + 1
    for level in range(length, 1, -1):
        out.append(tree.levels[level - 1].contexts[out[-1]] // room)
    return out[:0:-1]


def _longer(tree: Tree, length: int, room: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the contexts one word longer: pairs of a context of this length and its next symbol.

    A pair (f .. b) then s becomes the context f before the suffix (.. b s), which is found word by word from s back.
    """
    own, n_words = tree.levels[length - 1], max(1, len(tree.words))
    often = own.counts >= floor
    context, symbol, n = own.entries[often] // n_words, own.entries[often] % n_words, own.counts[often]
    back, at = [], context  # words of the context from the one furthest back
    for level in range(length, 1, -1):
        key = tree.levels[level - 1].contexts[at]
        back.append(key % room)
        at = key // room
    back.append(tree.levels[0].contexts[at])
    state = _find(tree.levels[0].contexts, symbol)
    for level, word in enumerate(back[:0:-1], start=2):
        state = np.where(state >= 0, _find(tree.levels[level - 1].contexts, word + np.maximum(state, 0) * room), -1)
    ok = state >= 0
    keys = back[0][ok] + state[ok] * room
    order = np.argsort(keys)
    return keys[order], n[ok][order]


def _probability(tree: Tree, found: list[np.ndarray], symbol: np.ndarray, mu: float) -> np.ndarray:
    """log10 probability of frequent symbols after contexts given by their numbers per length (-1: none)."""
    p, n_words = 10 ** tree.base[symbol], len(tree.words)
    for level, at in zip(tree.levels, found):
        if not len(level.contexts) or not len(level.entries):
            continue
        safe = np.maximum(at, 0)
        ok = (at >= 0) & level.kept[safe]
        entry = _find(level.entries, safe * n_words + symbol)
        smooth = (level.counts[np.maximum(entry, 0)] + mu * p) / (level.total[safe] + mu)
        p = np.where(ok, np.where(entry >= 0, smooth, level.alpha[safe] * p), p)
    return np.log10(p)


def log_probabilities(tree: Tree, ids: np.ndarray, mu: float = MU) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of every token at the root and in the tree; of rare words without their root's part, 0.

    A symbol has the smoothed probability at the longest retained suffix, which rests on those of shorter ones. A rare
    word is no entry of any state, so each retained state only multiplies its root probability by alpha.
    """
    base, own = np.zeros(len(ids)), np.zeros(len(ids))
    if not len(tree.words):
        return base, own
    found, rare = states(tree, ids, len(tree.levels)), ids < 0
    base[~rare] = tree.base[ids[~rare]]
    own[~rare] = _probability(tree, [x[~rare] for x in found], ids[~rare], mu)
    for level, at in zip(tree.levels, found):
        if len(level.contexts):
            factor = np.append(np.where(level.kept, np.log10(level.alpha), 0.0), 0.0)  # the last one for -1
            own[rare] += factor[at[rare]]
    return base, own


def score(docs: DataFrame, tree: Tree, counts: DataFrame, doc_id: str = "doc_id", text: str = "text",
          mu: float = MU) -> DataFrame:
    """One row per document row: doc_id, n_tokens, n_known, base_score, score (sums of log10 probabilities).

    base_score is the root's: sum of log10((c + 0.5) / (N + 0.5 (V + 1))) over the words and the end. Frequent words
    are scored where the text is read; the others are listed and joined with the counts, which are too many to hold. Rows are told apart by a number, so repeated and NULL ids keep their rows.
    """
    n_seen = math.log10(tree.train_tokens + 0.5 * (tree.vocabulary + 1))
    handle = docs.sparkSession.sparkContext.broadcast(tree)
    source = docs.select(F.col(doc_id).alias("id"), text)
    fields = [source.schema["id"], StructField("row", LongType()), StructField("n_tokens", LongType()),
              StructField("n_rare", LongType()), StructField("base", DoubleType()), StructField("own", DoubleType()),
              StructField("rare", ArrayType(BinaryType()))]
    schema = StructType(fields)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, model, row = to_arrow_schema(schema), handle.value, TaskContext.get().partitionId() << 40
        for few, flat, sizes in _batches(parts, 1):
            ids = model.ids(flat)
            starts = np.cumsum([0, *sizes[:-1]])
            sums = [np.add.reduceat(x, starts) for x in log_probabilities(model, ids, mu)]
            rare = np.flatnonzero(ids < 0)
            n_rare = np.add.reduceat(ids < 0, starts, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_rare)), pa.int32()),
                                             pa.array([flat[i] for i in rare.tolist()], pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [few.column(0), pa.array(np.arange(row, row + len(sizes))), pa.array(sizes, pa.int64()),
                 pa.array(n_rare), pa.array(sums[0]), pa.array(sums[1]), lists.cast(arrow[-1].type)], schema=arrow)
            row += len(sizes)

    first = stored(source.mapInArrow(read, schema), "scored")
    known = first.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    part = F.log10(F.coalesce("c", F.lit(0)) + 0.5) - F.lit(n_seen)
    extra = known.groupBy("row").agg(
        F.sum(part).alias("extra"), F.count("c").alias("seen"))
    out = first.join(extra, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        F.col("id").alias(doc_id), "n_tokens", (F.col("n_tokens") - F.col("n_rare") + zero("seen")).alias("n_known"),
        (F.col("base") + zero("extra")).alias("base_score"), (F.col("own") + zero("extra")).alias("score"))
