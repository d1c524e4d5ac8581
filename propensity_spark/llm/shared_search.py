"""Ranked lexical search for many items at once: what items share is summed once per document."""

from __future__ import annotations

import heapq
import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (BinaryType, IntegerType, LongType, StringType, StructField, StructType)

from propensity_spark.llm.common import free_name, slices, stored
from propensity_spark.llm.decontaminate import words

#: Items are mined for shared term sets in blocks of about so many bytes of text.
BLOCK_BYTES = 64 << 10
#: Plans of blocks that one pass over the documents evaluates, in bytes: what is broadcast.
PASS_BYTES = 32 << 20
#: Numbers in one matrix of a worker.
CELLS = 1 << 21


class Dag(NamedTuple):
    """How the scores of a block of items are summed up from those of its terms.

    Nodes are partial accumulators. The first ones are sums of terms (terms[starts[i]:starts[i + 1]]); the others, in
    `levels` of (first node, left, right), are sums of two earlier nodes; an item is the sum of the nodes
    operands[bounds[i]:bounds[i + 1]]. A term that an item repeats counts as often.
    """

    words: list[bytes]
    items: list[str]
    terms: np.ndarray
    starts: np.ndarray
    levels: list[tuple[int, np.ndarray, np.ndarray]]
    operands: np.ndarray
    bounds: np.ndarray
    nodes: int

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Items x documents, from terms x documents. Every accumulator is made once, whoever shares it."""
        acc = np.empty((self.nodes, weights.shape[1]), np.int64)
        acc[:len(self.starts)] = np.add.reduceat(weights[self.terms], self.starts, axis=0)
        for first, left, right in self.levels:
            np.add(acc[left], acc[right], out=acc[first:first + len(left)])
        return np.add.reduceat(acc[self.operands], self.bounds, axis=0)

    def additions(self) -> int:
        """Sums of two numbers per document."""
        pairs = sum(len(left) for _, left, _ in self.levels)
        return len(self.terms) - len(self.starts) + pairs + len(self.operands) - len(self.bounds)


def mine(items: list[tuple[str, list[bytes]]]) -> Dag:
    """The query-sharing DAG of (name, terms) items; items without terms are left out.

    Symbols are (term, how many times the item had it before). Symbols that the same items have become one node. Then
    the pair of nodes that most items share is replaced by a node of its own in all of them, again and again, until no
    two items share a pair.
    """
    items = [(name, terms) for name, terms in items if terms]
    owners: dict[tuple[bytes, int], list[int]] = defaultdict(list)
    for i, (_, terms) in enumerate(items):
        for term, n in Counter(terms).items():
            for k in range(n):
                owners[term, k].append(i)
    classes: dict[tuple[int, ...], list[bytes]] = defaultdict(list)
    for (term, _), who in owners.items():
        classes[tuple(who)].append(term)
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for t, _ in owners))}

    having: list[set[int]] = [set(who) for who in classes]
    level = [0] * len(having)
    uses: list[set[int]] = [set() for _ in items]
    for node, who in enumerate(having):
        for i in who:
            uses[i].add(node)
    shared = Counter(p for use in uses for p in combinations(sorted(x for x in use if len(having[x]) > 1), 2))
    heap = [(-n, p) for p, n in shared.items() if n > 1]
    heapq.heapify(heap)
    pairs: list[tuple[int, int]] = []
    while heap:
        n, (a, b) = heapq.heappop(heap)
        both = having[a] & having[b]
        if len(both) < 2:
            continue
        if len(both) < -n:  # counted before earlier merges
            heapq.heappush(heap, (-len(both), (a, b)))
            continue
        new = len(having)
        pairs.append((a, b))
        level.append(max(level[a], level[b]) + 1)
        having[a] -= both
        having[b] -= both
        having.append(both)
        met: Counter = Counter()
        for i in both:
            uses[i] -= {a, b}
            met.update(x for x in uses[i] if len(having[x]) > 1)
            uses[i].add(new)
        for x, count in met.items():
            if count > 1:
                heapq.heappush(heap, (-count, (x, new)))
    base = len(classes)
    order = sorted(range(len(pairs)), key=lambda k: level[base + k])
    place = {x: x for x in range(base)} | {base + k: base + at for at, k in enumerate(order)}
    levels = []
    for at, k in enumerate(order):
        if at == 0 or level[base + k] != level[base + order[at - 1]]:
            levels.append((base + at, [], []))
        levels[-1][1].append(place[pairs[k][0]])
        levels[-1][2].append(place[pairs[k][1]])
    runs = [[vocabulary[t] for t in terms] for terms in classes.values()]
    return Dag(
        list(vocabulary), [name for name, _ in items],
        np.array([t for run in runs for t in run], np.int64), _firsts(runs),
        [(f, np.array(a, np.int64), np.array(b, np.int64)) for f, a, b in levels],
        np.array([place[x] for use in uses for x in sorted(use)], np.int64), _firsts(uses), len(having))


def _firsts(groups: list) -> np.ndarray:
    return np.cumsum([0, *map(len, groups)])[:-1].astype(np.int64)


class Best:
    """The highest-scoring documents of each item so far; equal scores by id, NULL ids last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.score = np.zeros((items, top), np.int64)
        self.empty = np.zeros((items, top), bool)  # NULL ids
        self.ids = np.full((items, top), np.iinfo(np.int64).min)

    def add(self, scores: np.ndarray, ids: np.ndarray, empty: np.ndarray) -> None:
        last, last_id, last_empty = (x[:, -1:] for x in (self.score, self.ids, self.empty))
        sooner = (~empty & last_empty) | ((empty == last_empty) & (ids < last_id))
        better = (scores > last) | ((scores == last) & sooner)
        for i in np.flatnonzero(better.any(axis=1)):
            at = np.flatnonzero(better[i])
            s, d, e = (np.append(old[i], new) for old, new in ((self.score, scores[i, at]), (self.ids, ids[at]),
                                                               (self.empty, empty[at])))
            order = np.lexsort((d, e, -s))[:self.top]
            self.score[i], self.ids[i], self.empty[i] = s[order], d[order], e[order]


PLANS = StructType([StructField("block", LongType()), StructField("plan", BinaryType())])
COUNTS = StructType([StructField("term", IntegerType()), StructField("n", LongType()), StructField("words", LongType())])
HITS = StructType([StructField("key", StringType()), StructField("doc", LongType()), StructField("score", LongType())])


def _plans(queries: DataFrame, block_bytes: int) -> DataFrame:
    """(block, plan): the DAG of each block of distinct item texts, mined by a task of its own; a stored table."""
    total = queries.agg(F.sum(F.length("body") + 64)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        dag = mine([(k, words(bytes(b))) for k, b in sorted(zip(part["key"], part["body"]))])
        rows = [(int(part["block"].iloc[0]), pickle.dumps(tuple(dag)))] if dag.items else []
        return pd.DataFrame(rows, columns=PLANS.names)

    placed = queries.withColumn("block", F.pmod(F.xxhash64("body"), F.lit(blocks)))
    return stored(placed.groupBy("block").applyInPandas(run, PLANS), "plans")


def _counted(docs: DataFrame, number) -> DataFrame:
    """(term, n, words): documents that hold each term; under -1, documents with terms and all their terms."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        known, n, total = number.value, 0, 0
        df = np.zeros(len(known), np.int64)
        for part in parts:
            for few in slices(part, 1):
                for body in few.column(1).cast(pa.binary()).to_pylist():
                    w = words(body or b"")
                    n, total = n + bool(w), total + len(w)
                    df[[i for i in map(known.get, set(w)) if i is not None]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n)),
             pa.array(np.append(np.zeros(len(at), np.int64), total))], schema=to_arrow_schema(COUNTS))

    return docs.mapInArrow(run, COUNTS).groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _ranked(docs: DataFrame, number, dags, weights, n_docs: int, n_words: int, top: int) -> DataFrame:
    """(key, doc, score): per task, each item's best documents."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        known, w, plans = number.value, weights.value, [Dag(*p) for p in dags.value]
        places = [np.array([known[t] for t in dag.words], np.int64) for dag in plans]
        best = [Best(len(dag.items), top) for dag in plans]
        size = max(1, CELLS // max(1, len(known), *(dag.nodes for dag in plans)))
        for part in parts:
            for few in slices(part, 1):
                empty = np.array(few.column(0).is_null())
                ids = few.column(0).fill_null(0).to_numpy()
                bodies = few.column(1).cast(pa.binary()).to_pylist()
                for i in range(0, len(bodies), size):
                    table = np.zeros((len(known), len(bodies[i:i + size])), np.int64)
                    for j, body in enumerate(bodies[i:i + size]):
                        text = words(body or b"")
                        at, tf = np.unique([x for x in map(known.get, text) if x is not None], return_counts=True)
                        if len(at):
                            at = at.astype(np.int64)
                            length = 25 + 75 * len(text) * n_docs // n_words
                            table[at, j] = w[at] * (1000000000 * tf // (1000 * tf + 8 * length))
                    for dag, place, found in zip(plans, places, best):
                        found.add(dag.scores(table[place]), ids[i:i + size], empty[i:i + size])
        for dag, found in zip(plans, best):
            item, at = np.nonzero(found.score)
            if len(item):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dag.items[x] for x in item]), pa.array(found.ids[item, at], mask=found.empty[item, at]),
                     pa.array(found.score[item, at])], schema=to_arrow_schema(HITS))

    return docs.mapInArrow(run, HITS)


def search(
    docs: DataFrame, items: DataFrame, top: int = 10, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", rank: str = "rank", score: str = "score",
    block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """Each item's `top` highest-scoring documents: item_id, rank (from 1), doc_id, score.

    Terms are runs of ASCII letters and digits and of anything that is not ASCII, A-Z lower-cased, of whole texts; NULL
    texts have none. With N documents that have terms, L terms in all, n in a document, df documents that hold a term
    and tf of it in one: the term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), and the document's score is the sum
    of w * (10^9 tf div (1000 tf + 8 m)), m = 25 + 75 n N div L, over the item's terms, repeats included (BM25 with
    k1 = 0.8 and b = 0.75 in integers). Only scores above 0 are ranked, equal ones by ascending doc_id, an integer,
    NULL last. Every item row gets its own ranking, rows without item_id too; repeated documents are ranked each.

    Distinct item texts are dealt to blocks; a task mines each block's shared term sets into a DAG of partial sums. The
    plans are broadcast, as many as fit pass_bytes at a time, with two passes over the documents: one counts N, L and
    df, one makes each batch's accumulators along the DAG, once for all items that share them. A task keeps `top`
    documents per item, and these few are ranked. All documents are scored in full; nothing is cut off early.
    """
    spark = docs.sparkSession
    body = F.coalesce(item_text, F.lit("")).cast("binary")
    asked = stored(items.select(F.col(item_id).alias("item"), F.sha2(body, 256).alias("key"), body.alias("body")), "items")
    plans = _plans(asked.select("key", "body").dropDuplicates(["key"]), block_bytes)
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    hits = None
    for blocks in _passes(plans, pass_bytes):
        dags = [pickle.loads(bytes(r["plan"])) for r in plans.where(F.col("block").isin(blocks)).collect()]
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for dag in dags for t in dag[0]))}
        number = spark.sparkContext.broadcast(vocabulary)
        counts = {r["term"]: r for r in _counted(texts, number).collect()}  # of the terms of this pass
        n_docs, n_words = (counts[-1]["n"], counts[-1]["words"]) if counts else (0, 0)
        found = np.array([weight(n_docs, counts[i]["n"]) if i in counts else 0 for i in range(len(vocabulary))], np.int64)
        one = _ranked(texts, number, spark.sparkContext.broadcast(dags), spark.sparkContext.broadcast(found),
                      n_docs, n_words, top)
        hits = one if hits is None else hits.unionByName(one)
    if hits is None:
        hits = spark.createDataFrame([], HITS)
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return asked.select("item", "key").join(ranked, "key").select(
        F.col("item").alias(item_id), F.col("rank").alias(rank),
        F.col("doc").alias(free_name(doc_id, [item_id, rank, score])), F.col("score").alias(score))


def _passes(plans: DataFrame, pass_bytes: int) -> list[list[int]]:
    """Numbers of the blocks of each pass."""
    out: list[list[int]] = []
    room = 0
    for r in plans.select("block", F.length("plan").alias("size")).orderBy("block").toLocalIterator():
        if not out or r["size"] > room:
            out.append([])
            room = pass_bytes
        out[-1].append(r["block"])
        room -= r["size"]
    return out
