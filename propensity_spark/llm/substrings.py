"""Substring dedup: passages that occur earlier in the corpus, found with suffix automata of reference shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, IntegerType, LongType, StringType, StructField,
                               StructType)

from propensity_spark.llm.common import discard, slices, stored

#: Words of reference text that one automaton is built of.
SHARD_WORDS = 1 << 16
#: Windows of a span; a longer run is cut into several.
SPAN = 1 << 12
#: An odd number, so that products with it are one to one.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def automaton(spans: list[list[int]]) -> tuple[list[dict[int, int]], list[int], list[int], list[int]]:
    """Suffix automaton of all spans: transitions, suffix links, lengths, first end positions of the states.

    Positions count the symbols of all spans in order. Every span starts at the root, so none runs into the next one;
    what is already known follows the transitions that are there.
    """
    step: list[dict[int, int]] = [{}]
    link, length, first = [-1], [0], [-1]

    def clone(p: int, c: int, q: int) -> int:
        """A state for the strings of q that p reaches by c; q keeps the longer ones."""
        new = len(length)
        length.append(length[p] + 1)
        step.append(step[q].copy())
        link.append(link[q])
        first.append(first[q])
        link[q] = new
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = new
            p = link[p]
        return new

    at = 0
    for span in spans:
        last = 0
        for c in span:
            q = step[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else clone(last, c, q)
            else:
                new = len(length)
                length.append(length[last] + 1)
                step.append({})
                first.append(at)
                p = last
                while p >= 0 and c not in step[p]:
                    step[p][c] = new
                    p = link[p]
                if p < 0:
                    link.append(0)
                else:
                    q = step[p][c]
                    link.append(0)  # the clone below must not take this place
                    link[new] = q if length[q] == length[p] + 1 else clone(p, c, q)
                last = new
            at += 1
    return step, link, length, first


def first_windows(spans: list[list[int]], window: int) -> list[np.ndarray]:
    """For every window of every span, whether it occurs there for the first time in all the spans.

    Each span streams through the automaton of them all. The matching statistic, the length of the longest known
    string that ends at a word, is held at `window`; the state then stands for the window that ends there, and knows
    where that ended first.
    """
    step, link, length, first = automaton(spans)
    out, at = [], 0
    for span in spans:
        new = np.zeros(max(0, len(span) - window + 1), bool)
        state = matched = 0
        for i, c in enumerate(span):
            state = step[state][c]
            matched += 1
            if matched >= window:
                matched = window
                while length[link[state]] >= window:
                    state = link[state]
                new[i - window + 1] = first[state] == at
            at += 1
        out.append(new)
    return out


def _sliding(op, a: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        a, size = op(a[:-size], a[size:]), size * 2
    return op(a[:size - width], a[width - size:]) if size < width else a


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * FACTOR
    return h ^ (h >> np.uint64(32))


class Anchors:
    """The windows of some texts and their anchors, all texts at once.

    A word's hash is a polynomial of its bytes, from running sums over the bytes of all texts; a run is two fifths of
    a window's words, and a window's anchor the least hash of a run in it. Equal windows have equal anchors. Different
    ones may have the same, which only makes them be compared.
    """

    def __init__(self, texts: list[bytes], window: int):
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        edges = np.flatnonzero(np.diff(IS_SPACE[data].astype(np.int8), prepend=np.int8(1)))
        starts, ends = edges[::2], edges[1::2]  # data ends in a space
        powers = np.empty(len(data) + 1, np.uint64)
        powers[0] = 1
        powers[1:] = FACTOR
        np.cumprod(powers, out=powers)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * powers[:-1], out=sums[1:])
        # A word's sum is divided by the power it starts with, so that it does not depend on where the word stands.
        back = np.uint64(pow(int(FACTOR), -len(data), 1 << 64))
        word = _mixed((sums[ends] - sums[starts]) * powers[len(data) - starts] * back)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        #: First word of every text, and their number.
        self.first = np.searchsorted(starts, offsets)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.first))
        k = max(1, 2 * window // 5)
        n = max(0, len(word) - window + 1)
        runs = np.zeros(max(0, len(word) - k + 1), np.uint64)
        for j in range(k if len(runs) else 0):
            runs = runs * FACTOR + word[j:j + len(runs)]
        self.runs = _mixed(runs)
        #: Whether a window lies in one text, its anchor, and the first word's text.
        self.inside = self.owner[:n] == self.owner[window - 1:]
        self.least = _sliding(np.minimum, self.runs, window - k + 1) if n else np.zeros(0, np.uint64)
        self.width = window - k

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, anchor) of every run that is the anchor of some window."""
        if not len(self.least):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        wide = np.zeros(self.width, np.uint64)
        most = _sliding(np.maximum, np.concatenate([wide, np.where(self.inside, self.least, np.uint64(0)), wide]),
                        self.width + 1)
        at = np.flatnonzero(most == self.runs)
        return self.owner[at], self.runs[at].view(np.int64)

    def spans(self, found: np.ndarray, homes: np.ndarray, shards: int) -> list[list[tuple[int, int, int]]]:
        """For every text (first window, number of windows, shard) of the runs of windows whose anchors are among
        `found` (ascending, with their homes), by shard."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(self.first) - 1)]
        if not len(found) or not len(self.least):
            return out
        least = self.least.view(np.int64)
        at = np.minimum(np.searchsorted(found, least), len(found) - 1)
        shard = _mixed(homes[at].view(np.uint64)) % np.uint64(shards)
        shard = np.where(self.inside & (found[at] == least), shard.astype(np.int64), -1)
        text = self.owner[:len(shard)]
        new = np.append(True, (shard[1:] != shard[:-1]) | (text[1:] != text[:-1]))
        edges = np.append(np.flatnonzero(new), len(shard))
        for i in np.flatnonzero(shard[edges[:-1]] >= 0):
            a, b = int(edges[i]), int(edges[i + 1])
            t = int(text[a])
            first = int(self.first[t])
            out[t] += [(j - first, min(j + SPAN, b) - j, int(shard[a])) for j in range(a, b, SPAN)]
        return out


RUNS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("n", IntegerType()),
                              StructField("shard", IntegerType())]))
ANCHORS = StructType([StructField("key", LongType()), StructField("anchor", LongType())])


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _texts(few: pa.RecordBatch, at: int) -> list[bytes]:
    return [x or b"" for x in few.column(at).cast(pa.binary()).to_pylist()]


def _anchored(rows: DataFrame, window: int) -> DataFrame:
    """(key, anchor) of every place of a text that is a window's anchor."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(ANCHORS)
        for part in parts:
            for few in slices(part, 1):
                owner, anchor = Anchors(_texts(few, 1), window).places()
                yield pa.RecordBatch.from_arrays([few.column(0).take(pa.array(owner)), pa.array(anchor)], schema=arrow)

    return rows.select("key", "body").mapInArrow(run, ANCHORS)


def _cut(docs: DataFrame, window: int, shards: int) -> DataFrame:
    """Add the spans of every body, from its array `anchors` of (anchor, home), NULL where it has none, which goes."""
    columns = [c for c in docs.columns if c != "anchors"]
    schema = StructType([docs.schema[c] for c in columns] + [StructField("spans", SPANS)])
    body, n = columns.index("body"), len(columns)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        for part in parts:
            for few in slices(part, body):
                # An anchor has one home, whichever text it is listed for.
                pairs = few.column(n).flatten()
                found, at = np.unique(pairs.field(0).to_numpy(), return_index=True)
                homes = pairs.field(1).to_numpy()[at]
                listed, texts = few.column(n).is_valid().to_pylist(), _texts(few, body)
                spans = Anchors([t if x else b"" for t, x in zip(texts, listed)], window).spans(found, homes, shards)
                made = [[{"start": a, "n": m, "shard": s} for a, m, s in x] for x in spans]
                yield pa.RecordBatch.from_arrays(
                    [few.column(i) for i in range(n)] + [pa.array(made, arrow[n].type)], schema=arrow)

    return docs.select(*columns, "anchors").mapInArrow(run, schema)


def _span_texts(cut: DataFrame, window: int) -> DataFrame:
    """(id, key, shard, start, digest, words, body) of every span."""
    schema = StructType([cut.schema["id"], cut.schema["key"], StructField("shard", IntegerType()),
                         StructField("start", IntegerType()), StructField("digest", BinaryType()),
                         StructField("words", LongType()), StructField("body", BinaryType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        for part in parts:
            for few in slices(part, 2):
                made: list[list] = [[], [], [], [], [], []]
                for i, (text, spans) in enumerate(zip(_texts(few, 2), few.column(3).to_pylist())):
                    w = text.split()
                    for s in spans:
                        some = w[s["start"]:s["start"] + s["n"] + window - 1]
                        span = b" ".join(some)
                        for column, value in zip(made, (i, s["shard"], s["start"], hashlib.md5(span).digest(),
                                                        len(some), span)):
                            column.append(value)
                at = pa.array(made[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [few.column(0).take(at), few.column(1).take(at)]
                    + [pa.array(c, f.type) for c, f in zip(made[1:], list(arrow)[2:])], schema=arrow)

    return cut.select("id", "key", "body", "spans").mapInArrow(run, schema)


def _runs(flags: np.ndarray, offset: int) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))) + offset
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def _first_in_chunk(spans: DataFrame, window: int) -> DataFrame:
    """(id, key, runs, digests): the windows [start, end) of every span that are the first of their kind in its chunk.

    Where a shard has several chunks, digests has those windows' digests in order, so that they can be compared.
    """
    schema = StructType([spans.schema["id"], spans.schema["key"], StructField("runs", RUNS),
                         StructField("digests", ArrayType(BinaryType()))])

    def run(part: pa.Table) -> pa.Table:
        spans = sorted(part.to_pylist(), key=lambda r: (r["id"] is None, 0 if r["id"] is None else r["id"], r["start"],
                                                        r["key"]))
        number: dict[bytes, int] = {}
        texts = [r["body"].split() for r in spans]
        coded = [[number.setdefault(w, len(number)) for w in t] for t in texts]
        made: list[list] = [[], [], [], []]
        for r, text, new in zip(spans, texts, first_windows(coded, window)):
            if new.any():
                digests = [hashlib.md5(b" ".join(text[i:i + window])).digest() for i in np.flatnonzero(new)] \
                    if r["chunks"] > 1 else None
                for column, value in zip(made, (r["id"], r["key"], _runs(new, r["start"]), digests)):
                    column.append(value)
        arrow = _arrow(schema)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(made, arrow)], schema=arrow)

    return spans.groupBy("shard", "chunk").applyInArrow(run, schema)


def _place(start: str = "start") -> Column:
    """Sorts like the corpus: by id, NULL last, then by place; texts that share an id and a place by their hash."""
    return F.struct(F.col("id").isNull().alias("none"), "id", F.col(start).alias("start"), "key")


def _beaten(new: DataFrame) -> DataFrame:
    """(id, key, start) of windows that are first in their chunk, but not in all chunks of the shard."""
    starts = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["end"] - 1)))
    each = new.where(F.col("digests").isNotNull()).select(
        "id", "key", F.inline(F.arrays_zip(starts.alias("start"), F.col("digests").alias("digest"))))
    best = each.groupBy("digest").agg(F.min(_place()).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    best = stored(best.select("digest", "best"), "windows")  # a table, so that a frequent digest can be split
    return each.join(best, "digest").where(_place() > F.col("best")).select("id", "key", "start")


def _finish(rows: DataFrame, names: list[str], taken: list[str], window: int) -> DataFrame:
    """names, n_words, removed, kept of rows with a body, and lists of spans, first windows and beaten ones."""
    columns = [f"_keep{i}" for i in range(len(names))]
    schema = StructType([rows.schema[c] for c in columns] + [
        StructField("n_words", LongType()), StructField("removed", RUNS), StructField("kept", StringType())])
    n, full = len(columns), "spans" in rows.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        for part in parts:
            for few in slices(part, n):
                made: list[list] = [[], [], []]
                lists = [few.column(n + 1 + j).to_pylist() for j in range(3)] if full else None
                for i, text in enumerate(_texts(few, n)):
                    runs: list[dict] = []
                    w = text.split()
                    if lists:
                        spans, new, beaten = ((x[i] or []) for x in lists)
                        drop = np.zeros(len(w) + 1, bool)  # windows to remove
                        for s in spans:
                            drop[s["start"]:s["start"] + s["n"]] = True
                        for r in new:
                            drop[r["start"]:r["end"]] = False
                        drop[beaten] = True
                        edge = np.zeros(len(w) + window + 1, np.int64)
                        at = np.flatnonzero(drop)
                        edge[at] += 1
                        edge[at + window] -= 1
                        gone = np.cumsum(edge)[:len(w)] > 0
                        runs = _runs(gone, 0)
                        w, total = [x for x, g in zip(w, gone.tolist()) if not g], len(w)
                    else:
                        total = len(w)
                    for column, value in zip(made, (total, runs, b" ".join(w))):
                        column.append(value)
                made[2] = pa.array(made[2], pa.binary()).cast(pa.string(), safe=False)
                yield pa.RecordBatch.from_arrays(
                    [few.column(i) for i in range(n)] + [x if isinstance(x, pa.Array) else pa.array(x, f.type)
                                                         for x, f in zip(made, list(arrow)[n:])], schema=arrow)

    out = rows.select(*columns, "body", *(["spans", "new", "beaten"] if full else [])).mapInArrow(run, schema)
    return out.select(*[F.col(c).alias(name) for c, name in zip(columns, names)],
                      *[F.col(c).alias(t) for c, t in zip(("n_words", "removed", "kept"), taken)])


def remove_repeats(
    docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", window: int = 20,
    shard_words: int = SHARD_WORDS, names: tuple[str, str, str] = ("n_words", "removed", "kept"),
) -> DataFrame:
    """The columns `keep`, n_words, removed (ranges [start, end) of words) and kept (the other words, one space between).

    Words are runs of anything but ASCII space and tab to carriage return, unchanged, of whole texts; NULL has none. A
    window is `window` consecutive words of one document. Every word is removed that lies in a window whose words also
    start earlier: in a document with a smaller id, or before in the same one; windows are judged on the input. So of
    a passage of at least `window` words the first occurrence stays and every other one goes. NULL ids come last. Of
    documents with the same id the earlier start comes first, at equal starts the lesser hash of the text; rows that
    are equal are one document.

    Only what may occur twice is compared. A window's anchor is the least hash among its runs of words; anchors that
    the corpus has at one place only have no equal windows, and counting them is one shuffle of about a seventh as
    many rows as there are words. The runs of other windows, spans, are the reference; a span goes to the shard of
    its anchors' home, which is the same for equal windows. Equal spans are combined, the first of them stays. Of each
    shard's spans a task builds a suffix automaton and streams them through it for matching statistics: where the
    match is as long as a window, the state says where that window ended first. A shard of more than shard_words is
    dealt to several automata by its spans' digests, and what is first in one of them is compared with the others by
    digest, so no hot passage or group of near copies gathers in a task, and work grows with the spans. A worker holds
    a few megabytes of texts at a time, a longer text alone, and some forty bytes for each of their bytes.
    """
    known = [f"_keep{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, known)], F.col(doc_id).alias("id"),
                       F.xxhash64(F.col(doc_id), F.col(text)).alias("key"), F.col(text).cast("binary").alias("body"))
    counted = _anchored(rows, window).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("home"))
    twice = stored(counted.where("n > 1"), "anchors")
    places = twice.agg(F.sum("n")).first()[0] or 0
    shards = max(1, int(places) * window // 3 // shard_words)  # an anchor stands for about a third of a window
    of_doc = _anchored(rows, window).join(twice.select("anchor", "home").hint("merge"), "anchor")
    lists = stored(of_doc.groupBy("key").agg(F.collect_set(F.struct("anchor", "home")).alias("anchors")), "lists")
    # The one shuffle of whole texts, the same at every size.
    every = stored(_cut(rows.join(lists.hint("merge"), "key", "left"), window, shards), "cut")
    discard(lists)
    cut, plain = every.where(F.size("spans") > 0), every.where(F.size("spans") == 0).drop("spans")

    spans = _span_texts(cut, window).groupBy("shard", "digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "start", "key", "words", "body")).alias("first"))
    spans = stored(spans.select("shard", "digest", "first.id", "first.start", "first.key", "first.words", "first.body"),
                   "spans")
    sizes = stored(spans.groupBy("shard").agg(
        F.ceil(F.sum("words") / shard_words).cast("int").alias("chunks")), "sizes")
    dealt = spans.join(sizes, "shard").withColumn("chunk", F.pmod(F.xxhash64("digest"), F.col("chunks")))
    new = stored(_first_in_chunk(dealt, window), "first")
    beaten = stored(_beaten(new).groupBy("id", "key").agg(F.collect_set("start").alias("beaten")), "beaten")
    news = stored(new.groupBy("id", "key").agg(F.flatten(F.collect_list("runs")).alias("new")), "new")

    def same(other: DataFrame) -> Column:
        return cut["id"].eqNullSafe(other["id"]) & (cut["key"] == other["key"])

    judged = cut.join(news.hint("merge"), same(news), "left").join(beaten.hint("merge"), same(beaten), "left").select(
        *[cut[c] for c in known], cut["body"], "spans", "new", "beaten")
    return _finish(plain, keep, list(names), window).unionByName(_finish(judged, keep, list(names), window))
