"""Benchmark decontamination: Wu-Manber search for all word windows of all items in all documents."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from propensity_spark.llm.common import discard, slices, stored

#: Items are searched in blocks of about so many bytes of text: what one worker holds at a time.
BLOCK_BYTES = 8 << 20
#: Lower-cases A-Z and turns every ASCII character that is no digit or letter into a space; bytes from 128 on stay.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text after A-Z are lower-cased."""
    return text.translate(WORD_BYTES).split()


class WuManber:
    """Tables over windows of one length: symbols are words, blocks are BLOCK words.

    shift: block -> how far the search may move when the text has this block at the window's end; a block that no
    window has lets it move by length - BLOCK + 1. A shift of 0 leads to the bucket of windows that end in the block,
    in which windows are found by their first block and then compared word by word.
    """

    def __init__(self, windows: dict[tuple[bytes, ...], list[int]], length: int):
        self.length, self.block = length, min(2, length)
        b = self.block
        self.far = length - b + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        for window, items in windows.items():
            for at in range(self.far):
                key = window[at:at + b]
                self.shift[key] = min(self.shift.get(key, self.far), self.far - 1 - at)
            self.buckets[window[-b:]][window[:b]].append((list(window), items))
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def search(self, text: list[bytes]):
        """(first word, items) of every occurrence, in order."""
        length, far, shift, buckets, n = self.length, self.far, self.shift, self.buckets, len(text)
        b, at = self.block, self.length - 1  # at: last word of the window under test
        while at < n:
            key = (text[at - 1], text[at]) if b == 2 else (text[at],)
            step = shift.get(key, far)
            if step:
                at += step
                continue
            first = at - length + 1
            for window, items in buckets[key].get(tuple(text[first:first + b]), ()):
                if text[first:at + 1] == window:
                    yield first, items
            at += 1


class Index:
    """The windows of some items: one Wu-Manber table per window length (13, and the lengths of shorter items)."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int):
        by_length: dict[int, dict[tuple, list[int]]] = defaultdict(dict)
        self.names = list(dict.fromkeys(name for name, _ in items))  # None for items without a name
        number = {name: i for i, name in enumerate(self.names)}
        for name, text in items:
            w = words(text)
            length = min(size, len(w))
            for at in range(len(w) - length + 1 if w else 0):
                found = by_length[length].setdefault(tuple(w[at:at + length]), [])
                if number[name] not in found[-1:]:
                    found.append(number[name])
        self.tables = [WuManber(windows, length) for length, windows in sorted(by_length.items())]

    def search(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged ranges [start, end) of hit words, and the items that occur."""
        ranges, items = [], set()
        for table in self.tables:
            for first, found in table.search(text):
                items.update(found)
                ranges.append((first, first + table.length))
        return merged(ranges), {self.names[i] for i in items} - {None}


def merged(ranges) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
NAMES = ["n_words", "n_hit", "items", "spans"]
TYPES = [LongType(), LongType(), ArrayType(StringType()), SPANS]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", size: int = 13,
    item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, names: list[str] | None = None,
) -> DataFrame:
    """The columns `keep` and n_words, n_hit, items (ids as text, sorted) and spans, or these under other `names`.

    A window is `size` consecutive words of an item; a shorter item, if not empty, is one window. A word of a document
    inside any occurrence of a window is hit; spans are the ranges [start, end) of hit words. The search is one pass
    over the documents without a shuffle. The benchmark's size is asked first: its distinct rows are dealt to blocks of
    about block_bytes, and the documents are searched for one block after another, the result so far being stored
    between, so a benchmark of any size is searched whole, one with a frequent id too. NULL texts have no words; items
    without id are searched like the others but cannot be named in `items`; all rows of an item are searched and count
    as one item; repeated documents keep their rows.
    """
    names = names or NAMES
    items = benchmark.select(F.col(item_id).cast("string").alias("id"),
                             F.coalesce(item_text, F.lit("")).cast("binary").alias("body")).distinct()
    total = items.agg(F.sum(F.length("body") + 64)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    placed = items.withColumn("block", F.pmod(F.xxhash64("id", "body"), F.lit(blocks)))
    columns = list(dict.fromkeys([*keep, text]))
    out, before = docs.select(*columns), None
    for block in range(blocks):
        rows = placed.where(F.col("block") == block).select("id", "body").collect()  # about block_bytes
        index = docs.sparkSession.sparkContext.broadcast(Index([(r[0], bytes(r[1])) for r in rows], size))
        out = _search(out, index, columns, text, names, more=block > 0)
        if block < blocks - 1:
            out = stored(out, "searched")
            if before is not None:
                discard(before)
            before = out
    return out.select(*keep, *names)


def _search(df: DataFrame, index, columns: list[str], text: str, names: list[str], more: bool) -> DataFrame:
    """Add the four result columns; with `more`, df has them from earlier blocks and they are added to."""
    at, n = columns.index(text), len(columns)
    schema = StructType([df.schema[c] for c in columns] + [StructField(c, t) for c, t in zip(names, TYPES)])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, tables = to_arrow_schema(schema), index.value
        for part in parts:
            for few in slices(part, at):
                made: list[list] = [[], [], [], []]
                known = zip(few.column(n + 2).to_pylist(), few.column(n + 3).to_pylist()) if more else None
                for body in few.column(at).cast(pa.binary()).to_pylist():
                    w = words(body or b"")
                    spans, found = tables.search(w)
                    if known:
                        old_items, old_spans = next(known)
                        found = found.union(old_items)
                        spans = merged([*spans, *((x["start"], x["end"]) for x in old_spans)])
                    for column, value in zip(made, (len(w), sum(b - a for a, b in spans), sorted(found), spans)):
                        column.append(value)
                made[3] = [[{"start": a, "end": b} for a, b in x] for x in made[3]]
                yield pa.RecordBatch.from_arrays(
                    [few.column(i) for i in range(n)] + [pa.array(x, f.type) for x, f in zip(made, list(arrow)[n:])],
                    schema=arrow)

    return df.mapInArrow(batches, schema)
