"""Cost-balanced packing of tokenised documents into training sequences."""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from propensity_spark.llm.bpe import encoder
from propensity_spark.llm.common import slices

#: Attention cost of a piece of n tokens: LINEAR * n for projections and feed-forward, QUADRATIC * n * n for scores.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Sequence ids are task << 40 | number in the task.
TASK_BITS = 40

PIECE = [StructField(c, LongType()) for c in
         ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


def capacities(tokens: int, size: int, last: bool) -> list[int]:
    """Full sequences; the tokens beyond them, if no more will come, in sequences of falling powers of two."""
    full, rest = divmod(tokens, size)
    tail = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return [size] * full + (tail if last else [])


def assign(lengths: list[int], rooms: list[int]) -> tuple[list[tuple], list[tuple]]:
    """Pieces (document, start, length, sequence, offset) that fill every room, and what is left (document, start, length).

    Documents go by falling cost to the sequence of lowest cost that has room for all of it. One that fits nowhere is
    cut: its head fills the sequence of lowest cost that has room, and what remains is dealt like a document of its
    length. Equal costs go by length, then by place in the input, so the result does not depend on chance.
    """
    waiting = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(waiting)
    room, spent = np.array(rooms, np.int64), np.zeros(len(rooms))
    used, pieces, left = [0] * len(rooms), [], sum(rooms)
    while waiting and left:
        n, doc, start = heapq.heappop(waiting)
        n = -n
        fits = room >= n
        s = int(np.argmin(np.where(fits if fits.any() else room > 0, spent, np.inf)))
        took = min(n, int(room[s]))
        pieces.append((doc, start, took, s, used[s]))
        used[s] += took
        room[s] -= took
        spent[s] += cost(took)
        left -= took
        if took < n:
            heapq.heappush(waiting, (took - n, doc, start + took))
    return pieces, sorted((doc, start, -n) for n, doc, start in waiting)


def pack(
    docs: DataFrame, tokenizer: str, end: int, doc_id: str = "doc_id", text: str = "text", size: int = 2048,
    block_tokens: int = 1 << 20,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text (NULL: empty) and the id `end`, so none is without tokens. Each task reads its
    rows once, gathers blocks of `block_tokens` tokens and packs each block by assign(); what does not fill a whole
    sequence moves into the next block, and the last block of a task ends in sequences of power-of-two length, so
    nothing is padded. No shuffle, and memory is one block, plus the longest document. Sequence ids depend on how the
    input is split into tasks. NULL or repeated ids are packed row by row like any others.
    """
    source = docs.select(doc_id, text)
    schema = StructType([source.schema[doc_id]] + PIECE)

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, bpe = to_arrow_schema(schema), encoder(tokenizer)
        numbers = itertools.count(TaskContext.get().partitionId() << TASK_BITS)
        keys, ids, left, total = [], [], [], 0  # of the block: ids of the documents, (doc, start, length) to place

        def emit(last: bool) -> pa.RecordBatch:
            nonlocal keys, ids, left, total
            rooms = capacities(total, size, last)
            pieces, rest = assign([n for _, _, n in left], rooms)
            names = list(itertools.islice(numbers, len(rooms)))
            out = []
            for item, begin, n, s, offset in pieces:
                doc, start, _ = left[item]
                start += begin
                crc = zlib.crc32(ids[doc][start:start + n].astype("<u4").tobytes())
                out.append((keys[doc], start, n, crc, len(ids[doc]), names[s], offset))
            kept = [(left[item][0], left[item][1] + begin, n) for item, begin, n in rest]
            docs_kept = {doc: i for i, doc in enumerate(dict.fromkeys(doc for doc, _, _ in kept))}
            keys, ids = [keys[d] for d in docs_kept], [ids[d] for d in docs_kept]
            left = [(docs_kept[d], start, n) for d, start, n in kept]
            total = sum(n for _, _, n in left)
            columns = list(zip(*out)) or [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for part in parts:
            for few in slices(part, 1):
                texts = [x or b"" for x in few.column(1).cast(pa.binary()).to_pylist()]
                for key, got in zip(few.column(0).to_pylist(), bpe.encode_batch(texts)):
                    keys.append(key)
                    ids.append(np.append(got, got.dtype.type(end)))
                    left.append((len(ids) - 1, 0, len(ids[-1])))
                    total += len(ids[-1])
                if total >= block_tokens:
                    yield emit(False)
        if left:
            yield emit(True)

    return source.mapInArrow(packed, schema)
