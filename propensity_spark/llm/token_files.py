"""Token ids in Arrow stream files of equal-length sequences."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from propensity_spark.llm.bpe import encoder
from propensity_spark.llm.common import free_name, slices

#: Sequences in a record batch of a file.
BATCH = 64
ROW = [StructField("file", StringType()), StructField("file_number", LongType()), StructField("begin", LongType()),
       StructField("n_tokens", LongType())]


def _stream(sink, size: int, kind: pa.DataType):
    """The writer of one file: batches of `ids`, size ids a row, and `mask`, true where an id is no padding."""
    schema = pa.schema([("ids", pa.list_(kind, size)), ("mask", pa.list_(pa.bool_(), size))])
    return pa.ipc.new_stream(sink, schema), schema


def write(
    docs: DataFrame, folder: str, tokenizer: str, end: int, doc_id: str = "doc_id", text: str = "text", size: int = 2048
) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; returns and stores the index of documents.

    The documents are dealt to tasks by ranges of doc_id and sorted; each task writes one file, an Arrow stream of
    record batches with fixed-size lists `ids` and `mask`, and only the last sequence of a file is padded (with 0,
    mask false). The index, a parquet table in folder/index, has a row per document: doc_id, file, file_number (files
    in order of doc_id), begin (its place in the file) and n_tokens. A text (NULL: empty) is followed by the id `end`.
    NULL ids come first; rows with equal ids are ordered by the hash of their texts, so a frequent id can be split. A
    task that runs twice writes a second file under a new name; only files that the index names count.
    """
    source = docs.select(doc_id, text)
    order = free_name("order", source.columns)
    # The ranges are of id and text hash; equal rows are alike, so it does not matter which comes first.
    source = source.withColumn(order, F.xxhash64(text))
    ranged = source.repartitionByRange(F.col(doc_id).asc_nulls_first(), order)
    ranged = ranged.sortWithinPartitions(F.col(doc_id).asc_nulls_first(), order).select(doc_id, text)
    schema = StructType([source.schema[doc_id]] + ROW)
    target = f"{folder}/ids"

    def written(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, bpe, context = to_arrow_schema(schema), encoder(tokenizer), TaskContext.get()
        kind, room = pa.from_numpy_dtype(bpe.type), BATCH * size
        name = f"ids-{context.partitionId():06d}-{context.taskAttemptId()}.arrow"
        store, path = fs.FileSystem.from_uri(target)
        store.create_dir(path, recursive=True)
        sink, writer, shape = None, None, None
        buffer, begin = [], 0

        def batch(ids: np.ndarray) -> pa.RecordBatch:
            rows = -(-len(ids) // size)
            full = np.zeros(rows * size, ids.dtype)
            full[:len(ids)] = ids
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), size) for x in
                     (full, np.arange(rows * size) < len(ids))]
            return pa.RecordBatch.from_arrays(lists, schema=shape)

        def flush(last: bool) -> None:
            nonlocal buffer
            ids = np.concatenate(buffer)
            stop = len(ids) if last else len(ids) - len(ids) % room
            for i in range(0, stop, room):
                writer.write_batch(batch(ids[i:min(stop, i + room)]))
            buffer = [ids[stop:]]

        for part in parts:
            for few in slices(part, 1):
                got = bpe.encode_batch([x or b"" for x in few.column(1).cast(pa.binary()).to_pylist()])
                if writer is None and got:
                    sink = store.open_output_stream(f"{path}/{name}")
                    writer, shape = _stream(sink, size, kind)
                for ids in got:
                    buffer += [ids, np.array([end], bpe.type)]
                lengths = np.array([len(x) + 1 for x in got], np.int64)
                starts = begin + np.cumsum(lengths) - lengths
                begin += int(lengths.sum())
                if buffer and sum(map(len, buffer)) >= room:
                    flush(False)
                n = few.num_rows
                yield pa.RecordBatch.from_arrays([
                    few.column(0), pa.array([name] * n), pa.array([context.partitionId()] * n, pa.int64()),
                    pa.array(starts), pa.array(lengths)], schema=arrow)
        if writer is not None:
            flush(True)
            writer.close()
            sink.close()

    ranged.mapInArrow(written, schema).write.parquet(f"{folder}/index")
    return index(docs.sparkSession, folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/index")


def sequences(folder: str, name: str) -> Iterator[pa.RecordBatch]:
    """The record batches of one file, in order; ids and mask are not copied where the file is on a local disk."""
    store, path = fs.FileSystem.from_uri(f"{folder}/ids/{name}")
    source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
    with source, pa.ipc.open_stream(source) as reader:
        yield from reader


class Sequences:
    """Sequence number k of all files in order, without reading those before it.

    A stream file has no footer. But a batch of equal-length sequences has one size in bytes, so the place of each
    follows from the first one's; the file is mapped and only the batch's message is looked at.
    """

    def __init__(self, spark: SparkSession, folder: str, size: int = 2048):
        # A row per file meets the driver.
        sums = index(spark, folder).groupBy("file_number").agg(F.first("file").alias("file"), F.sum("n_tokens").alias("n"))
        self.folder, self.files, self.firsts, total = folder, [], [], 0
        for r in sums.orderBy("file_number").collect():
            self.files.append(r["file"])
            self.firsts.append(total)
            total += -(-r["n"] // size)
        self.total = total

    def __len__(self) -> int:
        return self.total

    def __getitem__(self, k: int) -> tuple[pa.Array, pa.Array]:
        """(ids, mask) of sequence k: views of the mapped file where that is on a local disk."""
        if not 0 <= k < self.total:
            raise IndexError(k)
        at = bisect.bisect(self.firsts, k) - 1
        return read_sequence(self.folder, self.files[at], k - self.firsts[at])


def read_sequence(folder: str, name: str, k: int) -> tuple[pa.Array, pa.Array]:
    """(ids, mask) of the k-th sequence of one file."""
    store, path = fs.FileSystem.from_uri(f"{folder}/ids/{name}")
    source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
    schema = pa.ipc.open_stream(source).schema
    first = source.tell()
    if k >= BATCH:
        pa.ipc.read_message(source)
        place = first + (source.tell() - first) * (k // BATCH)
        if place >= source.size() - 8:  # the stream's end mark
            raise IndexError(k)
        source.seek(place)
    batch = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
    row = k % BATCH
    if row >= batch.num_rows:
        raise IndexError(k)
    size = schema.field("ids").type.list_size
    return tuple(batch.column(c).values.slice(row * size, size) for c in (0, 1))


def with_starts(table: DataFrame) -> DataFrame:
    """The index with `start`, the number of ids of all documents before: one row per file is summed up in order."""
    sums = table.groupBy("file_number").agg(F.sum("n_tokens").alias("sum"))
    before = Window.orderBy("file_number").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("file_number", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    return table.join(F.broadcast(sums), "file_number").withColumn("start", F.col("before") + F.col("begin"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the files: its id, start, n_tokens and ids_crc32 (of little-endian 32-bit ids).

    The index is dealt by file, so each task opens the files it was dealt one after another and walks through each
    once; a document may lie across sequences and batches.
    """
    table = with_starts(index(spark, folder))
    names = {"file", "file_number", "begin", "n_tokens", "sum", "before", "start"}
    key = next(c for c in table.columns if c not in names)
    files = max(1, table.select("file_number").distinct().count())
    dealt = table.select(key, "file_number", "file", "begin", "n_tokens", "start").repartition(files, "file_number")
    dealt = dealt.sortWithinPartitions("file_number", "begin")
    schema = StructType([table.schema[key], StructField("start", LongType()), StructField("n_tokens", LongType()),
                         StructField("ids_crc32", LongType())])

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, name, batches, have, at = to_arrow_schema(schema), None, None, None, 0
        for part in parts:
            crcs = []
            for file, begin, length in zip(*(part.column(i).to_pylist() for i in (2, 3, 4))):
                if file != name:
                    name, batches, have, at = file, sequences(folder, file), np.empty(0, np.uint16), 0
                crc, end = 0, begin + length
                while at < end:  # ids before `begin` are passed over
                    if not len(have):
                        batch = next(batches)
                        mask = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                        have = batch.column(0).flatten().to_numpy()[mask]
                    some, have = have[:end - at], have[end - at:]
                    crc = zlib.crc32(some[max(0, begin - at):].astype("<u4").tobytes(), crc)
                    at += len(some)
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(5), part.column(4), pa.array(crcs, pa.int64())], schema=arrow)

    return dealt.mapInArrow(read, schema)
