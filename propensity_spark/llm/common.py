"""What the operators of this package share: stored tables, Arrow mapping over texts, free column names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from propensity_spark.functions.session import scratch_path

#: Rows, and bytes of their texts, handed to a text function at once: what is held as Python objects at a time.
ROWS, BYTES = 256, 4 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a parquet table in the shared folder: its lineage ends there and every reader sees the same rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by stored() that no later plan reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(wanted: str, taken: list[str]) -> str:
    """`wanted`, or a longer name if a column (case-blind, as Spark resolves) has it already."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted = f"_{wanted}"
    return wanted


def fold(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 5; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def slices(part: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, at most ROWS and BYTES of text in `column` at a time; a longer text comes alone."""
    lengths = pc.fill_null(pc.binary_length(part.column(column)), 0)
    ends, start = np.cumsum(lengths.to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while start < part.num_rows:
        full = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BYTES, "right"))
        stop = min(max(start + 1, full), start + ROWS)
        yield part.slice(start, stop - start)
        start = stop


def map_texts(
    df: DataFrame, keep: list[str], text: str, run: Callable[[list[bytes]], list], fields: list[StructField]
) -> DataFrame:
    """The columns `keep` and the columns that run() makes of the texts (UTF-8; a NULL text is empty).

    run() gets some texts and returns one pyarrow array, or list, per field. No shuffle: one pass over df.
    """
    source = df.select(*keep) if text in keep else df.select(*keep, text)
    schema = StructType([source.schema[c] for c in keep] + fields)
    at = source.columns.index(text)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for part in parts:
            for few in slices(part, at):
                texts = [x or b"" for x in few.column(at).cast(pa.binary()).to_pylist()]
                made = [pa.array(x, f.type) if not isinstance(x, pa.Array) else x
                        for x, f in zip(run(texts), list(arrow)[len(keep):])]
                yield pa.RecordBatch.from_arrays([few.column(i) for i in range(len(keep))] + made, schema=arrow)

    return source.mapInArrow(batches, schema)
