"""A stored table by key that upserts change in part: buckets of the key, and snapshots of which files they are."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from propensity_spark.operators.governance import insert_absent, upsert
from propensity_spark.sources.snapshots import Snapshots

BUCKET = "_bucket"


class MergeTable:
    """Rows by a unique key in `buckets` parts, by the key's hash.

    A snapshot names the folder that holds each bucket and the batches that are in. A merge reads and writes the
    buckets its rows fall in, nothing else; the others' folders go on from the snapshot before. Readers of a snapshot
    see all of a merge or none of it. A merge of a batch that is in changes nothing, so a job may run twice. Of two
    writers at a time the later one keeps its files if the other wrote other buckets, else it merges again.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: StructType, buckets: int = 64):
        self.spark, self.folder, self.key, self.schema, self.buckets = spark, folder, key, schema, buckets
        self.snapshots = Snapshots(spark, f"{folder}/snapshots")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def state(self, number: int | None = None) -> dict:
        """{"buckets": {number: folder}, "batches": [...]} of a snapshot, by default the newest."""
        number = self.snapshots.newest() if number is None else number
        return json.loads(self.snapshots.read(number)) if number is not None else {"buckets": {}, "batches": []}

    def read(self, number: int | None = None) -> DataFrame:
        return self._rows(self.state(number)["buckets"])

    def _rows(self, folders: dict[str, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*sorted(f"{self.folder}/{f}" for f in folders.values()))

    def merge(self, incoming: DataFrame, batch: str, order: str, replace: bool = True) -> int | None:
        """Upsert `incoming` (its last row by `order` of each key), or with replace=False insert absent keys (the first
        row). Returns the new snapshot's number, None if the batch is in already."""
        rows = incoming.withColumn(BUCKET, self._bucket())
        touched = [str(r[0]) for r in rows.select(BUCKET).distinct().collect()]  # at most `buckets` numbers
        written: tuple[dict[str, str], dict[str, str]] | None = None

        def attempt(number: int | None) -> int | None:
            nonlocal written
            now = self.state(number) if number is not None else {"buckets": {}, "batches": []}
            if batch in now["batches"]:
                return None
            before = {b: now["buckets"][b] for b in touched if b in now["buckets"]}
            if written is None or written[0] != before:
                written = (before, self._write(self._merged(before, rows.drop(BUCKET), order, replace)))
            after = {"buckets": now["buckets"] | written[1], "batches": [*now["batches"], batch]}
            return self.snapshots.commit(json.dumps(after), number)

        return self.snapshots.retry(attempt)

    def _merged(self, before: dict[str, str], incoming: DataFrame, order: str, replace: bool) -> DataFrame:
        current = self._rows(before)
        new = incoming.select(*self.schema.names, *([order] if order not in self.schema.names else []))
        if replace:
            return upsert(current, new, self.key, order).select(*self.schema.names)
        return current.unionByName(insert_absent(current, new, self.key, order).select(*self.schema.names))

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Write rows in a folder of their own, a part per bucket; the folder of each bucket."""
        name = f"data-{uuid.uuid4().hex}"
        parts = rows.withColumn(BUCKET, self._bucket()).hint("rebalance", F.col(BUCKET))
        parts.write.partitionBy(BUCKET).parquet(f"{self.folder}/{name}")
        files = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        listed = files.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(files)
        found = [f.getPath().getName() for f in listed]
        return {f.removeprefix(f"{BUCKET}="): f"{name}/{f}" for f in found if f.startswith(BUCKET)}
