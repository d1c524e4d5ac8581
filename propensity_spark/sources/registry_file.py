"""The model registry document (JSON) as frames: one row per model, rule and audit entry, and its settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from propensity_spark.sources.schemas import REGISTRY
from propensity_spark.sources.snapshots import Snapshots

#: Parts of the document that are a single entry.
SINGLE = ["settings", "active_routing", "traffic_split"]
#: Parts that are many entries by id, by the name of their frame.
MANY = {"models": "models", "rule_models": "rule_models"}


def _kind(spark: SparkSession) -> StructType:
    return spark.createDataFrame([], REGISTRY).schema


def _by_place(a: Column, b: Column) -> Column:
    return F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)


def load_registry(spark: SparkSession, path: str, default_rules: DataFrame | None = None) -> dict[str, DataFrame]:
    """Frames `models`, `rule_models`, `audit`, and `settings`, `active_routing`, `traffic_split` of one row each.

    Missing rules are filled with `default_rules`; a missing single entry is a row of NULLs.
    """
    doc = spark.read.schema(REGISTRY).json(path, multiLine=True)

    def entries(name: str) -> DataFrame:
        # The key of the document is the id; entry order is kept as seq.
        rows = doc.select(F.posexplode(F.map_entries(name)).alias("seq", "entry"))
        return rows.select("seq", F.col("entry.key").alias("model_id"),
                           *[F.col(f"entry.value.{f}").alias(f)
                             for f in doc.schema[name].dataType.valueType.names if f != "model_id"])

    audit = doc.select(F.posexplode("audit_log").alias("seq", "entry")).select("seq", "entry.*")
    rules = entries("rule_models")
    if default_rules is not None and doc.filter(F.col("rule_models").isNull()).limit(1).count():
        rules = default_rules
    return {"models": entries("models"), "rule_models": rules, "audit": audit,
            **{name: doc.select(f"{name}.*") for name in SINGLE}}


def _document(frames: dict[str, DataFrame]) -> DataFrame:
    """The frames of load_registry() as the one row of a document.

    The document is configuration: every model, rule and audit entry of it is one JSON value.
    """
    spark = frames["models"].sparkSession
    kind = _kind(spark)

    def entry(frame: DataFrame, fields: list[str]) -> Column:
        return F.struct(*[F.col(f) if f in frame.columns else F.lit(None).alias(f) for f in fields])

    doc = spark.range(1).select(F.lit(1).alias("_one"))
    for name, frame_name in MANY.items():
        frame = frames[frame_name]
        value = entry(frame, kind[name].dataType.valueType.names).cast(kind[name].dataType.valueType)
        listed = F.array_sort(F.collect_list(F.struct("seq", "model_id", value.alias("value"))), _by_place)
        one = frame.agg(listed.alias("rows")).select(F.lit(1).alias("_one"), F.map_from_entries(F.transform(
            "rows", lambda r: F.struct(r["model_id"], r["value"]))).alias(name))
        doc = doc.join(one, "_one")
    audit = frames["audit"]
    value = entry(audit, kind["audit_log"].dataType.elementType.names).cast(kind["audit_log"].dataType.elementType)
    listed = F.array_sort(F.collect_list(F.struct("seq", value.alias("value"))), _by_place)
    doc = doc.join(audit.agg(listed.alias("rows")).select(
        F.lit(1).alias("_one"), F.transform("rows", lambda r: r["value"]).alias("audit_log")), "_one")
    for name in SINGLE:
        if name in frames:
            fields = kind[name].dataType
            one = frames[name].limit(1).select(F.lit(1).alias("_one"), entry(frames[name], fields.names).cast(fields)
                                               .alias(name))
            doc = doc.join(one, "_one", "left")
    return doc.drop("_one")


def save_registry(frames: dict[str, DataFrame], path: str) -> None:
    """Write the frames of load_registry() as one document that it reads back alike.

    For a registry that one writer at a time changes; several writers share a Registry.
    """
    _document(frames).coalesce(1).write.mode("overwrite").json(path)


class Registry:
    """A registry that several writers change at a time: numbered documents, each written once.

    A change is made on the newest document and committed under the next number, if no one else has taken it; else it
    is made again on what the other one wrote. So no entry is lost, readers never see half a document, and every
    earlier state can be read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.snapshots = spark, Snapshots(spark, folder)

    def at(self, number: int) -> dict[str, DataFrame]:
        return load_registry(self.spark, self.snapshots.path(number))

    def newest(self) -> int | None:
        return self.snapshots.newest()

    def commit(self, frames: dict[str, DataFrame], read: int | None) -> int:
        """Write frames that were made from document `read` (None: from nothing); Conflict if it is not the newest."""
        row = _document(frames).select(F.to_json(F.struct("*"))).first()
        return self.snapshots.commit(row[0], read)

    def update(self, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], tries: int = 20) -> int:
        """Commit change(newest document), made anew as often as another writer was first."""
        return self.snapshots.retry(lambda read: self.commit(change(self.at(read)), read), tries)

    def restore(self, number: int) -> int:
        """Commit an earlier document again, as it was."""
        return self.snapshots.retry(lambda read: self.snapshots.commit(self.snapshots.read(number), read))
