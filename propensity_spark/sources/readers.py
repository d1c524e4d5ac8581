"""Readers and writers: columnar files, a relational source, tab-separated bulk files, the scored-row log."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DecimalType, StringType

from propensity_spark.functions.session import scratch_path
from propensity_spark.sources.schemas import DRIVER_TABLES

NULL_TEXT = "\\N"


@dataclass(frozen=True)
class Tables:
    """The driver's parquet tables by name, each with its declared schema."""

    spark: SparkSession
    folder: str

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.schema(DRIVER_TABLES[name]).parquet(f"{self.folder}/{name}.parquet")


def key_predicates(key: str, bounds: list[str] | list[int] | list[float], collation: str = '"C"') -> list[str]:
    """Conditions that cut a table at key bounds: every row, NULL keys too, is in exactly one.

    Bounds that are numbers cut a numeric key. Bounds that are text cut a text key in the order of its bytes, which
    `collation` names in the database's SQL: the order a database sorts text in by default need not be that of the
    bounds here, and would read rows twice or not at all.
    """
    numeric = all(isinstance(b, (int, float, Decimal)) and not isinstance(b, bool) for b in bounds)
    if not numeric and not all(isinstance(b, str) for b in bounds):
        raise ValueError("bounds must be all numbers or all text")
    cuts = sorted(set(bounds), key=None if numeric else str.encode)
    if not cuts:
        return ["1 = 1"]
    name = key if numeric else f"{key} COLLATE {collation}"
    shown = [str(c) if numeric else "'" + c.replace("'", "''") + "'" for c in cuts]
    inner = [f"{name} >= {x} AND {name} < {y}" for x, y in zip(shown, shown[1:])]
    return [f"{name} < {shown[0]} OR {key} IS NULL", *inner, f"{name} >= {shown[-1]}"]


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str, bounds: list | tuple[int, int, int],
    collation: str = '"C"', **options: str
) -> DataFrame:
    """A relational table read in parallel; filters and column lists are pushed to the database.

    `bounds` is a list of key values to cut at, see key_predicates(), or (lowest, highest, parts) of a number.
    """
    if isinstance(bounds, tuple):
        lower, upper, parts = map(str, bounds)
        reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=lower,
                                                   upperBound=upper, numPartitions=parts, **options)
        return reader.load()
    return spark.read.jdbc(url, table, predicates=key_predicates(key, bounds, collation), properties=options)


def normalise(df: DataFrame) -> DataFrame:
    """Decimals to double and date or time columns to ISO text, the form results are handed out in."""
    out = []
    for field in df.schema:
        col = F.col(field.name)
        if isinstance(field.dataType, DecimalType):
            col = col.cast("double")
        elif field.dataType.typeName() in ("timestamp", "timestamp_ntz"):
            col = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        elif field.dataType.typeName() == "date":
            col = F.date_format(col, "yyyy-MM-dd")
        out.append(col.alias(field.name))
    return df.select(*out)


def save_tsv(df: DataFrame, path: str) -> None:
    r"""Bulk-load text: tab separated, NULL as \N, booleans t/f, tabs and line ends in values become spaces."""
    cols = []
    for field in df.schema:
        col = F.col(field.name)
        if isinstance(field.dataType, BooleanType):
            col = F.when(col, "t").when(~col, "f")
        elif isinstance(field.dataType, StringType):
            col = F.translate(col, "\t\n\r", "   ")
        cols.append(F.coalesce(col.cast("string"), F.lit(NULL_TEXT)).alias(field.name))
    rows = df.select(F.concat_ws("\t", *cols).alias("value"))
    rows.write.mode("overwrite").text(path)


def load_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read files written by save_tsv back into `schema`."""
    wanted = spark.createDataFrame([], schema).schema
    parts = F.split(F.col("value"), "\t", -1)
    cols = []
    for i, field in enumerate(wanted):
        text = F.get(parts, F.lit(i))
        text = F.when(text != NULL_TEXT, text)
        if isinstance(field.dataType, BooleanType):
            text = text == "t"
        cols.append(text.cast(field.dataType).alias(field.name))
    return spark.read.text(path).select(*cols)


def append_log(df: DataFrame, path: str, time: str = "timestamp") -> None:
    """Append scored or request rows to a log partitioned by day.

    Rows of a day are brought together first, so a day gets few files; a large day is split by its size.
    """
    rows = df.withColumn("day", F.to_date(time))
    rows.hint("rebalance", F.col("day")).write.mode("append").partitionBy("day").parquet(path)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """A table stored in buckets of `key`, sorted in each, in the warehouse or at `path`.

    Tables with the same number of buckets join on the key without a shuffle.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: for frames that several passes read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def preview(df: DataFrame, rows: int = 10, with_count: bool = False) -> tuple[list[str], DataFrame, int | None]:
    """Column names, a few rows, and the row count only when asked for."""
    return df.columns, df.limit(rows), df.count() if with_count else None


def flatten_list(df: DataFrame, column: str) -> DataFrame:
    """A list column as comma-separated text."""
    return df.withColumn(column, F.concat_ws(", ", F.col(column)))


def split_list(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.split(F.col(column), ", "))
