"""Indexes of stored tables: pages of a total order, and substring search, without reading the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from propensity_spark.operators.search import as_text, check_allowed, ordering, search_any

RANGE, ROW = "_range", "_row"


def _read(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows of a folder; with its schema given, no file is opened to plan a query."""
    return spark.read.schema(schema).parquet(folder)


def _with(schema: StructType, **more: str) -> StructType:
    return StructType([*schema.fields, *[StructField(n, {"long": LongType(), "int": IntegerType(), "text": StringType()}[t])
                                         for n, t in more.items()]])


class PageIndex:
    """A table stored in consecutive ranges of a total order, with the number of rows in each.

    A page reads the one or two ranges it lies in, whatever its number; `offset` would sort and drop all rows before
    it. The index has a row per range, a few hundred thousand rows of the table each.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, sort: list[tuple[str, bool]], key: str):
        self.spark, self.folder, self.sort, self.key = spark, folder, sort, key
        self._schema = _with(schema, **{RANGE: "int"})

    def _rows(self) -> DataFrame:
        return _read(self.spark, f"{self.folder}/rows", self._schema)

    def _sizes(self) -> DataFrame:
        return _read(self.spark, f"{self.folder}/ranges", _with(StructType(), **{RANGE: "int"}, count="long"))

    @classmethod
    def build(cls, df: DataFrame, folder: str, sort: list[tuple[str, bool]], key: str, ranges: int) -> PageIndex:
        """Store df in about `ranges` ranges of the order by `sort` (column, descending), made total by the unique
        column `key`, so that a frequent value is cut as well."""
        for c, _ in sort:
            check_allowed(c, df.columns)
        parts = df.repartitionByRange(ranges, *ordering(sort, key)).withColumn(RANGE, F.spark_partition_id())
        parts.write.partitionBy(RANGE).parquet(f"{folder}/rows")
        index = cls(df.sparkSession, folder, df.schema, sort, key)
        index._rows().groupBy(RANGE).count().coalesce(1).write.parquet(f"{folder}/ranges")
        return index

    def page(self, number: int = 1, size: int = 100) -> DataFrame:
        """The same rows as search.page(df, sort, key, number, size)."""
        rows, skip = self._rows(), (number - 1) * size
        before, wanted, left = 0, [], skip
        for r in self._sizes().orderBy(RANGE).collect():
            if before + r["count"] > skip and before < skip + size:
                if not wanted:
                    left = skip - before
                wanted.append(r[RANGE])
            before += r["count"]
        found = rows.where(F.col(RANGE).isin(wanted)).drop(RANGE)
        return found.orderBy(*ordering(self.sort, self.key)).offset(left).limit(size)


def _grams(text: Column) -> Column:
    """The distinct runs of three characters; the text is walked once."""
    chars = F.split(text, "")
    at = F.sequence(F.lit(0), F.length(text) - 3)
    grams = F.transform(at, lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2)))
    return F.when(F.length(text) >= 3, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def _pieces(pattern: str) -> list[str]:
    """The literal pieces of a pattern between its wildcards % and _; a backslash takes the next character as it is."""
    out, literal = [""], False
    for c in pattern:
        if literal or c not in "%_\\":
            out[-1] += c
            literal = False
        elif c == "\\":
            literal = True
        else:
            out.append("")
    return out


class TextIndex:
    """Substring search over the columns of a stored table by posting lists of trigrams.

    Rows with all trigrams of what is looked for, in whatever column, are candidates; only the files that hold
    candidates are read, and search_any() decides. A text, or literal pieces of a pattern, of less than three
    characters have no trigram, and the table is scanned.
    """

    #: Parts of the posting table, and trigrams of a text that are looked up at most (more could only rule out more).
    PARTS, LOOKUPS = 64, 12

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, columns: list[str]):
        self.spark, self.folder, self.columns = spark, folder, columns
        self._schema = _with(schema, **{ROW: "long", RANGE: "long"})

    def _rows(self) -> DataFrame:
        return _read(self.spark, f"{self.folder}/rows", self._schema)

    @classmethod
    def build(cls, df: DataFrame, folder: str, columns: list[str], rows_per_range: int = 1 << 16) -> TextIndex:
        """Store df and its posting lists: a row per row and distinct trigram, dealt by the trigram's hash."""
        # The order of a partition's rows makes the number; it is stored, so it may differ from run to run.
        numbered = df.withColumn(ROW, F.monotonically_increasing_id())
        width = F.lit(rows_per_range).cast("bigint")
        numbered.withColumn(RANGE, F.floor(F.col(ROW) / width)).write.partitionBy(RANGE).parquet(f"{folder}/rows")
        index = cls(df.sparkSession, folder, df.schema, columns)
        texts = [F.lower(F.coalesce(as_text(df, c), F.lit(""))) for c in columns]
        each = index._rows().select(ROW, RANGE, F.explode(F.array_distinct(F.flatten(F.array(*[_grams(t) for t in texts])))).alias("gram"))
        part = F.pmod(F.xxhash64("gram"), F.lit(cls.PARTS)).cast("int").alias("part")
        dealt = each.select(ROW, RANGE, "gram", part).hint("rebalance", F.col("part")).sortWithinPartitions("part", "gram")
        dealt.write.partitionBy("part").parquet(f"{folder}/postings")
        return index

    def _lookups(self, text: str, wildcards: bool) -> list[str]:
        shown = self.spark.range(1).select(F.lower(F.lit(text))).first()[0]
        pieces = _pieces(shown) if wildcards else [shown]
        grams = sorted({p[i:i + 3] for p in pieces for i in range(len(p) - 2)})
        return grams[::max(1, -(-len(grams) // self.LOOKUPS))]

    def candidates(self, grams: list[str]) -> DataFrame:
        """(row, range) of the rows that have all these trigrams: an intersection of their posting lists."""
        schema = _with(StructType(), **{ROW: "long", RANGE: "long"}, gram="text", part="int")
        postings = _read(self.spark, f"{self.folder}/postings", schema)
        parts = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(
            F.pmod(F.xxhash64("gram"), F.lit(self.PARTS))).distinct().collect()
        few = postings.where(F.col("part").isin([r[0] for r in parts]) & F.col("gram").isin(grams))
        return few.groupBy(ROW, RANGE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select(ROW, RANGE)

    def search(self, text: str, wildcards: bool = False) -> DataFrame:
        """search_any(df, text, columns, wildcards) over the stored rows."""
        rows = self._rows()
        grams = self._lookups(text, wildcards)
        if grams:
            found = self.candidates(grams)
            ranges = [r[0] for r in found.select(RANGE).distinct().collect()]  # a number per 65,536 rows at most
            rows = rows.where(F.col(RANGE).isin(ranges)).join(found.select(ROW), ROW, "left_semi")
        return search_any(rows, text, self.columns, wildcards).drop(ROW, RANGE)
