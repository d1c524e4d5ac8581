"""Search over any column, sorting, paging, request-log listing and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from propensity_spark.functions.scalar import any_of, as_int, contains_text, is_true, iso, ratio

LOG_SEARCH_COLUMNS = ["username", "user_role", "endpoint", "method", "status_code", "payload_summary"]


def as_text(df: DataFrame, name: str) -> Column:
    """The text a value is searched in; doubles are shown with two decimals."""
    col = F.col(name)
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        col = col.cast("decimal(18,2)")
    return col.cast("string")


def search_any(df: DataFrame, text: str, columns: list[str] | None = None, wildcards: bool = False) -> DataFrame:
    """Rows in which any of the columns contains `text`, ignoring case. Empty text keeps every row."""
    if not text:
        return df
    hits = [is_true(contains_text(as_text(df, c), text, wildcards)) for c in columns or df.columns]
    return df.filter(any_of(hits))


def check_allowed(value: str, allowed) -> str:
    if value not in allowed:
        raise ValueError(f"not allowed: {value!r}")
    return value


def ordering(sort: list[tuple[str, bool]], key: str) -> list[Column]:
    """Sort keys (column, descending) with NULLs last ascending and first descending, made total by `key`."""
    out = [F.col(c).desc_nulls_first() if desc else F.col(c).asc_nulls_last() for c, desc in sort]
    return out + ([F.col(key).asc_nulls_last()] if key not in [c for c, _ in sort] else [])


def page(df: DataFrame, sort: list[tuple[str, bool]], key: str, number: int = 1, size: int = 100) -> DataFrame:
    """One page of a total order. Spark keeps only the top rows of each task; no full sort."""
    for c, _ in sort:
        check_allowed(c, df.columns)
    return df.orderBy(*ordering(sort, key)).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, column: str, key: str, last: tuple, size: int = 100) -> DataFrame:
    """The page after the row (column, key) = `last`, ascending; its cost does not grow with the page number."""
    value, unique = F.lit(last[0]), F.lit(last[1])
    later = (F.col(column) > value) | ((F.col(column) == value) & (F.col(key) > unique))
    return page(df.filter(later), [(column, False)], key, 1, size)


def log_page(log: DataFrame, search: str = "", number: int = 1, size: int = 100) -> DataFrame:
    """Newest-first listing of the request log, the time as ISO text with Z."""
    found = search_any(log, search.strip(), LOG_SEARCH_COLUMNS)
    rows = found.orderBy(F.col("timestamp").desc_nulls_first(), F.col("log_id").desc())
    rows = rows.offset((number - 1) * size).limit(size)
    return rows.withColumn("timestamp", F.concat(iso(F.col("timestamp")), F.lit("Z")))


def telemetry(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Request count, mean latency and success rate in percent, over the log or per group.

    Latencies are summed as exact decimals.
    """
    ok = as_int((F.col("status_code") >= 200) & (F.col("status_code") < 300))
    latency = F.col("latency_ms").cast("decimal(12,2)")
    n = F.count(F.lit(1))
    return log.groupBy(*(by or [])).agg(
        n.alias("total_requests"),
        F.round(F.coalesce(ratio(F.sum(latency), F.count(latency)), F.lit(0.0)), 2).alias("avg_latency_ms"),
        F.round(F.coalesce(F.sum(ok) * 100.0 / F.greatest(F.lit(1), n), F.lit(0.0)), 2).alias("success_rate"),
    )


# ---- metadata catalogue

CATALOG_SEARCH = ["table_name", "column_name", "data_type", "pk", "fk", "business_definition", "data_sensitivity"]


def catalog(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per column of the given tables, ordered by table and column."""
    spark = next(iter(frames.values())).sparkSession
    rows = [(t, f.name, f.dataType.simpleString(), f.nullable) for t, df in frames.items() for f in df.schema]
    out = spark.createDataFrame(rows, "table_name string, column_name string, data_type string, is_null boolean")
    return out.orderBy("table_name", "column_name")


def search_catalog(
    metadata: DataFrame, text: str = "", sort: str = "table_name", descending: bool = False, number: int = 1,
    size: int = 25,
) -> DataFrame:
    """Metadata rows with pk / fk shown as text, searched over the shown columns, one page."""
    yes = F.coalesce(F.col("is_foreign_key"), F.lit(False))
    shown = metadata.withColumns({
        "pk": F.when(F.coalesce("is_primary_key", F.lit(False)), "Yes").otherwise("No"),
        "fk": F.when(yes & F.col("referenced_table").isNotNull(),
                     F.concat(F.lit("Yes ("), F.col("referenced_table"), F.lit(")")))
               .when(yes, "Yes").otherwise("No"),
    })
    found = search_any(shown, text, [c for c in CATALOG_SEARCH if c in shown.columns])
    # The catalogue sorts by lower-case text, with missing values as empty text.
    by = F.lower(F.coalesce(F.col(check_allowed(sort, shown.columns)).cast("string"), F.lit("")))
    ordered = found.orderBy(by.desc() if descending else by.asc(), "meta_id")
    return ordered.offset((number - 1) * size).limit(size)
