"""Running totals and ranks over a whole table without a single-task window.

A window ordered over the whole table would sort everything in one task. Here the rows are cut into
consecutive ranges of the order, the window runs inside each range, and a small frame with one row per range
supplies what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from propensity_spark.functions.session import checkpointed

PART, GROUP = "_range", "_group"
BOUNDED_DIGITS = 6


def _directed(name: str, descending: bool) -> Column:
    return F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last()


def _ranged(df: DataFrame, order: list[str], descending: bool, by: list[str]) -> DataFrame:
    """Add PART, the number of the consecutive range a row lies in.

    A short decimal has a bounded number of values, so fixed value ranges do and the plan stays lazy. Any other
    order is range-partitioned by Spark (hot groups are cut, since the whole order takes part) and checkpointed:
    the ranges come from a sample and must not change between the two reads below.
    """
    kind = df.schema[order[0]].dataType
    if len(order) == 1 and isinstance(kind, DecimalType) and kind.precision <= BOUNDED_DIGITS:
        step = F.lit(10 ** (kind.precision - kind.scale) / 64)
        part = F.coalesce(F.floor(F.col(order[0]).cast("double") / step), F.lit(0).cast("bigint"))
        return df.withColumn(PART, -part if descending else part)
    keys = [F.col(c) for c in by] + [_directed(c, descending and i == 0) for i, c in enumerate(order)]
    return checkpointed(df.repartitionByRange(*keys).withColumn(PART, F.spark_partition_id()))


def running_totals(
    df: DataFrame, order: str, sums: list[str], by: list[str] | None = None, descending: bool = False
) -> DataFrame:
    """Add cum_<s> (inclusive running sum in `order`) and total_<s> for every column s, per group of `by`.

    `df` holds one row per (by, order) value, so pre-aggregate first. `order` must not be NULL.
    """
    by = list(by or [])
    ranged = _ranged(df, [order], descending, by)
    # Groups are keyed by a struct: it is never NULL, so a NULL group is kept, and no filter is inferred that
    # would keep Spark from using the shuffle of `df` for both reads below.
    key = [GROUP] if by else []
    if by:
        ranged = ranged.withColumn(GROUP, F.struct(*by))
    inside = Window.partitionBy(PART, *key).orderBy(_directed(order, descending)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # One row per range and group.
    ranges = ranged.groupBy(*key, PART).agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums])
    whole = Window.partitionBy(*key)
    before = whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        *key, PART,
        *[F.coalesce(F.sum(f"_sum_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sums],
        *[F.sum(f"_sum_{s}").over(whole).alias(f"total_{s}") for s in sums],
    )
    if not by:
        offsets = F.broadcast(offsets)
    cum = ranged.select("*", *[F.sum(s).over(inside).alias(f"_in_{s}") for s in sums])
    return cum.join(offsets, [*key, PART]).select(
        *df.columns,
        *[(F.col(f"_in_{s}") + F.col(f"_before_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"total_{s}") for s in sums],
    )


def global_rank(df: DataFrame, value: str, tie_break: str, name: str) -> DataFrame:
    """1-based unique rank by `value` descending, then by the unique column `tie_break`."""
    ranged = _ranged(df, [value, tie_break], True, [])
    inside = Window.partitionBy(PART).orderBy(_directed(value, True), _directed(tie_break, False))
    sizes = ranged.groupBy(PART).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(PART, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    ranked = ranged.withColumn("_in", F.row_number().over(inside)).join(F.broadcast(offsets), PART)
    return ranked.select(*df.columns, (F.col("_in") + F.col("_before")).alias(name))
