"""Small column helpers shared by the operators. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; NULL instead of an ANSI error when den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def is_true(cond: Column) -> Column:
    """Three-valued condition to two-valued: NULL counts as false."""
    return F.coalesce(cond, F.lit(False))


def number(name: str) -> Column:
    """A column as double; NaN counts as missing."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def as_int(cond: Column) -> Column:
    return is_true(cond).cast("int")


def all_of(conds: list[Column]) -> Column:
    return reduce(and_, conds, F.lit(True)) if conds else F.lit(True)


def any_of(conds: list[Column]) -> Column:
    return reduce(or_, conds) if conds else F.lit(False)


def contains_text(col: Column, text: str, wildcards: bool = False) -> Column:
    """Case-insensitive search. `%` and `_` are plain characters unless `wildcards` is set."""
    if wildcards:
        return col.ilike(f"%{text}%")
    return F.contains(F.lower(col), F.lit(text.lower()))


def money_text(col: Column) -> Column:
    """Money rounded to whole units, as text (the form a lead list is searched in)."""
    return F.round(col, 0).cast("bigint").cast("string")


def iso(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def mask_json(col: Column, keys: list[str], mask: str = "********") -> Column:
    """Replace the values of top-level `keys` in a JSON object; text that is no object becomes ''."""
    fields = F.from_json(col, "map<string,variant>")  # NULL unless the text is an object
    masked = F.transform_values(fields, lambda k, v: F.when(k.isin(keys), F.lit(mask).cast("variant")).otherwise(v))
    return F.coalesce(F.to_json(masked), F.lit(""))


def hash_bucket(key: Column, seed: int, buckets: int = 10000) -> Column:
    """Stable bucket 0..buckets-1 of a key; the same under any partitioning and in any engine with md5."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def bin_index(value: Column, edges: list[float]) -> Column:
    """Index of the half-open bin [edge_i, edge_i+1); the last bin is closed; NULL outside."""
    last = len(edges) - 2
    out = F.when(value < edges[0], None)
    for i in range(last):
        out = out.when(value < edges[i + 1], i)
    return out.when(value <= edges[-1], last)


def linspace(start: float, stop: float, bins: int) -> list[float]:
    """Bin edges as start + i * step, the same doubles a numeric library produces."""
    step = (stop - start) / bins
    return [start + i * step for i in range(bins)] + [stop]
