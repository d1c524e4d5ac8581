"""Connected components of a graph given by its edges, without the graph meeting the driver or one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensity_spark.llm.common import discard, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node that can be reached.

    Alternates large-star and small-star rounds (Kiveris et al. 2014): in the first, every node links its larger
    neighbours to its least neighbour, in the second its smaller ones and itself. Both read a minimum per node, which
    combines before the shuffle, and join it to the edges, so a hub is split like any skewed join key. Each round is
    a stored table; when a pair of rounds changes nothing, every node hangs on its least. NULL ends and loops are left
    out.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    current = stored(pairs, "edges")
    mark = _mark(current)
    while mark[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = stored(small, "edges")
        discard(current)
        current, seen = after, mark
        mark = _mark(current)
        if mark == seen:
            break
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number and check sums of the edges: equal for equal sets."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())
