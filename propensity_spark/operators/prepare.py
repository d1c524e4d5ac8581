"""Feature preparation: missing-value statistics, imputation, correlation, feature clusters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from propensity_spark.functions.ordered import running_totals
from propensity_spark.functions.scalar import number, ratio


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value) rows of the given columns, NULL and NaN left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), number(c).alias("value")) for c in cols])
    return df.select(F.inline(pairs)).filter(F.col("value").isNotNull())


def missing_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count and share of missing values (NULL, NaN) per feature, in one scan. A column df lacks is not missing."""
    known, kinds = [c for c in cols if c in df.columns], dict(df.dtypes)

    def missing(name: str) -> Column:
        value = F.col(name)
        return value.isNull() | F.isnan(value) if kinds[name] in ("double", "float") else value.isNull()

    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(missing(c)).alias(f"_{c}") for c in known])
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.col(f"_{c}") if c in known else F.lit(0)).cast("bigint")
                 .alias("null_count"))
        for c in cols
    ])
    share = F.round(ratio(F.col("null_count"), F.greatest(F.col("_n"), F.lit(1))), 4)
    return counts.select("_n", F.inline(rows)).select("feature", "null_count", share.alias("null_share"))


def _bracket(name: str, accuracy: int) -> Column:
    near = [0.5 - 3 / accuracy, 0.5 + 3 / accuracy]
    return F.percentile_approx(number(name), near, accuracy)


def medians(
    df: DataFrame, cols: list[str], accuracy: int = 10000, brackets: dict[str, list[float]] | None = None
) -> DataFrame:
    """Exact interpolated median per feature, as (feature, median).

    A sketch first brackets each median: its ranks are off by at most 1 / accuracy, so the quantiles 0.5 -+ 3 /
    accuracy enclose the middle rows. Values outside the bracket are then counted as one group below and one
    above it, and only the distinct values inside are ranked. A feature without values has the median NULL; a feature
    that `brackets` lacks is ranked whole.
    """
    if brackets is None:
        brackets = df.agg(*[_bracket(c, accuracy).alias(c) for c in cols]).first().asDict()
    clamped = []
    for c in cols:
        value = number(c)
        if brackets.get(c):
            low, high = brackets[c]
            value = F.when(value < low, F.lit(-math.inf)).when(value > high, F.lit(math.inf)).otherwise(value)
        clamped.append(value.alias(c))
    counts = _long(df.select(*clamped), cols).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, "value", ["n"], by=["feature"])
    # 1-based positions of the two middle rows; they coincide for an odd count.
    low = F.floor((F.col("total_n") + 1) / 2)
    high = F.floor(F.col("total_n") / 2) + 1
    first = F.col("cum_n") - F.col("n")

    def at(position):
        return F.max(F.when((first < position) & (position <= F.col("cum_n")), F.col("value")))

    found = ranked.groupBy("feature").agg(((at(low) + at(high)) / 2).alias("median"))
    return _every(df, cols).join(found, "feature", "left")


def _every(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per feature."""
    return df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")


def approximate_medians(df: DataFrame, cols: list[str], accuracy: int = 10000) -> DataFrame:
    """Median per feature from a sketch: one scan, no ordering."""
    rows = _long(df, cols).groupBy("feature")
    return rows.agg(F.percentile_approx("value", 0.5, accuracy).alias("median"))


def fill_values(df: DataFrame, strategies: dict[str, str], accuracy: int = 10000) -> dict[str, float]:
    """The value each feature is filled with: its mean, exact median, or 0. One number per feature.

    Means and median brackets come from one scan.
    """
    out = {c: 0.0 for c, s in strategies.items() if s != "drop"}
    means = [c for c, s in strategies.items() if s == "mean"]
    middle = [c for c, s in strategies.items() if s == "median"]
    if not means and not middle:
        return out
    facts = [F.avg(number(c)).alias(c) for c in means] + [_bracket(c, accuracy).alias(c) for c in middle]
    row = df.agg(*facts).first()
    out.update({c: row[c] for c in means if row[c] is not None})
    if middle:
        found = {r["feature"]: r["median"] for r in medians(df, middle, accuracy, {c: row[c] for c in middle}).collect()}
        wide = [c for c in middle if found[c] is not None and math.isinf(found[c])]
        if wide:  # the bracket missed the middle, or the median is infinite: rank every value
            found.update({r["feature"]: r["median"] for r in medians(df, wide, accuracy, {}).collect()})
        out.update({c: v for c, v in found.items() if v is not None})
    return out


def impute(df: DataFrame, strategies: dict[str, str], fit_on: DataFrame | None = None) -> DataFrame:
    """Fill missing values (NULL, NaN) per feature by strategy zero / mean / median; `drop` removes the feature.

    The values come from `fit_on` (the training part), or from the whole of df. A feature without values gets 0. df is
    read several times, so it should be a stored table.
    """
    values = fill_values(df if fit_on is None else fit_on, strategies)
    out = df.drop(*[c for c, s in strategies.items() if s == "drop"])
    return out.withColumns({c: F.coalesce(number(c), F.lit(v)) for c, v in values.items()})


def correlation(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair as (feature_a, feature_b, corr), over rows where both are present.

    Undefined correlations are 0: a column that is constant on the pair's rows, or a pair that is never present
    together. Columns that are no numbers are skipped; NaN and infinite values count as missing. One scan: a record per
    row and feature is folded map-side into one row of co-moments per feature, so what is shuffled is features squared.
    Each pair has its own centred moments, merged around the means of its own rows; values that stand only where the
    other column is missing do not touch it, and large offsets do not cancel.
    """
    cols = [c for c in cols if c in df.columns and isinstance(df.schema[c].dataType, NumericType)]
    values = df.select(*[F.when(F.abs(number(c)) < math.inf, number(c)).alias(c) for c in cols])
    own = F.array(*[F.struct(F.lit(c).alias("feature_a"), F.col(c).alias("_a")) for c in cols])
    a, moments = F.col("_a"), []
    for i, c in enumerate(cols):
        x, y = F.when(F.col(c).isNotNull(), a), F.col(c)  # a is present in every record
        moments += [F.covar_pop(a, y).alias(f"ab{i}"), F.var_pop(x).alias(f"aa{i}"), F.var_pop(y).alias(f"bb{i}"),
                    ((F.min(x) < F.max(x)) & (F.min(y) < F.max(y))).alias(f"vary{i}")]
    found = values.select("*", F.inline(own)).filter(a.isNotNull()).groupBy("feature_a").agg(*moments)
    # From here on rows are features squared.
    each = F.array(*[F.struct(F.lit(c).alias("feature_b"), *[F.col(f"{k}{i}").alias(k) for k in
                                                             ("ab", "aa", "bb", "vary")])
                     for i, c in enumerate(cols)])
    pairs = found.select("feature_a", F.inline(each))
    r = F.when(F.col("vary"), F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb")))
    r = F.coalesce(F.when(~F.isnan(r), r), F.lit(0.0))
    known = pairs.select("feature_a", "feature_b", F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)).alias("corr"))
    every = df.sparkSession.createDataFrame([(p, q) for p in cols for q in cols], "feature_a string, feature_b string")
    full = every.join(known, ["feature_a", "feature_b"], "left")
    return full.select("feature_a", "feature_b", F.coalesce("corr", F.lit(0.0)).alias("corr"))


def feature_clusters(corr: DataFrame, cols: list[str], cut: float = 0.5) -> DataFrame:
    """Clusters of correlated features: average linkage on 1 - |r|, cut at `cut`.

    Input is the small correlation frame (features squared), so linkage runs on the driver. The representative
    is the first feature of a cluster in input order.
    """
    known = {(r["feature_a"], r["feature_b"]): abs(r["corr"]) for r in corr.collect()}
    groups = [[c] for c in cols if (c, c) in known]

    def distance(x: list[str], y: list[str]) -> float:
        return sum(min(max(1.0 - known[p, q], 0.0), 1.0) for p in x for q in y) / (len(x) * len(y))

    while len(groups) > 1:
        near, i, j = min((distance(groups[i], groups[j]), i, j)
                         for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if near > cut:
            break
        groups[i] += groups.pop(j)
    place = {c: i for i, c in enumerate(cols)}
    groups = sorted((sorted(g, key=place.get) for g in groups), key=lambda g: place[g[0]])
    rows = [(i, c, g[0], c == g[0]) for i, g in enumerate(groups, 1) for c in g]
    return corr.sparkSession.createDataFrame(
        rows, "cluster_id int, feature string, representative string, is_representative boolean"
    )


def keep_representatives(df: DataFrame, clusters: DataFrame, keep: list[str]) -> DataFrame:
    """df reduced to the representative features and the columns in `keep`."""
    names = [r["feature"] for r in clusters.filter("is_representative").collect()]
    return df.select(*keep, *[c for c in df.columns if c in names and c not in keep])
