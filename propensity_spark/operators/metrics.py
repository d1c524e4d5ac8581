"""Exact evaluation metrics, curves, fairness and acceptance figures.

Everything starts from one row per distinct score with its positive and negative counts. That frame is built by a
partial aggregate, so ties and hot scores cost nothing, and running totals over it give the curves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensity_spark.functions.ordered import running_totals
from propensity_spark.functions.scalar import ratio

THRESHOLD = 0.55
#: Metrics where nothing is labelled (fixed values).
DEFAULTS = {"n_labelled": 0, "roc_auc": 0.5, "pr_auc": 0.5, "f1_score": 0.0, "log_loss": 0.693, "ks_statistic": 0.0,
            "gini": 0.0}
SMALLEST = 2.220446049250313e-16  # double precision epsilon, the clip of log loss


def score_counts(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """(by, score, pos, neg), rows with an unknown label or without a score (NULL, NaN) left out."""
    known = df.filter(F.col(label).isin(0, 1) & F.col(score).isNotNull())
    if dict(df.dtypes)[score] in ("double", "float"):
        known = known.filter(~F.isnan(score))
    return known.groupBy(*(by or []), F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def _metric(value: Column, default: float) -> Column:
    value = F.when(F.isnan(value) | (F.abs(value) == math.inf), None).otherwise(value)
    return F.coalesce(F.round(value, 4), F.lit(default))


def binary_metrics(
    df: DataFrame, label: str, score: str, threshold: float = THRESHOLD, by: list[str] | None = None
) -> DataFrame:
    """ROC-AUC, average precision, F1 at the threshold, log loss, KS of the classes and Gini, per group.

    Undefined values take the defaults .5, .5, 0, .693 and 0.
    """
    return metrics_of_counts(score_counts(df, label, score, by), threshold, by)


def metrics_of_counts(counts: DataFrame, threshold: float = THRESHOLD, by: list[str] | None = None) -> DataFrame:
    """binary_metrics() from rows (by, score, pos, neg), one per score."""
    by = list(by or [])
    c = running_totals(counts, "score", ["pos", "neg"], by)
    pos, neg, s = F.col("pos").cast("double"), F.col("neg").cast("double"), F.col("score").cast("double")
    all_pos, all_neg = F.col("total_pos").cast("double"), F.col("total_neg").cast("double")
    tp = all_pos - F.col("cum_pos") + pos
    fp = all_neg - F.col("cum_neg") + neg
    p = F.greatest(F.least(s, F.lit(1 - SMALLEST)), F.lit(SMALLEST))
    sums = c.groupBy(*by).agg(
        F.sum(pos).alias("p"), F.sum(neg).alias("n"),
        F.sum(pos * (F.col("cum_neg") - neg / 2)).alias("wins"),
        F.sum(pos * ratio(tp, tp + fp)).alias("precision_sum"),
        F.sum(F.when(s >= threshold, pos).otherwise(0.0)).alias("tp"),
        F.sum(F.when(s >= threshold, neg).otherwise(0.0)).alias("fp"),
        F.sum(-(pos * F.ln(p) + neg * F.ln(1 - p))).alias("loss"),
        F.max(F.abs(ratio(F.col("cum_pos"), all_pos) - ratio(F.col("cum_neg"), all_neg))).alias("ks"),
    )
    p, n = F.col("p"), F.col("n")
    auc = _metric(ratio(F.col("wins"), p * n), 0.5)
    return sums.select(
        *by,
        F.coalesce(p + n, F.lit(0.0)).cast("bigint").alias("n_labelled"),
        auc.alias("roc_auc"),
        # Without positives every precision is 0; the default is for no labelled row at all.
        _metric(F.when((p == 0) & (n > 0), F.lit(0.0)).otherwise(ratio(F.col("precision_sum"), p)), 0.5)
        .alias("pr_auc"),
        _metric(ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + p), 0.0).alias("f1_score"),
        _metric(ratio(F.col("loss"), p + n), 0.693).alias("log_loss"),
        _metric(F.col("ks"), 0.0).alias("ks_statistic"),
        F.round(2 * auc - 1, 4).alias("gini"),
    )


def curve(
    df: DataFrame, label: str, score: str, kind: str = "roc", points: int = 15, by: list[str] | None = None
) -> DataFrame:
    """ROC (fpr, tpr) or precision-recall (recall, precision) at evenly spaced points as (by, idx, x, y).

    A curve has one point per distinct score plus its end point. Of these m + 1 points the ones with index
    floor(i * m / (points - 1)) are taken, so a short curve repeats points.
    """
    by = list(by or [])
    roc = kind == "roc"
    counts = score_counts(df, label, score, by).withColumn("one", F.lit(1))
    c = running_totals(counts, "score", ["pos", "neg", "one"], by, descending=roc)
    m = F.col("total_one")
    if roc:
        # Descending thresholds: point r covers the r highest scores, point 0 is the origin.
        place, end_place, end = F.col("cum_one"), F.lit(0), (0.0, 0.0)
        x, y = ratio(F.col("cum_neg"), F.col("total_neg")), ratio(F.col("cum_pos"), F.col("total_pos"))
    else:
        # Ascending thresholds: point r covers scores from the r-th lowest up, the last point is (0, 1).
        place, end_place, end = F.col("cum_one") - 1, m, (0.0, 1.0)
        tp = F.col("total_pos") - F.col("cum_pos") + F.col("pos")
        fp = F.col("total_neg") - F.col("cum_neg") + F.col("neg")
        x = F.when(F.col("total_pos") == 0, F.lit(1.0)).otherwise(ratio(tp, F.col("total_pos")))
        y = ratio(tp, tp + fp)

    def chosen(where: Column, px: Column, py: Column) -> Column:
        picks = F.filter(F.sequence(F.lit(0), F.lit(points - 1)),
                         lambda i: F.floor(i * m / (points - 1)) == where)
        return F.transform(picks, lambda i: F.struct(
            i.alias("idx"), F.round(F.coalesce(px, F.lit(0.0)), 4).alias("x"),
            F.round(F.coalesce(py, F.lit(0.0)), 4).alias("y")))

    extra = chosen(end_place, F.lit(end[0]), F.lit(end[1]))
    own = chosen(place, x, y)
    # One row per group carries the end point.
    return c.select(*by, F.inline(F.when(F.col("cum_one") == 1, F.concat(own, extra)).otherwise(own)))


RISK_BINS = [("0-20%", 0.0, 0.2), ("20-40%", 0.2, 0.4), ("40-60%", 0.4, 0.6), ("60-80%", 0.6, 0.8),
             ("80-100%", 0.8, 1.0)]


def risk_slope(
    df: DataFrame, label: str, score: str, half_open: bool = False, by: list[str] | None = None
) -> DataFrame:
    """Count, actual and mean predicted rate in five score bins.

    Bins are closed on both sides, so an edge score counts in two; `half_open` counts it in the upper one only.
    """
    s, known = F.col(score).cast("double"), df.filter(F.col(label).isin(0, 1))
    exact = F.col(score).cast("decimal(20,10)")
    aggs = []
    for i, (_, low, high) in enumerate(RISK_BINS):
        inside = (s >= low) & ((s < high) if half_open and high < 1 else (s <= high))
        aggs += [F.count_if(inside).alias(f"n{i}"), F.count_if(inside & (F.col(label) == 1)).alias(f"p{i}"),
                 F.sum(F.when(inside, exact)).alias(f"s{i}")]
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("bin"),
            F.round(F.coalesce(ratio(F.col(f"s{i}"), F.col(f"n{i}")), F.lit((low + high) / 2)), 4)
            .alias("predicted_rate"),
            F.round(F.coalesce(ratio(F.col(f"p{i}"), F.col(f"n{i}")), F.lit(0.0)), 4).alias("actual_rate"),
            F.col(f"n{i}").alias("n"),
        )
        for i, (name, low, high) in enumerate(RISK_BINS)
    ])
    by = list(by or [])
    return known.groupBy(*by).agg(*aggs).select(*by, F.inline(rows))


def adverse_impact(
    df: DataFrame, label: str, group: str, privileged: str, unprivileged: str, by: list[str] | None = None
) -> DataFrame:
    """Selection rate of the unprivileged over that of the privileged group; 1 when undefined."""
    def rate(name: str) -> Column:
        member = F.col(group) == name
        return ratio(F.count_if(member & (F.col(label) == 1)), F.count_if(member))

    value = F.try_divide(rate(unprivileged), rate(privileged))
    return df.groupBy(*(by or [])).agg(F.coalesce(F.round(value, 4), F.lit(1.0)).alias("adverse_impact_ratio"))


def score_summary(df: DataFrame, score: str) -> DataFrame:
    """Rows scored and their mean score, 0 without rows."""
    exact = F.col(score).cast("decimal(20,10)")
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("scored_count"),
        F.round(F.coalesce(ratio(F.sum(exact), n), F.lit(0.0)), 4).alias("average_propensity_score"),
    )
