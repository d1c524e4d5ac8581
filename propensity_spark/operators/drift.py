"""Distribution drift between an expected and an actual side, and the decisions taken on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensity_spark.functions.ordered import running_totals
from propensity_spark.functions.scalar import bin_index, linspace, number, ratio
from propensity_spark.operators.metrics import DEFAULTS, binary_metrics

EXPECTED, ACTUAL = "expected", "actual"
EPSILON = 0.0001
PSI_LIMIT = 0.25
AUC_LIMIT = 0.75


def _bin_counts(df: DataFrame, side: str, value: Column, edges: list[float], by: list[str], *sums: Column) -> DataFrame:
    """Counters e_i, a_i per bin and e_n, a_n per side, for each group.

    Rows are first reduced to one per group, side and bin, with one counter each; `sums` are added up with them
    and come out as e_<name>, a_<name>.
    """
    place = bin_index(value.cast("double"), edges)
    small = df.groupBy(*by, F.col(side).alias("_side"), place.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), *sums)
    names = [c for c in small.columns if c not in (*by, "_side", "_bin", "_n")]
    out = []
    for prefix, name in (("e", EXPECTED), ("a", ACTUAL)):
        own = F.col("_side") == name
        out.append(F.sum(F.when(own, F.col("_n")).otherwise(0)).alias(f"{prefix}_n"))
        out += [F.sum(F.when(own & (F.col("_bin") == i), F.col("_n")).otherwise(0)).alias(f"{prefix}_{i}")
                for i in range(len(edges) - 1)]
        out += [F.sum(F.when(own, F.col(c))).alias(f"{prefix}_{c}") for c in names]
    return small.groupBy(*by).agg(*out)


def score_distribution(df: DataFrame, side: str, score: str, bins: int = 19) -> DataFrame:
    """Histogram of both sides on [0, 1]: bin, midpoint, expected, actual. Empty bins are present."""
    edges = linspace(0.0, 1.0, bins)
    rows = F.array(*[
        F.struct(F.lit(i).alias("bin"), F.lit(round((edges[i] + edges[i + 1]) / 2, 3)).alias("midpoint"),
                 F.coalesce(f"e_{i}", F.lit(0)).alias("expected"), F.coalesce(f"a_{i}", F.lit(0)).alias("actual"))
        for i in range(bins)
    ])
    return _bin_counts(df, side, F.col(score), edges, []).select(F.inline(rows))


def psi_from_counts(bins: int) -> Column:
    """PSI from the counters of _bin_counts. Values outside the bins stay in the denominator."""
    def shares(prefix: str) -> list[Column]:
        raw = [F.coalesce(ratio(F.col(f"{prefix}_{i}"), F.col(f"{prefix}_n")), F.lit(0.0)) for i in range(bins)]
        return [F.when(r == 0, F.lit(EPSILON)).otherwise(r) for r in raw]

    def scaled(prefix: str) -> Column:
        parts = F.array(*shares(prefix))
        total = F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)
        return F.transform(parts, lambda v: v / total)

    terms = F.zip_with(scaled("a"), scaled("e"), lambda a, e: (a - e) * F.ln(a / e))
    value = F.round(F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v), 4)
    empty = (F.coalesce(F.col("e_n"), F.lit(0)) == 0) | (F.coalesce(F.col("a_n"), F.lit(0)) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(value)


def psi(df: DataFrame, side: str, score: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Population stability index on [0, 1] per group; 0 when a side is empty. Only counters are shuffled."""
    by = list(by or [])
    counts = _bin_counts(df, side, F.col(score), linspace(0.0, 1.0, bins), by)
    return counts.select(*by, psi_from_counts(bins).alias("psi"))


def ks(df: DataFrame, side: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per group; 0 when a side is empty."""
    by = list(by or [])
    known = df.filter(F.col(value).isNotNull())
    counts = known.groupBy(*by, F.col(value).alias("value")).agg(
        F.count_if(F.col(side) == EXPECTED).alias("e"), F.count_if(F.col(side) == ACTUAL).alias("a")
    )
    c = running_totals(counts, "value", ["e", "a"], by)
    gap = F.abs(ratio(F.col("cum_e"), F.col("total_e")) - ratio(F.col("cum_a"), F.col("total_a")))
    return c.groupBy(*by).agg(F.coalesce(F.round(F.max(gap), 4), F.lit(0.0)).alias("ks"))


def two_sides(expected: DataFrame, actual: DataFrame, side: str = "side") -> DataFrame:
    return expected.withColumn(side, F.lit(EXPECTED)).unionByName(actual.withColumn(side, F.lit(ACTUAL)))


def feature_drift(df: DataFrame, side: str, cols: list[str], bins: int = 10) -> DataFrame:
    """Per feature: mean of both sides, PSI after min-max scaling by the expected side, and a status.

    Live values beyond the expected range are clipped into it. Missing values (NULL, NaN) are left out; a feature
    without any has PSI 0 and no means. Two scans: the ranges (two numbers per feature), then all counters of all
    features together.
    """
    own = F.col(side) == EXPECTED
    limits = df.agg(*[f(F.when(own, number(c))).alias(f"{n}_{c}")
                      for c in cols for n, f in (("lo", F.min), ("hi", F.max))]).first()
    pairs = []
    for c in cols:
        low, high = limits[f"lo_{c}"], limits[f"hi_{c}"]
        low = 0.0 if low is None else low
        width = 0.0 if high is None else high - low
        x = number(c)
        scaled = (x - F.lit(low)) / F.lit(width) if width else F.when(x.isNotNull(), F.lit(0.0))
        scaled = F.when(x.isNotNull(), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))
        pairs.append(F.struct(F.lit(c).alias("feature"), x.alias("value"), scaled.alias("scaled")))
    rows = df.select(side, F.inline(F.array(*pairs))).filter(F.col("value").isNotNull())
    counts = _bin_counts(rows, side, F.col("scaled"), linspace(0.0, 1.0, bins), ["feature"],
                         F.sum("value").alias("value"))
    counts = counts.withColumns({
        "baseline_mean": F.round(ratio(F.col("e_value"), F.col("e_n")), 4),
        "live_mean": F.round(ratio(F.col("a_value"), F.col("a_n")), 4),
    })
    found = counts.select("feature", "baseline_mean", "live_mean", psi_from_counts(bins).alias("_psi"))
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    out = every.join(found, "feature", "left").select(
        "feature", "baseline_mean", "live_mean", F.coalesce("_psi", F.lit(0.0)).alias("psi"))
    return out.withColumn("status", F.when(F.col("psi") >= PSI_LIMIT, "Critical").otherwise("Stable"))


def metric_history(
    df: DataFrame, label: str, score: str, time: str, baseline_end: str, step: str = "day"
) -> DataFrame:
    """One row per time step: metrics of the step, and PSI of its scores against the rows before `baseline_end`.

    A step whose outcomes are all pending has the metrics' defaults. The baseline is reduced to ten counters before
    it meets the steps.
    """
    stepped = df.withColumn("step", F.date_trunc(step, F.col(time).cast("timestamp_ntz")).cast("date"))
    metrics = binary_metrics(stepped, label, score, by=["step"])
    edges = linspace(0.0, 1.0, 10)
    place = bin_index(F.col(score).cast("double"), edges)
    base = df.filter(F.col(time) < F.lit(baseline_end).cast("timestamp_ntz")).agg(
        F.count(F.lit(1)).alias("e_n"), *[F.count_if(place == i).alias(f"e_{i}") for i in range(10)]
    ).first()
    live = stepped.groupBy("step").agg(
        F.count(F.lit(1)).alias("a_n"), *[F.count_if(place == i).alias(f"a_{i}") for i in range(10)]
    )
    compared = live.withColumns({name: F.lit(base[name]) for name in base.asDict()})
    steps = compared.select("step", psi_from_counts(10).alias("psi"))
    out = steps.withColumnRenamed("step", "_step").join(metrics, F.col("_step").eqNullSafe(F.col("step")), "left")
    values = [F.coalesce(F.col(c), F.lit(v).cast(metrics.schema[c].dataType)).alias(c)
              for c, v in DEFAULTS.items()]
    return out.select(F.col("_step").alias("step"), *values, "psi").orderBy("step")


# ---- decisions

def best_challenger(models: DataFrame, champion: str) -> DataFrame:
    """The challenger with the highest baseline ROC-AUC, the first registered on ties. Migrated models are none."""
    others = models.filter((F.col("status") == "challenger") & (F.col("model_id") != champion))
    auc = F.try_element_at("baselines", F.lit("roc_auc"))
    return others.orderBy(auc.desc_nulls_last(), F.col("seq")).limit(1)


def drift_alert(models: DataFrame, metrics: DataFrame, champion: str, mode: str = "manual") -> DataFrame:
    """One row: champion, its live AUC, PSI, fairness, the best challenger, and whether approval is needed.

    `metrics` is one row (roc_auc, psi, fairness), and a one-row challenger is joined to it.
    """
    if mode not in ("automatic", "manual"):
        raise ValueError("Invalid failover mode")
    challenger = best_challenger(models, champion).select(
        F.col("model_id").alias("challenger_id"),
        F.try_element_at("baselines", F.lit("roc_auc")).alias("challenger_auc"), F.lit(1).alias("_one"),
    )
    degraded = (F.col("psi") >= PSI_LIMIT) | (F.col("roc_auc") < AUC_LIMIT)
    live = metrics.select("roc_auc", "psi", "fairness", F.lit(1).alias("_one"))
    return live.join(F.broadcast(challenger), "_one", "left").select(
        F.lit(champion).alias("champion_id"), F.col("roc_auc").alias("live_auc"), "psi", "fairness",
        "challenger_id", F.coalesce("challenger_auc", F.lit(0.5)).alias("challenger_auc"), degraded.alias("degraded"),
        F.lit(mode == "manual").alias("needs_approval"),
    )


def failover(alert: DataFrame, mode: str = "manual") -> DataFrame:
    """The decision on an alert: promote (automatic), flag (manual) or none, the model active after it, and the
    audit text."""
    degraded = F.col("degraded") & F.col("challenger_id").isNotNull()
    promote = degraded & F.lit(mode == "automatic")
    return alert.select(
        "champion_id", "challenger_id",
        F.when(promote, "promote").when(degraded, "flag").otherwise("none").alias("decision"),
        F.when(promote, F.col("challenger_id")).otherwise(F.col("champion_id")).alias("active_id"),
        F.when(promote, F.format_string("Automated Hot-Swap completed: %s -> %s", "champion_id", "challenger_id"))
        .when(degraded, F.format_string("Failover proposed: %s -> %s", "champion_id", "challenger_id"))
        .alias("audit_action"),
    )
