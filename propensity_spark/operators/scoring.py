"""Scoring with stored coefficients, feature contributions, and prediction-log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensity_spark.operators.customer360 import customer_360, semi_joined
from propensity_spark.operators.labels import hash_sample
from propensity_spark.operators.metrics import THRESHOLD


def _values(features: list[str]) -> list[Column]:
    return [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]


def linear_score(
    df: DataFrame, weights: dict[str, float], intercept: float = 0.0, link: str = "logit", score: str = "score",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Add the score and label of a stored logistic ('logit') or linear ('identity', clipped) model.

    Missing features count as 0.
    """
    total = F.lit(intercept)
    for value, weight in zip(_values(list(weights)), weights.values()):
        total = total + value * F.lit(weight)
    if link == "logit":
        out = F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
    else:
        out = F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))
    return df.withColumn(score, out).withColumn("predicted_label", (F.col(score) >= threshold).cast("int"))


def contributions(df: DataFrame, weights: dict[str, float], top: int = 3, signed: bool = False) -> DataFrame:
    """Add explanation_coeff_1..top: the largest value x weight terms, by absolute or signed value. Row-local."""
    terms = F.array(*[v * F.lit(w) for v, w in zip(_values(list(weights)), weights.values())])
    ranked = F.sort_array(
        F.transform(terms, lambda t: F.struct((t if signed else F.abs(t)).alias("by"), t.alias("term"))), asc=False
    )
    return df.withColumns({
        f"explanation_coeff_{i + 1}": F.get(F.transform(ranked, lambda r: r["term"]), F.lit(i)) for i in range(top)
    })


def batch_population(
    base: DataFrame, parts: list[DataFrame], n: int, key: str = "customer_id", seed: int = 42
) -> DataFrame:
    """base LEFT JOIN each 1:1 part for a random cohort of n customers: keys are drawn from base before anything is
    joined, and every part is reduced to them before it is aggregated."""
    keys = hash_sample(base.select(key), key, n, seed)
    return customer_360(semi_joined([base], keys, key)[0], semi_joined(parts, keys, key), key)


def batch_score(
    population: DataFrame, n: int, model_id: str, product: str, weights: dict[str, float], intercept: float,
    run: str, key: str = "customer_id", seed: int = 42, scored_at: str | None = None,
) -> DataFrame:
    """Prediction-log rows for a random cohort of n customers, outcome pending. Ids repeat when a run is repeated.

    A population that is assembled by joins should be assembled for sampled keys alone: see batch_population().

    With `scored_at` the rows carry the time the log is partitioned by.
    """
    scored = linear_score(hash_sample(population, key, n, seed), weights, intercept)
    scored = contributions(scored, weights)
    return scored.select(
        F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(model_id), F.lit(run)), 256), 1, 12)
        .alias("prediction_id"),
        key, F.lit(model_id).alias("model_id"), F.lit(product).alias("target_product_type"),
        F.round("score", 4).cast("decimal(5,4)").alias("propensity_score"), "predicted_label",
        *[F.round(f"explanation_coeff_{i}", 6).alias(f"explanation_coeff_{i}") for i in (1, 2, 3)],
        F.lit(-1).alias("is_conversion_successful"),
        *([F.lit(scored_at).cast("timestamp_ntz").alias("timestamp")] if scored_at else []),
    )
