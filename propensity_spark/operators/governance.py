"""Model registry, manifest, approval, acceptance, audit and traffic as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensity_spark.functions.ordered import global_rank
from propensity_spark.functions.scalar import hash_bucket, ratio

DEFAULT_RANK_METRIC = 0.70


def metric(column: str, name: str) -> Column:
    """An entry of a metric map; NULL when missing."""
    return F.try_element_at(column, F.lit(name))


# ---- upserts

def _one_per_id(rows: DataFrame, key: str, order: str, last: bool) -> DataFrame:
    pick = F.max_by if last else F.min_by
    kept = rows.groupBy(key).agg(pick(F.struct(*[c for c in rows.columns if c != key]), F.col(order)).alias("_row"))
    return kept.select(key, "_row.*")


def upsert(current: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Replace whole rows of `current` by id, else insert. Of an id given twice the last by `order` counts."""
    new = _one_per_id(incoming, key, order, last=True)
    return current.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_counts(incoming: DataFrame, key: str, category: str = "model_category") -> DataFrame:
    """How many models and rules a manifest brings."""
    rule = F.col(category) == "Rule"
    return incoming.agg(
        F.count_distinct(F.when(~rule, F.col(key))).alias("imported_ml"),
        F.count_distinct(F.when(rule, F.col(key))).alias("imported_rules"),
    )


def insert_absent(current: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of `incoming` to append: ids `current` lacks, the first by `order` of each id."""
    known = current.select(key).distinct()  # a frequent id is one row before it meets the join
    return _one_per_id(incoming, key, order, last=False).join(known, key, "left_anti")


def approve(studio: DataFrame, created_at: str) -> DataFrame:
    """Studio models (model_id, algorithm_type, auc, pr_auc, ks, fairness, latency_ms) as challenger rows."""
    is_rule = F.col("model_id").startswith("rule_") | F.col("algorithm_type").contains("Rule Strategy")
    values = {  # defaults are fixed values
        "roc_auc": F.coalesce("auc", F.lit(0.80)),
        "pr_auc": F.coalesce("pr_auc", F.lit(0.75)),
        "f1_score": F.lit(0.75),
        "ks_statistic": F.coalesce("ks", F.lit(0.50)),
        "log_loss": F.lit(0.40),
        "fairness": F.coalesce("fairness", F.lit(0.95)),
    }
    live = {**values, "psi": F.lit(0.01), "latency": F.coalesce("latency_ms", F.lit(15.0)), "memory": F.lit(45.0)}

    def as_map(entries: dict[str, Column]) -> Column:
        return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])

    return studio.select(
        "model_id", "algorithm_type", F.lit("v2.0-studio").alias("version"), F.lit("challenger").alias("status"),
        F.when(is_rule, "Rule").otherwise("ML").alias("model_category"), F.lit("both").alias("serving_path"),
        F.lit(created_at).alias("created_at"), as_map(values).alias("baselines"), as_map(live).alias("live_metrics"),
    )


# ---- ranks and acceptance

def model_ranks(models: DataFrame, key: str = "model_id", sequence: str = "seq") -> DataFrame:
    """Add the 1-based rank by baseline ROC-AUC and by PR-AUC; a missing metric counts as 0.70."""
    out = models.withColumns({
        "_auc": F.coalesce(metric("baselines", "roc_auc"), F.lit(DEFAULT_RANK_METRIC)),
        "_pr": F.coalesce(metric("baselines", "pr_auc"), F.lit(DEFAULT_RANK_METRIC)),
    })
    out = global_rank(out, "_auc", sequence, "roc_auc_rank")
    return global_rank(out, "_pr", sequence, "pr_auc_rank").drop("_auc", "_pr")


def model_list(models: DataFrame, champion: str) -> DataFrame:
    return model_ranks(models).withColumn("is_champion", F.col("model_id") == champion)


def acceptance(models: DataFrame, rules: DataFrame, target: str = "all") -> DataFrame:
    """Acceptance checks of models and rules, one row each, for one id or all."""
    auc = F.coalesce(metric("baselines", "roc_auc"), F.lit(0.80))
    latency = F.coalesce(metric("live_metrics", "latency"), F.lit(15.0))
    gini = F.coalesce(metric("performance_summary", "gini").cast("double"), F.lit(0.50))
    conditions = F.coalesce(F.size("rule_config.conditions"), F.lit(0))
    conditions = F.greatest(conditions, F.lit(0))

    def status(passed: Column) -> Column:
        return F.when(passed, "PASS").otherwise("FAIL").alias("status")

    ml = models.select(
        "model_id", F.lit("ML Model").alias("type"), F.coalesce("algorithm_type", F.lit("ML")).alias("checked"),
        F.lit("ROC-AUC >= 0.70 & Latency <= 50ms").alias("assertion_check"),
        F.format_string("AUC: %.4f, Latency: %.1fms", auc, latency).alias("metric_value"),
        status((auc >= 0.70) & (latency <= 50.0)),
    )
    rule = rules.select(
        "model_id", F.lit("Rule-Based Model").alias("type"), F.coalesce("model_name", F.lit("Rule")).alias("checked"),
        F.lit("Valid Logic & Gini >= 0.40").alias("assertion_check"),
        F.format_string("Conditions: %d, Gini: %.4f", conditions, gini).alias("metric_value"),
        status((conditions > 0) & (gini >= 0.40)),
    )
    out = ml.unionByName(rule)
    return out if target in ("", "all") else out.filter(F.col("model_id") == target)


def acceptance_summary(results: DataFrame) -> DataFrame:
    passed, n = F.count_if(F.col("status") == "PASS"), F.count(F.lit(1))
    return results.agg(
        n.alias("total_tested"), passed.alias("passed"), F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.round(F.coalesce(ratio(passed, n), F.lit(0.0)), 4).alias("pass_rate"),
    )


# ---- champion changes

def promote(models: DataFrame, model_id: str) -> DataFrame:
    """The registry with a new champion; the previous one becomes a challenger."""
    if not models.filter(F.col("model_id") == model_id).limit(1).count():
        raise ValueError("Model ID not found in registry")
    status = (
        F.when(F.col("model_id") == model_id, "champion").when(F.col("status") == "champion", "challenger")
        .otherwise(F.col("status"))
    )
    return models.withColumn("status", status)


def previous_champion(models: DataFrame, audit: DataFrame, current: str) -> DataFrame:
    """The model the current champion replaced: from the newest swap entry that ends in it, if registered.

    Manual and automatic swaps count. No row when there is none.
    """
    swap = F.regexp_extract("action", r"Hot-Swap completed[^:]*:\s*([^:>]*?)\s*->\s*([^>]*?)\s*$", 1)
    target = F.regexp_extract("action", r"Hot-Swap completed[^:]*:\s*([^:>]*?)\s*->\s*([^>]*?)\s*$", 2)
    swaps = audit.filter(F.col("action").contains("Hot-Swap completed") & (target == current))
    swaps = swaps.select("seq", swap.alias("model_id"))
    return swaps.join(models, "model_id", "left_semi").orderBy(F.col("seq").desc()).limit(1).select("model_id")


def rollback(
    models: DataFrame, audit: DataFrame, current: str, default: str = "xgb_model_v1.0",
    second_default: str = "cat_model_v1.0",
) -> DataFrame:
    """The registry with the previous champion back, or a default model when the audit names none."""
    found = previous_champion(models, audit, current).first()
    back = found["model_id"] if found else (default if current != default else second_default)
    return promote(models, back)


# ---- audit trail

def audit_entry(audit: DataFrame, by: str, action: str, evidence: str, time: str, approved_by: str | None = None):
    """The audit trail with one entry added at its end."""
    entry = audit.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).cast("bigint").alias("seq")).select(
        "seq", F.lit(time).alias("timestamp"), F.lit(by).alias("triggered_by"), F.lit(action).alias("action"),
        F.lit(evidence).alias("evidence"), F.lit(approved_by or "system").alias("approved_by"),
    )
    return audit.unionByName(entry)


def audit_tail(audit: DataFrame, n: int = 15) -> DataFrame:
    """The newest n entries, oldest first."""
    return audit.orderBy(F.col("seq").desc()).limit(n).orderBy("seq")


def registry_listing(
    models: DataFrame, audit: DataFrame, champion: str, settings: dict[str, str], tail: int = 15
) -> DataFrame:
    """What a registry shows, as (part, entry, value): ranked models, the champion, settings, and the newest audit."""
    ranked = model_ranks(models).select(F.lit("model").alias("part"), F.col("model_id").alias("entry"),
                                        F.col("roc_auc_rank").cast("string").alias("value"))
    fixed = models.sparkSession.createDataFrame(
        [("champion", champion, None), *[("setting", k, v) for k, v in settings.items()]],
        "part string, entry string, value string")
    newest = audit_tail(audit, tail).select(F.lit("audit").alias("part"), F.col("seq").cast("string").alias("entry"),
                                            F.col("action").alias("value"))
    return ranked.unionByName(fixed).unionByName(newest)


# ---- traffic

def assign_traffic(
    requests: DataFrame, key: str, champion: str, challenger: str, champion_ratio: float = 1.0,
    mode: str = "ab_split", seed: int = 42,
) -> DataFrame:
    """Add the serving model of each request and the model that scores it in shadow.

    ab_split: a stable hash share of the requests goes to the challenger. single and shadow: all to the champion.
    """
    to_champion = F.lit(True)
    if mode == "ab_split":
        to_champion = hash_bucket(F.col(key), seed) < round(champion_ratio * 10000)
    shadow = F.lit(challenger) if mode == "shadow" else F.lit(None).cast("string")
    return requests.withColumns({
        "model_id": F.when(to_champion, champion).otherwise(challenger), "shadow_model_id": shadow,
    })
