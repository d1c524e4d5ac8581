"""Training, scoring and explaining candidate models with Spark ML."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from propensity_spark.operators.customer360 import FEATURES
from propensity_spark.operators.labels import campaign_labels, event_tags, hash_split
from propensity_spark.operators.leads import top_leads
from propensity_spark.operators.metrics import THRESHOLD, adverse_impact, binary_metrics, curve, risk_slope
from propensity_spark.operators.prepare import impute
from propensity_spark.operators.scoring import contributions


@dataclass(frozen=True)
class Algorithm:
    """How a candidate is built: parameters it knows (name -> Spark name and type) and its estimator."""

    title: str
    short: str
    params: dict[str, tuple[str, Callable]]
    build: Callable[[int, int], object]
    scaled: bool = False


def _mlp(n: int, k: int) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=[k, 64, 32, 2], maxIter=500, seed=42)


TREES = {"max_depth": ("maxDepth", int)}

# Titles, defaults and parameter names are fixed values. Spark ML has no XGBoost or CatBoost: its boosted trees
# stand in for both, with their depth and step.
ALGORITHMS = {
    "linear_regression": Algorithm("Linear Regression", "lin_reg", {}, lambda n, k: LinearRegression()),
    "logistic_regression": Algorithm(
        "Logistic Regression", "log_reg", {"max_iter": ("maxIter", int), "C": ("regParam", float)},
        lambda n, k: LogisticRegression(maxIter=1000, regParam=1.0 / max(1, n), standardization=False), scaled=True),
    "xgboost": Algorithm(
        "XGBoost", "xgb", {**TREES, "n_estimators": ("maxIter", int), "learning_rate": ("stepSize", float)},
        lambda n, k: GBTClassifier(maxIter=100, maxDepth=5, stepSize=0.3, seed=42)),
    "catboost": Algorithm(
        "CatBoost", "cat", {"depth": ("maxDepth", int), "iterations": ("maxIter", int),
                            "learning_rate": ("stepSize", float)},
        lambda n, k: GBTClassifier(maxIter=100, maxDepth=6, stepSize=0.1, seed=42)),
    "random_forest": Algorithm(
        "Random Forest", "rf", {**TREES, "n_estimators": ("numTrees", int)},
        lambda n, k: RandomForestClassifier(numTrees=100, maxDepth=8, seed=42)),
    "pytorch_mlp": Algorithm("Neural Network", "mlp", {"max_iter": ("maxIter", int)}, _mlp, scaled=True),
}


@dataclass(frozen=True)
class Trained:
    """A fitted candidate. score() and explain() are DataFrame -> DataFrame."""

    model_id: str
    algorithm: str
    features: list[str]
    fitted: PipelineModel

    def score(self, df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
        """Add `score` in [0, 1] and `predicted_label`."""
        out = score_columns([self], df)
        return out.select(*df.columns, F.col("_score_0").alias("score")).withColumn(
            "predicted_label", (F.col("score") >= threshold).cast("int"))

    def weights(self) -> np.ndarray:
        """One weight per feature: coefficient, importance, or mean absolute first-layer weight."""
        model = self.fitted.stages[-1]
        if self.algorithm in ("linear_regression", "logistic_regression"):
            return model.coefficients.toArray()
        if self.algorithm == "pytorch_mlp":
            k, hidden = len(self.features), 64
            return np.abs(np.array(model.weights)[: k * hidden]).reshape(k, hidden).mean(axis=1)
        return model.featureImportances.toArray()

    def explain(self, df: DataFrame, top: int = 3) -> DataFrame:
        """Add the top contributions. Models fitted on scaled features are explained on scaled features."""
        weights = dict(zip(self.features, (float(w) for w in self.weights())))
        signed = self.algorithm in ("random_forest", "xgboost", "catboost")
        if not ALGORITHMS[self.algorithm].scaled:
            return contributions(df, weights, top, signed)
        scaler = self.fitted.stages[1]
        mean, std = scaler.mean.toArray(), scaler.std.toArray()
        names = {}
        scaled = df
        for i, f in enumerate(self.features):
            names[f"_scaled_{i}"] = weights[f]
            value = F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - float(mean[i])
            scaled = scaled.withColumn(f"_scaled_{i}", value / float(std[i]) if std[i] else F.lit(0.0))
        return contributions(scaled, names, top).drop(*names)


def _filled(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as double with NULL as 0; the values as given stay in _raw_ columns."""
    raw = df.withColumns({f"_raw_{f}": F.col(f) for f in features})
    return raw.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})


def _vectors(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """The assembled inputs `_vector` and the label."""
    assembler = VectorAssembler(inputCols=features, outputCol="_vector")
    return assembler.transform(_filled(df, features).select(*features, label)).select("_vector", label)


def _fit(vectors: DataFrame, facts, algorithm: str, features: list[str], label: str, params: dict | None,
         model_id: str) -> Trained:
    """Fit one candidate on assembled inputs; facts are their count n and the label's lowest and highest value."""
    spec = ALGORITHMS[algorithm]
    if algorithm != "linear_regression" and facts["lo"] == facts["hi"]:
        raise ValueError("single class")
    estimator = spec.build(facts["n"], len(features))
    estimator.setLabelCol(label)
    for name, value in (params or {}).items():
        if name in spec.params:
            spark_name, kind = spec.params[name]
            value = kind(value)
            value = 1.0 / (value * max(1, facts["n"])) if name == "C" else value
            estimator.set(estimator.getParam(spark_name), value)
    stages: list = []
    if spec.scaled:
        stages.append(StandardScaler(inputCol="_vector", outputCol="_scaled", withMean=True, withStd=True))
    estimator.setFeaturesCol("_scaled" if spec.scaled else "_vector")
    fitted = Pipeline(stages=[*stages, estimator]).fit(vectors)
    assembler = VectorAssembler(inputCols=features, outputCol="_vector")
    return Trained(model_id, algorithm, list(features), PipelineModel([assembler, *fitted.stages]))


def _facts(df: DataFrame, label: str):
    return df.agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi")).first()


def train(
    df: DataFrame, algorithm: str, features: list[str], label: str, params: dict | None = None, suffix: str = "custom",
    model_id: str | None = None,
) -> Trained:
    """Fit one candidate. Parameters an algorithm does not know are ignored; text numbers are converted."""
    model_id = model_id or f"{ALGORITHMS[algorithm].short}_{suffix}"
    return _fit(_vectors(df, features, label), _facts(df, label), algorithm, features, label, params, model_id)


def train_many(
    df: DataFrame, wanted: list[tuple[str, str, dict | None]], features: list[str], label: str
) -> list[tuple[Trained | Exception, float]]:
    """Fit candidates (model_id, algorithm, parameters) side by side; for each the model or its error, and seconds.

    The inputs are assembled once and kept while all fits read them, each from a thread of its own; under a fair
    scheduler every fit has its own pool. One that fails does not touch the others.
    """
    spark = df.sparkSession
    vectors = _vectors(df, features, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        facts = _facts(vectors, label)

        def run(model_id: str, algorithm: str, params: dict | None) -> tuple[Trained | Exception, float]:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", model_id)
            start = time.time()
            try:
                return _fit(vectors, facts, algorithm, features, label, params, model_id), time.time() - start
            except Exception as e:
                return e, 0.0

        with ThreadPoolExecutor(max_workers=max(1, len(wanted))) as pool:
            fits = [pool.submit(inheritable_thread_target(spark)(run), *w) for w in wanted]
            return [f.result() for f in fits]
    finally:
        vectors.unpersist()


def train_whole(
    df: DataFrame, wanted: list[tuple[str, str, dict | None]], features: list[str], label: str
) -> list[Trained]:
    """train_many() where every candidate is needed: all models, or an error that names each fit that failed."""
    fits = [fit for fit, _ in train_many(df, wanted, features, label)]
    failed = {w[0]: fit for w, fit in zip(wanted, fits) if isinstance(fit, Exception)}
    if failed:
        names = "; ".join(f"{model_id}: {fit}" for model_id, fit in failed.items())
        raise RuntimeError(f"not all models are fitted: {names}") from next(iter(failed.values()))
    return fits


def score_columns(models: list[Trained], df: DataFrame) -> DataFrame:
    """df with the score of models[i] as _score_i, in one pass, whichever features each of them has."""
    features = list(dict.fromkeys(f for m in models for f in m.features))
    out, made = _filled(df, features), [f"_raw_{f}" for f in features]
    for i, m in enumerate(models):
        names, last = {"_vector": f"_vector_{i}", "_scaled": f"_scaled_{i}"}, len(m.fitted.stages) - 1
        for at, stage in enumerate(m.fitted.stages):
            stage = stage.copy()
            for param in ("inputCol", "outputCol", "featuresCol"):
                if stage.hasParam(param) and stage.getOrDefault(param) in names:
                    stage.set(stage.getParam(param), names[stage.getOrDefault(param)])
            if at == last:
                for param in ("predictionCol", "probabilityCol", "rawPredictionCol"):
                    if stage.hasParam(param):
                        stage.set(stage.getParam(param), f"_{param}_{i}")
            out = stage.transform(out)
        if m.algorithm == "linear_regression":
            value = F.least(F.greatest(F.col(f"_predictionCol_{i}"), F.lit(0.0)), F.lit(1.0))
        else:
            value = F.get(vector_to_array(f"_probabilityCol_{i}"), F.lit(1))
            value = F.when(value.isNull() | F.isnan(value), 0.5).otherwise(value)
        out = out.withColumn(f"_score_{i}", value)
    raw = set(made)
    keep = [F.col(f"_raw_{c}").alias(c) if f"_raw_{c}" in raw else F.col(c) for c in df.columns]
    return out.select(*keep, *[f"_score_{i}" for i in range(len(models))])


def long_scores(
    models: list[Trained], df: DataFrame, champion: str, keep: list[str], threshold: float = THRESHOLD
) -> DataFrame:
    """One row per input row and model: scores of the champion, and of the others in shadow. One pass over df."""
    wide = wide_scores(models, df, champion, keep, "_each", threshold)
    return wide.select(*keep, F.inline("_each"))


def wide_scores(
    models: list[Trained], df: DataFrame, champion: str, keep: list[str], name: str, threshold: float = THRESHOLD
) -> DataFrame:
    """long_scores() as one row per input row: `name` is the array of all models' scores."""
    each = F.array(*[
        F.struct(F.lit(m.model_id).alias("model_id"), F.col(f"_score_{i}").alias("score"),
                 (F.col(f"_score_{i}") >= threshold).cast("int").alias("predicted_label"),
                 F.lit("champion" if m.model_id == champion else "shadow").alias("role"))
        for i, m in enumerate(models)])
    return score_columns(models, df).select(*keep, each.alias(name))


@dataclass
class Training:
    """Fitted candidates with their scoreboard, and the scored rows it was computed on."""

    models: list[Trained]
    scoreboard: DataFrame
    scored: DataFrame
    label: str
    cached: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Free the cached feature frame once the results are read."""
        for df in self.cached:
            df.unpersist()

    def curves(self, kind: str) -> DataFrame:
        return curve(self.scored, self.label, "score", kind, by=["model_id"])

    def risk(self) -> DataFrame:
        return risk_slope(self.scored, self.label, "score", by=["model_id"])

    def best(self) -> Trained:
        row = self.scoreboard.filter("status = 'Ready'").orderBy(F.col("auc").desc(), "place").first()
        return next(m for m in self.models if m.model_id == row["model_id"])


def train_all(
    df: DataFrame, test: DataFrame, algorithms: list[str], features: list[str], label: str, group: str | None = None,
    privileged: str = "Male", unprivileged: str = "Female", params: dict | None = None, suffix: str = "custom",
) -> Training:
    """Fit the candidates side by side and evaluate them together. A failing one gets a row Failed."""
    if test.limit(1).count() == 0:
        raise ValueError("no rows to evaluate on")
    known = [a for a in algorithms if a in ALGORITHMS]
    wanted = [(f"{ALGORITHMS[a].short}_{suffix}", a, (params or {}).get(a)) for a in known]
    models, notes = [], []
    for place, ((model_id, name, _), (fit, seconds)) in enumerate(zip(wanted, train_many(df, wanted, features, label))):
        failed = isinstance(fit, Exception)
        if not failed:
            models.append(fit)
        notes.append((place, model_id, ALGORITHMS[name].title, f"Failed: {fit}" if failed else "Ready",
                      round(seconds * 1000, 2)))
    notes = test.sparkSession.createDataFrame(
        notes, "place int, model_id string, algorithm_type string, status string, latency_ms double")
    keep = [label] + ([group] if group else [])
    if not models:
        empty = test.limit(0).select(*keep, F.lit("").alias("model_id"), F.lit(0.0).alias("score"),
                                     F.lit(0).alias("predicted_label"))
        scored = empty
    else:
        # Metrics, fairness and curves all read these narrow rows.
        scored = long_scores(models, test, "", keep).drop("role").persist(StorageLevel.MEMORY_AND_DISK)
    metrics = binary_metrics(scored, label, "score", by=["model_id"])
    if group:
        fair = adverse_impact(scored, "predicted_label", group, privileged, unprivileged, by=["model_id"])
        metrics = metrics.join(fair, "model_id", "left")
    else:
        metrics = metrics.withColumn("adverse_impact_ratio", F.lit(1.0))
    board = notes.join(metrics, "model_id", "left").select(
        "place", "model_id", "algorithm_type", "status", F.coalesce("roc_auc", F.lit(0.5)).alias("auc"),
        "pr_auc", "f1_score", "log_loss", "ks_statistic", "gini",
        F.coalesce("adverse_impact_ratio", F.lit(1.0)).alias("fairness_adverse_impact_ratio"), "latency_ms",
    )
    return Training(models, board, scored, label, [scored])


# The metrics a registry keeps (fixed values).
METRICS = ["roc_auc", "pr_auc", "f1_score", "log_loss", "ks_statistic"]


def train_registered(
    registry: DataFrame, df: DataFrame, features: list[str] = FEATURES, label: str = "is_conversion_successful"
) -> tuple[list[Trained], DataFrame]:
    """Fit every registered model of a known algorithm on the labelled rows, with its stored hyper-parameters.

    Returns the models, and the registry with their metrics as baselines and merged into the live metrics, and the
    `error` of a model whose fit failed. Rules and models that fail keep their rows.
    """
    by_title = {a.title: name for name, a in ALGORITHMS.items()} | {"PyTorch MLP": "pytorch_mlp"}
    known = df.filter(F.col(label).isin(0, 1))
    rows = registry.filter(F.col("model_category") != "Rule").orderBy("seq").collect()
    wanted = [(r["model_id"], by_title[r["algorithm_type"]], r["hyperparameters"]) for r in rows
              if r["algorithm_type"] in by_title]
    fits = train_many(known, wanted, features, label)
    models = [fit for fit, _ in fits if isinstance(fit, Trained)]
    failed = {w[0]: str(fit) for w, (fit, _) in zip(wanted, fits) if isinstance(fit, Exception)}
    if not models:
        return [], registry.withColumn("error", _errors(failed))
    found = binary_metrics(long_scores(models, known, "", [label]), label, "score", by=["model_id"])
    found = found.select("model_id", F.create_map(*[x for m in METRICS for x in (F.lit(m), F.col(m))]).alias("_new"))
    joined = registry.join(F.broadcast(found), "model_id", "left")
    kept = F.map_filter("live_metrics", lambda k, _: ~k.isin(METRICS))
    return models, joined.withColumns({
        "baselines": F.coalesce("_new", "baselines"),
        "live_metrics": F.when(F.col("_new").isNull(), F.col("live_metrics")).otherwise(
            F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,double>")), F.col("_new"))),
    }).drop("_new").withColumn("error", _errors(failed))


def _errors(failed: dict[str, str]) -> Column:
    """The message of each model that failed."""
    out = F.lit(None).cast("string")
    for model_id, message in failed.items():
        out = F.when(F.col("model_id") == model_id, message).otherwise(out)
    return out


def train_campaign(
    population: DataFrame, campaign: str, algorithms: list[str], features: list[str] = FEATURES, **options
) -> tuple[Training, DataFrame]:
    """On-demand training on the whole population: the scoreboard and the 100 best leads of the best model."""
    df = campaign_labels(population, campaign).persist(StorageLevel.MEMORY_AND_DISK)
    result = train_all(df, df, algorithms, features, "label", **options)
    result.cached.append(df)
    leads = top_leads(result.best().score(df), "score")
    return result, leads


def train_studio(
    cohort: DataFrame, campaign: str, algorithms: list[str], features: list[str], imputations: dict[str, str],
    train_ratio: float, tags: dict | None = None, key: str = "customer_id", fit_on: str = "cohort", **options,
) -> Training:
    """Label, tag, impute, split, train, and evaluate on the test part."""
    strategies = {f: imputations.get(f, "zero") for f in features}
    used = [f for f, s in strategies.items() if s != "drop"]
    if not used:
        raise ValueError("At least one feature must be selected after imputation drops.")
    df = event_tags(campaign_labels(cohort, campaign), **(tags or {}))
    # The target may rest on a feature that is imputed, so labels come first.
    df = hash_split(df, key, train_ratio).persist(StorageLevel.MEMORY_AND_DISK)
    if df.limit(1).count() == 0:
        raise ValueError("Selected cohort returned zero customer records.")
    if df.limit(10).count() < 10:
        raise ValueError("Cohort size is too small to split and train models.")
    filled = impute(df, strategies, df.filter("part = 'train'") if fit_on == "train" else None)
    result = train_all(filled.filter("part = 'train'"), filled.filter("part = 'test'"), algorithms, used, "label",
                       suffix="studio", **options)
    result.cached.append(df)
    return result
