"""Metric and drift history from stored counters: a new day reads the new rows, and old days are never read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, LongType, StringType, StructField, StructType

from propensity_spark.functions.scalar import bin_index, linspace, number, ratio
from propensity_spark.operators.drift import PSI_LIMIT, psi_from_counts
from propensity_spark.operators.metrics import DEFAULTS, metrics_of_counts


class _Counters:
    """Additive counters in a folder per batch, partitioned by step. A batch that is written twice counts once."""

    def __init__(self, spark: SparkSession, folder: str, fields: list[StructField]):
        self.spark, self.folder = spark, folder
        self.schema = StructType([*fields, StructField("step", DateType()), StructField("batch", StringType())])

    def write(self, rows: DataFrame, batch: str) -> None:
        parts = rows.hint("rebalance", F.col("step"))
        parts.write.mode("overwrite").partitionBy("step").parquet(f"{self.folder}/batch={batch}")

    def read(self, first: str | None, last: str | None) -> DataFrame:
        """The counters of the steps first..last; other steps' files are pruned."""
        rows = self.spark.read.schema(self.schema).option("basePath", self.folder).parquet(self.folder)
        if first is not None:
            rows = rows.where(F.col("step") >= F.lit(first).cast("date"))
        return rows if last is None else rows.where(F.col("step") <= F.lit(last).cast("date"))


def _step(time: str, step: str) -> Column:
    return F.date_trunc(step, F.col(time).cast("timestamp_ntz")).cast("date").alias("step")


class MetricHistory:
    """Metrics per step of a growing log, from counters per (step, score): rows, positives, negatives.

    Rows are appended batch by batch. An outcome that arrives late is appended as a correction of its row's counters,
    so neither the log nor other days are read again. The result equals metric_history() over the whole log.
    """

    def __init__(self, spark: SparkSession, folder: str, score_type: DataType):
        self.spark, self.folder = spark, folder
        self._counters = _Counters(spark, f"{folder}/scores", [
            StructField("score", score_type), *[StructField(c, LongType()) for c in ("n", "pos", "neg")]])

    def append(
        self, df: DataFrame, batch: str, label: str, score: str, time: str, step: str = "day",
        old_label: str | None = None,
    ) -> None:
        """Count the rows of df as a batch. With `old_label` they are rows counted before, whose label was that one.

        The same batch again replaces what it counted, so a job may run twice. One map-side combined aggregate of df.
        """
        def of(name: str, value: int) -> Column:
            return F.count_if(F.col(name) == value)

        n, pos, neg = F.count(F.lit(1)), of(label, 1), of(label, 0)
        if old_label is not None:
            n, pos, neg = F.lit(0).cast("bigint"), pos - of(old_label, 1), neg - of(old_label, 0)
        rows = df.groupBy(_step(time, step), F.col(score).alias("score")).agg(
            n.alias("n"), pos.alias("pos"), neg.alias("neg"))
        self._counters.write(rows, batch)

    def counters(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """(step, score, n, pos, neg) of all batches together."""
        return self._counters.read(first, last).groupBy("step", "score").agg(
            *[F.sum(c).alias(c) for c in ("n", "pos", "neg")])

    def _bins(self, rows: DataFrame, prefix: str) -> list[Column]:
        place = bin_index(F.col("score").cast("double"), linspace(0.0, 1.0, 10))
        return [F.sum("n").alias(f"{prefix}_n"),
                *[F.sum(F.when(place == i, F.col("n")).otherwise(0)).alias(f"{prefix}_{i}") for i in range(10)]]

    def set_baseline(self, before: str) -> None:
        """Keep the score bins of the steps before a day as what later steps are compared with."""
        rows = self._counters.read(None, None).where(F.col("step") < F.lit(before).cast("date"))
        base = rows.agg(*self._bins(rows, "e"))
        base.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in base.columns]).coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/baseline")

    def history(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """One row per step: the metrics, and PSI against the kept baseline; as metric_history() gives them."""
        counts = self.counters(first, last)
        known = counts.where(F.col("score").isNotNull() & ((F.col("pos") > 0) | (F.col("neg") > 0)))
        if counts.schema["score"].dataType.typeName() in ("double", "float"):
            known = known.where(~F.isnan("score"))
        metrics = metrics_of_counts(known.select("step", "score", "pos", "neg"), by=["step"])
        base = self.spark.read.parquet(f"{self.folder}/baseline").first().asDict()
        live = counts.groupBy("step").agg(*self._bins(counts, "a")).where("a_n > 0")
        psi = live.withColumns({k: F.lit(v) for k, v in base.items()}).select(
            F.col("step").alias("_step"), psi_from_counts(10).alias("psi"))
        out = psi.join(metrics, F.col("_step") == F.col("step"), "left")
        values = [F.coalesce(F.col(c), F.lit(v).cast(metrics.schema[c].dataType)).alias(c) for c, v in DEFAULTS.items()]
        return out.select(F.col("_step").alias("step"), *values, "psi").orderBy("step")


class FeatureHistory:
    """Drift of features per step of a growing table, from counters per (step, feature, bin) and a sketch of values.

    The bins span the baseline's range, as in feature_drift(). The sketches (KLL) merge over any steps and answer
    quantiles of features whose range is not bounded; their rank error is about one percent.
    """

    BINS = 10

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._bins = _Counters(spark, f"{folder}/bins", [
            StructField("feature", StringType()), *[StructField(f"a_{i}", LongType()) for i in range(self.BINS)],
            StructField("a_n", LongType()), StructField("total", spark.createDataFrame([], "x double").schema["x"].dataType)])
        self._sketches = _Counters(spark, f"{folder}/sketches", [
            StructField("feature", StringType()), spark.createDataFrame([], "sketch binary").schema["sketch"]])

    def set_baseline(self, df: DataFrame, cols: list[str]) -> None:
        """Keep the range of every feature in df, and its counters there: two scans of df, a row per feature."""
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), number(c).alias("value")) for c in cols])
        rows = df.select(F.inline(pairs))
        limits = rows.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
        binned = self._binned(rows.join(F.broadcast(limits), "feature"), ["feature"], "e")
        limits.join(binned, "feature", "left").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/baseline")

    def _baseline(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/baseline")

    def _binned(self, rows: DataFrame, by: list[str], prefix: str) -> DataFrame:
        """Counters of rows (by, value, low, high)."""
        width = F.col("high") - F.col("low")
        scaled = F.when(width > 0, (F.col("value") - F.col("low")) / width).otherwise(F.lit(0.0))
        place = bin_index(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)), linspace(0.0, 1.0, self.BINS))
        return rows.where(F.col("value").isNotNull()).groupBy(*by).agg(
            *[F.count_if(place == i).alias(f"{prefix}_{i}") for i in range(self.BINS)],
            F.count(F.lit(1)).alias(f"{prefix}_n"), F.sum("value").alias("total" if prefix == "a" else "e_total"))

    def append(self, df: DataFrame, batch: str, time: str, step: str = "day") -> None:
        """Count the rows of df as a batch, for the features of the baseline; the same batch again replaces it."""
        base = self._baseline().select("feature", "low", "high")
        cols = [r["feature"] for r in base.select("feature").collect() if r["feature"] in df.columns]
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), number(c).alias("value")) for c in cols])
        rows = df.select(_step(time, step), F.inline(pairs)).where(F.col("value").isNotNull())
        self._bins.write(self._binned(rows.join(F.broadcast(base), "feature"), ["step", "feature"], "a"), batch)
        sketches = rows.groupBy("step", "feature").agg(F.kll_sketch_agg_double("value").alias("sketch"))
        self._sketches.write(sketches, batch)

    def drift(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """(step, feature, n, baseline_mean, live_mean, psi, status) per step."""
        names = [f"a_{i}" for i in range(self.BINS)] + ["a_n", "total"]
        live = self._bins.read(first, last).groupBy("step", "feature").agg(*[F.sum(c).alias(c) for c in names])
        out = live.join(F.broadcast(self._baseline()), "feature").select(
            "step", "feature", F.col("a_n").alias("n"),
            F.round(ratio(F.col("e_total"), F.col("e_n")), 4).alias("baseline_mean"),
            F.round(ratio(F.col("total"), F.col("a_n")), 4).alias("live_mean"), psi_from_counts(self.BINS).alias("psi"))
        return out.withColumn("status", F.when(F.col("psi") >= PSI_LIMIT, "Critical").otherwise("Stable"))

    def quantiles(self, shares: list[float], first: str | None = None, last: str | None = None) -> DataFrame:
        """(feature, n, q_0, q_1, ...): quantiles over the steps first..last, from merged sketches."""
        merged = self._sketches.read(first, last).groupBy("feature").agg(F.kll_merge_agg_double("sketch").alias("s"))
        return merged.select("feature", F.kll_sketch_get_n_double("s").alias("n"), *[
            F.kll_sketch_get_quantile_double("s", F.lit(q)).alias(f"q_{i}") for i, q in enumerate(shares)])
