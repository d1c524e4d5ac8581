import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from propensity_spark.operators import drift as dr
from propensity_spark.operators import metrics as me
from tests.conftest import rows


def brute_metrics(y, s):
    """All metrics by their definitions, over every pair and every threshold."""
    y, s = np.array(y), np.array(s, dtype=float)
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) if len(pos) and len(neg) else 0.5
    ap, recall = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        r = (y[hit] == 1).sum() / max(1, len(pos))
        ap += (r - recall) * (y[hit] == 1).mean()
        recall = r
    pred = s >= 0.55
    tp = (pred & (y == 1)).sum()
    f1 = 2 * tp / (pred.sum() + len(pos)) if pred.sum() + len(pos) else 0.0
    p = np.clip(s, 2.220446049250313e-16, 1 - 2.220446049250313e-16)
    loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    ks = max((abs((pos <= t).mean() - (neg <= t).mean()) for t in s), default=0.0) if len(pos) and len(neg) else 0.0
    return {"roc_auc": auc, "pr_auc": ap, "f1_score": f1, "log_loss": loss, "ks_statistic": ks}


def scored(spark, y, s, kind="double"):
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    return df.withColumn("score", F.col("score").cast(kind))


@pytest.mark.parametrize("kind,parts", [("double", 1), ("double", 16), ("decimal(5,4)", 4)])
def test_metrics_match_their_definitions(spark, kind, parts):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300)
    s = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)  # many ties, exact 0 and 1
    y[:100], s[:100] = 1, 0.5  # a third of the rows share one score
    got = me.binary_metrics(scored(spark, y, s, kind).repartition(parts), "label", "score").first()
    for name, value in brute_metrics(y, s).items():
        assert got[name] == pytest.approx(value, abs=6e-5), name
    flipped = me.binary_metrics(scored(spark, y, 1 - s, kind), "label", "score").first()
    assert flipped["roc_auc"] == pytest.approx(1 - got["roc_auc"], abs=1e-4)
    assert got["gini"] == pytest.approx(2 * got["roc_auc"] - 1, abs=1e-9)


def test_metric_defaults(spark):
    none = me.binary_metrics(scored(spark, [-1, -1], [0.1, 0.9]), "label", "score").first()
    assert (none["n_labelled"], none["roc_auc"], none["pr_auc"], none["f1_score"], none["log_loss"],
            none["ks_statistic"]) == (0, 0.5, 0.5, 0.0, 0.693, 0.0)
    one = me.binary_metrics(scored(spark, [0, 0], [0.1, 0.9]), "label", "score").first()
    assert (one["roc_auc"], one["pr_auc"], one["ks_statistic"]) == (0.5, 0.0, 0.0)
    flat = me.binary_metrics(scored(spark, [0, 1, 0, 1], [0.5] * 4), "label", "score").first()
    assert (flat["roc_auc"], flat["pr_auc"], flat["f1_score"]) == (0.5, 0.5, 0.0)


def test_metrics_per_group_equal_each_group_alone(spark):
    df = spark.range(400).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 2).cast("int").alias("label"),
                                 (F.col("id") * 37 % 101 / 101).alias("score"))
    for r in me.binary_metrics(df, "label", "score", by=["g"]).collect():
        alone = me.binary_metrics(df.filter(F.col("g") == r["g"]), "label", "score").first()
        assert r[1:] == tuple(alone)


def test_a_group_without_a_name_is_kept(spark):
    df = spark.range(40).select(F.when(F.col("id") % 2 == 0, "x").alias("g"), (F.col("id") % 3 % 2).cast("int").alias("label"),
                                (F.col("id") / 40).cast("decimal(5,4)").alias("score"))
    out = {r["g"]: r["n_labelled"] for r in me.binary_metrics(df, "label", "score", by=["g"]).collect()}
    assert out == {None: 20, "x": 20}


def test_both_reads_of_the_counts_share_a_shuffle(spark):
    df = spark.range(40).select((F.col("id") % 2).alias("g"), F.lit(1).alias("label"),
                                (F.col("id") / 40).cast("decimal(5,4)").alias("score"))
    out = me.binary_metrics(df, "label", "score", by=["g"])
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [5, 40])
def test_curves(spark, n):
    rng = np.random.default_rng(n)
    y, s = rng.integers(0, 2, n), np.round(rng.random(n), 3)
    y[0], y[1] = 0, 1
    cuts = sorted(set(s), reverse=True)
    p, q = (y == 1).sum(), (y == 0).sum()
    roc = [(0.0, 0.0)] + [(((s >= t) & (y == 0)).sum() / q, ((s >= t) & (y == 1)).sum() / p) for t in cuts]
    pr = [(((s >= t) & (y == 1)).sum() / p, (y[s >= t] == 1).mean()) for t in reversed(cuts)] + [(0.0, 1.0)]
    for kind, want in (("roc", roc), ("pr", pr)):
        got = me.curve(scored(spark, y, s), "label", "score", kind).orderBy("idx").collect()
        m = len(want) - 1
        assert [(r["x"], r["y"]) for r in got] == [
            pytest.approx(want[i * m // 14], abs=6e-5) for i in range(15)]


def test_risk_slope_counts_an_edge_twice(spark):
    df = scored(spark, [1, 0, 1, 1, 0, -1], [0.2, 0.2, 0.1, 1.0, 0.5, 0.3])
    got = {r["bin"]: (r["predicted_rate"], r["actual_rate"], r["n"]) for r in me.risk_slope(df, "label", "score").collect()}
    assert got == {"0-20%": (0.1667, 0.6667, 3), "20-40%": (0.2, 0.5, 2), "40-60%": (0.5, 0.0, 1), "60-80%": (0.7, 0.0, 0),
                   "80-100%": (1.0, 1.0, 1)}
    half = {r["bin"]: r["n"] for r in me.risk_slope(df, "label", "score", half_open=True).collect()}
    assert sum(half.values()) == 5 and half["0-20%"] == 1


def test_adverse_impact(frame):
    def ratio(data):
        df = frame(data, "g string, label int")
        return me.adverse_impact(df, "label", "g", "Male", "Female").first()[0]

    assert ratio([("Male", 1), ("Male", 0), ("Female", 1), ("Female", 0), ("Female", 0), ("Female", 0)]) == 0.5
    assert ratio([("Male", 0), ("Female", 1)]) == 1.0
    assert ratio([("Male", 1)]) == 1.0
    assert ratio([]) == 1.0


def test_score_summary_of_nothing(spark):
    assert rows(me.score_summary(scored(spark, [], []), "score")) == [(0, 0.0)]


# ---- drift

def sides(spark, expected, actual):
    data = [("expected", float(v)) for v in expected] + [("actual", float(v)) for v in actual]
    return spark.createDataFrame(data, "side string, score double")


def brute_psi(e, a):
    edges = np.linspace(0, 1, 11)
    share = lambda v: np.where((h := np.histogram(v, edges)[0] / len(v)) == 0, 1e-4, h)
    x, y = share(e), share(a)
    x, y = x / x.sum(), y / y.sum()
    return float(np.sum((y - x) * np.log(y / x)))


def test_psi_bounds_and_definition(spark):
    rng = np.random.default_rng(42)
    e, shifted = rng.normal(0.5, 0.1, 1000), rng.normal(0.8, 0.1, 1000)  # some values beyond 1
    same = dr.psi(sides(spark, e, e), "side", "score").first()[0]
    far = dr.psi(sides(spark, e, shifted), "side", "score").first()[0]
    assert same == 0.0 and far >= 0.25
    assert far == pytest.approx(brute_psi(e, shifted), abs=6e-5)
    assert dr.psi(sides(spark, e, []), "side", "score").first()[0] == 0.0
    assert dr.psi(sides(spark, [], []), "side", "score").first()[0] == 0.0


def test_ks_is_symmetric_and_bounded(spark):
    rng = np.random.default_rng(1)
    e, a = rng.normal(0.5, 0.1, 500), rng.normal(0.6, 0.1, 400)
    one, two = (dr.ks(sides(spark, *p), "side", "score").first()[0] for p in ((e, a), (a, e)))
    want = max(abs((e <= t).mean() - (a <= t).mean()) for t in np.concatenate([e, a]))
    assert one == two == pytest.approx(want, abs=6e-5)
    assert dr.ks(sides(spark, [0.0], [1.0]), "side", "score").first()[0] == 1.0
    assert dr.ks(sides(spark, e, e), "side", "score").first()[0] == 0.0
    assert dr.ks(sides(spark, [], [0.5]), "side", "score").first()[0] == 0.0


def test_histogram_keeps_empty_bins(spark):
    got = dr.score_distribution(sides(spark, [0.0, 1.0, 1.0, 2.0], [0.5]), "side", "score").collect()
    assert len(got) == 19 and sum(r["expected"] for r in got) == 3 and got[-1]["expected"] == 2
    assert got[9]["actual"] == 1 and got[0]["midpoint"] == 0.026
    assert all(r["expected"] == 0 for r in dr.score_distribution(sides(spark, [], []), "side", "score").collect())


def test_feature_drift_status_and_odd_features(spark):
    base = spark.range(1000).select((F.col("id") % 100).alias("same"), (F.col("id") % 100).alias("moved"),
                                    F.lit(2.0).alias("fixed"), F.lit(None).cast("double").alias("empty"))
    live = base.withColumn("moved", F.col("moved") + 60)
    got = {r["feature"]: r for r in dr.feature_drift(dr.two_sides(base, live), "side", base.columns).collect()}
    assert set(got) == {"same", "moved", "fixed", "empty"}
    assert tuple(got["empty"])[1:] == (None, None, 0.0, "Stable")
    assert got["same"]["psi"] == 0.0 and got["same"]["status"] == "Stable"
    assert got["moved"]["status"] == "Critical" and got["moved"]["live_mean"] == 109.5
    assert got["fixed"]["psi"] == 0.0


@pytest.fixture(scope="module")
def models(frame):
    return frame([("a", 0, "champion", {"roc_auc": 0.8}), ("m", 1, "migrated", {"roc_auc": 0.99}),
                  ("b", 2, "challenger", {"roc_auc": 0.9}), ("c", 3, "challenger", {"roc_auc": 0.9}), ("d", 4, "challenger", {})],
                 "model_id string, seq int, status string, baselines map<string,double>")


def test_alert_and_failover(models, frame):
    assert dr.best_challenger(models, "a").first()["model_id"] == "b"
    assert dr.best_challenger(models, "b").first()["model_id"] == "c"
    assert dr.best_challenger(models.filter("model_id = 'm'"), "a").first() is None

    def decide(auc, psi, mode, frame_of_models=models):
        live = frame([(auc, psi, 0.9)], "roc_auc double, psi double, fairness double")
        return tuple(dr.failover(dr.drift_alert(frame_of_models, live, "a", mode), mode).first())[2:4]

    assert decide(0.8, 0.1, "automatic") == ("none", "a")
    assert decide(0.8, 0.25, "automatic") == ("promote", "b")
    assert decide(0.74, 0.1, "manual") == ("flag", "a")
    assert decide(0.75, 0.1, "manual") == ("none", "a")
    assert decide(0.1, 0.9, "automatic", models.filter("model_id = 'a'")) == ("none", "a")
    with pytest.raises(ValueError):
        decide(0.1, 0.1, "sometimes")


def test_history_has_one_row_per_day(spark):
    df = spark.range(90).select(
        (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 10 / 10).alias("score"),
        F.timestamp_add("HOUR", (F.col("id") % 3 * 24).cast("int"), F.lit("2024-01-01 05:00:00").cast("timestamp_ntz")).alias("t"))
    got = dr.metric_history(df, "label", "score", "t", "2024-01-02").collect()
    assert [str(r["step"]) for r in got] == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert got[0]["psi"] == 0.0 and all(not math.isnan(r["roc_auc"]) for r in got)
