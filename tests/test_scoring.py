import math
from dataclasses import replace

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from propensity_spark.operators import models as md
from propensity_spark.operators import scoring as sc
from propensity_spark.operators.customer360 import FEATURES
from propensity_spark.plans import model_queries as mq
from propensity_spark.sources.model_store import Serving
from propensity_spark.sources.readers import Tables
from propensity_spark.streaming import jobs
from tests.conftest import rows

FAST = {"logistic_regression": {"max_iter": "20", "C": 0.5}, "xgboost": {"n_estimators": 3, "max_depth": 2},
        "catboost": {"iterations": 3, "depth": 2, "unknown": 9}, "random_forest": {"n_estimators": 5, "max_depth": 3},
        "pytorch_mlp": {"max_iter": 5}}


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(42)
    data = [(i, "Male" if i % 2 else "Female", *map(float, rng.random(15)), int(rng.integers(0, 2))) for i in range(100)]
    data = [(*r[:2], None, *r[3:]) if r[0] % 10 == 0 else r for r in data]  # some ages are missing
    schema = "customer_id int, gender string, " + ", ".join(f"{f} double" for f in FEATURES) + ", target int"
    return spark.createDataFrame(data, schema).persist()


def test_stored_coefficients(frame):
    df = frame([(1, 2.0, None), (2, -1.0, 4.0)], "customer_id int, a double, b double")
    out = sc.linear_score(df, {"a": 0.5, "b": -1.0}, 0.25).collect()
    assert [r["score"] for r in out] == pytest.approx([1 / (1 + math.exp(-1.25)), 1 / (1 + math.exp(4.25))])
    assert [r["predicted_label"] for r in out] == [1, 0]
    flat = sc.linear_score(df, {"a": 0.5, "b": -1.0}, 0.25, "identity").collect()
    assert [r["score"] for r in flat] == [1.0, 0.0]


def test_contributions_by_size_or_sign(frame):
    df = frame([(1.0, -5.0, 2.0, None)], "a double, b double, c double, d double")
    weights = {c: 1.0 for c in "abcd"}
    names = [f"explanation_coeff_{i}" for i in (1, 2, 3)]
    assert rows(sc.contributions(df, weights).select(*names)) == [(-5.0, 2.0, 1.0)]
    assert rows(sc.contributions(df, weights, signed=True).select(*names)) == [(2.0, 1.0, 0.0)]
    assert rows(sc.contributions(df, {"a": 1.0}).select(*names)) == [(1.0, None, None)]


def test_batch_scores_repeat(people):
    weights = {"age": 0.1, "annual_income": 0.2, "credit_score": 0.3}
    args = (people, 25, "m", "credit_card", weights, 0.0)
    one, two = (sorted(rows(sc.batch_score(*args, run="r1"))) for _ in range(2))
    assert one == two and len(one) == 25
    other = {r["prediction_id"] for r in sc.batch_score(*args, run="r2").collect()}
    assert not other & {r[0] for r in one}


@pytest.mark.parametrize("name", list(md.ALGORITHMS))
def test_model_contract(people, name):
    used = FEATURES if name != "xgboost" else FEATURES[:4]
    model = md.train(people, name, used, "target", FAST.get(name))
    out = model.score(people).collect()
    assert len(out) == 100 and set(people.columns) <= set(out[0].asDict())
    assert all(0.0 <= r["score"] <= 1.0 for r in out)
    assert all(r["predicted_label"] == int(r["score"] >= 0.55) for r in out)
    assert sum(r["age"] is None for r in out) == 10  # the input is handed through unchanged
    weights = model.weights()
    assert len(weights) == len(used) and np.isfinite(weights).all()
    explained = model.explain(people).select(*[f"explanation_coeff_{i}" for i in (1, 2, 3)]).collect()
    assert len(explained) == 100 and all(None not in tuple(r) for r in explained)


def test_parameters_reach_the_estimator(people):
    assert md.train(people, "random_forest", FEATURES, "target", FAST["random_forest"]).fitted.stages[-1].getNumTrees == 5
    fitted = md.train(people, "logistic_regression", FEATURES, "target", {"C": "0.5", "bogus": 1}).fitted.stages[-1]
    assert fitted.getRegParam() == pytest.approx(1 / (0.5 * 100))


def test_learnable_target_is_learnt(spark):
    df = spark.range(600).select(F.col("id").alias("customer_id"), (F.col("id") * 37 % 101 / 101).alias("a"),
                                 (F.col("id") * 17 % 89 / 89).alias("b"))
    df = df.withColumn("target", (F.col("a") + F.col("b") > 1).cast("int"))
    result = md.train_all(df, df, ["linear_regression", "logistic_regression", "xgboost"], ["a", "b"], "target", params=FAST)
    assert all(r["auc"] > 0.9 for r in result.scoreboard.collect())


def test_failures_are_isolated(people):
    one = people.withColumn("target", F.lit(1))
    result = md.train_all(one, one, ["logistic_regression", "linear_regression", "nonsense"], FEATURES, "target",
                          group="gender", params=FAST)
    board = {r["model_id"]: r for r in result.scoreboard.collect()}
    assert set(board) == {"log_reg_custom", "lin_reg_custom"}
    assert board["log_reg_custom"]["status"] == "Failed: single class"
    assert (board["log_reg_custom"]["auc"], board["log_reg_custom"]["fairness_adverse_impact_ratio"]) == (0.5, 1.0)
    assert board["lin_reg_custom"]["status"] == "Ready"
    none = md.train_all(one, one, ["logistic_regression"], FEATURES, "target").scoreboard.collect()
    assert [r["auc"] for r in none] == [0.5]


def studio_frame(people):
    return people.withColumns({"late_payment_flag": F.col("target") == 1, "monthly_sip_amount": F.col("monthly_sip_amount")})


def test_studio_run(people):
    result = md.train_studio(
        studio_frame(people), "defaulter", ["logistic_regression", "random_forest"], FEATURES[:6],
        {"age": "median", "credit_score": "mean", "credit_limit": "drop"}, 0.7, group="gender", params=FAST, fit_on="train")
    board = result.scoreboard.collect()
    assert [r["status"] for r in board] == ["Ready", "Ready"]
    assert result.models[0].features == ["age", "annual_income", "credit_score", "monthly_spend", "average_utilization"]
    assert result.curves("roc").count() == result.curves("pr").count() == 30
    assert result.risk().count() == 10
    assert result.best().model_id in {r["model_id"] for r in board}
    result.release()


def test_studio_errors(people):
    df = studio_frame(people)
    with pytest.raises(ValueError, match="zero customer"):
        md.train_studio(df.limit(0), "defaulter", ["xgboost"], ["age"], {}, 0.7)
    with pytest.raises(ValueError, match="too small"):
        md.train_studio(df.limit(9), "defaulter", ["xgboost"], ["age"], {}, 0.7)
    with pytest.raises(ValueError, match="At least one feature"):
        md.train_studio(df, "defaulter", ["xgboost"], ["age"], {"age": "drop"}, 0.7)
    with pytest.raises(ValueError, match="Invalid campaign"):
        md.train_studio(df, "nothing", ["xgboost"], ["age"], {}, 0.7)


def test_campaign_leads_and_shadow_scores(people):
    result, leads = md.train_campaign(studio_frame(people), "defaulter", ["linear_regression", "logistic_regression"],
                                      FEATURES, params=FAST)
    top = leads.collect()
    assert len(top) == 100 and [r["score"] for r in top] == sorted((r["score"] for r in top), reverse=True)
    long = md.long_scores(result.models, people, "log_reg_custom", ["customer_id"])
    roles = {(r["model_id"], r["role"]): r["count"] for r in long.groupBy("model_id", "role").count().collect()}
    assert roles == {("log_reg_custom", "champion"): 100, ("lin_reg_custom", "shadow"): 100}


def test_registered_models_get_fresh_metrics(spark, people):
    schema = ("model_id string, seq int, algorithm_type string, model_category string, hyperparameters map<string,string>, "
              "baselines map<string,double>, live_metrics map<string,double>")
    registry = spark.createDataFrame([
        ("a", 0, "XGBoost", "ML", {"n_estimators": "2", "max_depth": "2", "unknown": "x"}, {"roc_auc": 0.1}, {"latency": 9.0, "roc_auc": 0.1}),
        ("b", 1, "Linear Regression", "ML", {}, {}, None),
        ("r", 2, "XGBoost", "Rule", {}, {"roc_auc": 0.2}, {}), ("u", 3, "Prophet", "ML", {}, {"roc_auc": 0.3}, {})], schema)
    pending = people.withColumn("target", F.when(F.col("customer_id") < 5, -1).otherwise(F.col("target")))
    models, out = md.train_registered(registry, pending, FEATURES[:5], "target")
    rows_ = {r["model_id"]: r for r in out.collect()}
    assert [m.model_id for m in models] == ["a", "b"] and set(out.columns) == {*registry.columns, "error"} and len(rows_) == 4
    assert set(rows_["a"]["baselines"]) == set(md.METRICS) and rows_["a"]["baselines"]["roc_auc"] > 0.5
    assert rows_["a"]["live_metrics"] == {"latency": 9.0, **rows_["a"]["baselines"]}
    assert rows_["b"]["live_metrics"] == rows_["b"]["baselines"]
    assert rows_["r"]["baselines"] == {"roc_auc": 0.2} and rows_["u"]["live_metrics"] == {}


@pytest.fixture(scope="module")
def serving(people):
    wanted = [("lin", "linear_regression", None), ("log", "logistic_regression", FAST["logistic_regression"])]
    return Serving([fit for fit, _ in md.train_many(people, wanted, FEATURES, "target")], "log")


def test_requests_of_one_file_are_scored_on_all_cores(spark, people, serving):
    requests = people.select((F.col("customer_id") + 50).alias("customer_id")).coalesce(1)
    out = jobs.served_requests(requests, people, serving, ["customer_id"])
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert out.count() == 200 and out.where("customer_id >= 100").select("model_id", "score").distinct().count() == 2
    wide = jobs.served_requests(requests, people, serving, ["customer_id"], wide="all")
    assert sorted(rows(wide.selectExpr("customer_id", "inline(all)"))) == sorted(rows(out))


def test_live_scores_are_compared_per_request_and_its_customers_assembled_once(spark, people, serving, tmp_path, monkeypatch):
    events = [(i, i % 120) for i in range(60)] + [(7, 7), (None, 3)]  # a repeated and a missing id, unknown customers
    events = spark.createDataFrame(events, "event_id long, user_id long")
    kinds = [(f.name, f.dataType) for f in Tables(spark, "/root/testdata/sf0.001")["events"].schema if f.name not in events.columns]
    pq.write_table(events.withColumns({n: F.lit(None).cast(k) for n, k in kinds}).toArrow(), f"{tmp_path}/events.parquet")
    monkeypatch.setattr(mq, "_serving", lambda t: (serving, people.withColumn("label", F.col("target"))))
    monkeypatch.setattr(mq.b, "profile", lambda t: pytest.fail("the customers are assembled again"))
    got = rows(mq.stream_champion(Tables(spark, str(tmp_path))))
    want = [(i, m, r, i is not None, True) for i in [*range(60), None, 7, 7, 7] for m, r in (("lin", "shadow"), ("log", "champion"))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_scores_of_all_models_or_an_error(spark, people, monkeypatch):
    """A fit that fails, or a folder that an earlier run left without a model, does not give scores of five models."""
    algorithms = {n: replace(a, build=(lambda make: lambda n, k: make(n, k).setMaxIter(2))(a.build))
                  if n in ("xgboost", "catboost", "pytorch_mlp") else a for n, a in md.ALGORITHMS.items()}
    algorithms["random_forest"] = replace(algorithms["random_forest"],
                                          build=lambda n, k: md.RandomForestClassifier(numTrees=3, maxDepth=2))
    labelled = people.withColumn("label", F.col("target"))
    monkeypatch.setattr(mq.b, "profile", lambda t: labelled)
    monkeypatch.setattr(mq.md, "campaign_labels", lambda df, campaign: df)
    tables = Tables(spark, "")

    def broken(n, k):
        raise OSError("no space left")

    monkeypatch.setattr(mq.md, "ALGORITHMS", {**algorithms, "random_forest": replace(algorithms["random_forest"], build=broken)})
    with pytest.raises(RuntimeError, match="rf_custom: no space left"):
        mq.shadow_scores(tables)
    monkeypatch.setattr(mq.md, "ALGORITHMS", algorithms)
    folder = f"{mq.shared_dir(spark)}/models-{mq.model_store.content_digest(labelled)}"
    some = [(f"{a.short}_custom", n, None) for n, a in algorithms.items() if n != "random_forest"]
    mq.model_store.save_models(spark, Serving(md.train_whole(people, some, FEATURES, "target"), "xgb_custom"), folder)
    scored = mq.shadow_scores(tables)
    assert {r["model_id"]: r["count"] for r in scored.groupBy("model_id").count().collect()} == {
        f"{a.short}_custom": 100 for a in md.ALGORITHMS.values()}
