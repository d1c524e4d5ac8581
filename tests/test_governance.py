import json

import pytest
from pyspark.sql import functions as F

from propensity_spark.operators import governance as gv
from propensity_spark.sources.registry_file import load_registry, save_registry
from tests.conftest import rows


@pytest.fixture(scope="module")
def models(frame):
    return frame(
        [("x", 0, "ML", "champion", "XGBoost", {"roc_auc": 0.8, "pr_auc": 0.5}, {"latency": 15.0}),
         ("y", 1, "ML", "challenger", "CatBoost", {"roc_auc": 0.8}, {"latency": 50.1}),
         ("z", 2, "ML", "migrated", None, {}, {})],
        "model_id string, seq int, model_category string, status string, algorithm_type string, "
        "baselines map<string,double>, live_metrics map<string,double>")


def audit_of(frame, actions):
    return frame([(i, "t", "u", a, "e", "s") for i, a in enumerate(actions)],
                 "seq long, timestamp string, triggered_by string, action string, evidence string, approved_by string")


def test_upsert_replaces_inserts_and_takes_the_last(models, frame):
    incoming = frame([("y", 5, "ML", "new"), ("w", 6, "Rule", "w1"), ("w", 7, "Rule", "w2")],
                     "model_id string, seq int, model_category string, status string")
    out = {r["model_id"]: r for r in gv.upsert(models, incoming, "model_id", "seq").collect()}
    assert {k: r["status"] for k, r in out.items()} == {"x": "champion", "y": "new", "z": "migrated", "w": "w2"}
    assert out["y"]["baselines"] is None  # the whole entry is replaced
    assert rows(gv.upsert_counts(incoming, "model_id")) == [(1, 1)]


def test_insert_absent_skips_known_ids_and_repeats(models, frame):
    incoming = frame([("y", 1), ("n", 2), ("n", 1)], "model_id string, seq int")
    assert rows(gv.insert_absent(models, incoming, "model_id", "seq")) == [("n", 1)]


def test_ranks_are_unique_with_defaults_for_missing(models):
    got = {r["model_id"]: (r["roc_auc_rank"], r["pr_auc_rank"], r["is_champion"]) for r in gv.model_list(models, "x").collect()}
    assert got == {"x": (1, 3, True), "y": (2, 1, False), "z": (3, 2, False)}


def test_acceptance(models, frame):
    rules = frame([("r1", "R1", (1,), {"gini": "0.4"}), ("r2", "R2", (0,), {}), ("r3", None, (2,), {"gini": "0.39"})],
                  "model_id string, model_name string, n struct<n:int>, performance_summary map<string,string>")
    cond = F.struct(F.lit("age").alias("feature"))
    rules = rules.withColumn("rule_config", F.struct(F.array_repeat(cond, F.col("n.n")).alias("conditions")))
    out = {r["model_id"]: (r["status"], r["metric_value"]) for r in gv.acceptance(models, rules).collect()}
    assert out == {"x": ("PASS", "AUC: 0.8000, Latency: 15.0ms"), "y": ("FAIL", "AUC: 0.8000, Latency: 50.1ms"),
                   "z": ("PASS", "AUC: 0.8000, Latency: 15.0ms"), "r1": ("PASS", "Conditions: 1, Gini: 0.4000"),
                   "r2": ("FAIL", "Conditions: 0, Gini: 0.5000"), "r3": ("FAIL", "Conditions: 2, Gini: 0.3900")}
    assert rows(gv.acceptance_summary(gv.acceptance(models, rules))) == [(6, 3, 3, 0.5)]
    assert gv.acceptance(models, rules, "r2").count() == 1
    assert rows(gv.acceptance_summary(gv.acceptance(models, rules, "none"))) == [(0, 0, 0, 0.0)]


def status(df):
    return {r["model_id"]: r["status"] for r in df.collect()}


def test_promote(models):
    assert status(gv.promote(models, "y")) == {"x": "challenger", "y": "champion", "z": "migrated"}
    assert status(gv.promote(models, "x")) == status(models)
    with pytest.raises(ValueError):
        gv.promote(models, "nobody")


@pytest.mark.parametrize("actions,back", [
    (["Model Hot-Swap completed: y -> x", "Model Hot-Swap completed: z -> x"], "z"),
    (["Automated Hot-Swap completed: y -> x", "Model Hot-Swap completed: x -> y"], "y"),
    (["Model Hot-Swap completed: y -> x", "Model Hot-Swap completed: gone -> x"], "y"),
    (["Traffic split updated"], "z"),
])
def test_rollback(models, frame, actions, back):
    out = gv.rollback(models, audit_of(frame, actions), "x", default="x", second_default="z")
    assert [k for k, v in status(out).items() if v == "champion"] == [back]


def test_audit_entries(frame):
    audit = audit_of(frame, [f"a{i}" for i in range(20)])
    longer = gv.audit_entry(audit, "me", "done", "why", "2026-01-01 00:00:00")
    tail = gv.audit_tail(longer).collect()
    assert [r["seq"] for r in tail] == list(range(6, 21))
    assert (tail[-1]["action"], tail[-1]["approved_by"]) == ("done", "system")
    assert gv.audit_entry(audit.limit(0), "me", "first", "", "t").first()["seq"] == 0


def test_approval_defaults(frame):
    studio = frame([("rule_9", "Other", None, None), ("m", "Rule Strategy X", 0.9, None), ("n", "XGBoost", None, 0.6)],
                   "model_id string, algorithm_type string, auc double, pr_auc double")
    studio = studio.withColumns({c: F.lit(None).cast("double") for c in ("ks", "fairness", "latency_ms")})
    out = {r["model_id"]: r for r in gv.approve(studio, "now").collect()}
    assert [out[m]["model_category"] for m in ("rule_9", "m", "n")] == ["Rule", "Rule", "ML"]
    assert out["n"]["baselines"]["roc_auc"] == 0.80 and out["m"]["baselines"]["roc_auc"] == 0.9
    assert out["n"]["live_metrics"]["latency"] == 15.0 and out["n"]["baselines"]["pr_auc"] == 0.6


def test_traffic_share_and_modes(spark):
    requests = spark.range(5000)
    out = gv.assign_traffic(requests, "id", "a", "b", 0.8)
    assert abs(out.filter("model_id = 'a'").count() / 5000 - 0.8) < 0.03
    again = gv.assign_traffic(requests.repartition(13), "id", "a", "b", 0.8)
    assert sorted(rows(out)) == sorted(rows(again))
    single = gv.assign_traffic(requests, "id", "a", "b", 0.1, mode="single").first()
    shadow = gv.assign_traffic(requests, "id", "a", "b", 0.1, mode="shadow").first()
    assert (single["model_id"], single["shadow_model_id"]) == ("a", None)
    assert (shadow["model_id"], shadow["shadow_model_id"]) == ("a", "b")


def test_registry_document(spark, tmp_path):
    entry = {"model_id": "m1", "algorithm_type": "XGBoost", "status": "champion", "model_category": "ML",
             "hyperparameters": {"a": 1}, "baselines": {"roc_auc": 0.8}, "live_metrics": {"latency": 3}}
    rule = {"model_name": "R", "rule_config": {"logic": "AND", "conditions": [
        {"feature": "age", "operator": ">=", "value": 21}, {"feature": "code", "operator": "in", "value": "a,b"}]},
        "performance_summary": {"gini": 0.5}}
    doc = {"active_routing": {"champion_id": "m1"}, "settings": {"failover_mode": "manual", "drift_threshold_psi": 0.25},
           "traffic_split": {"mode": "shadow", "champion_ratio": 1.0, "selected_challenger_id": "m2"},
           "models": {"m1": entry, "m2": {"status": "challenger"}},
           "rule_models": {"rule_1": rule}, "audit_log": [{"action": "one"}, {"action": "two"}]}
    path = tmp_path / "registry.json"
    path.write_text(json.dumps(doc, indent=2))
    frames = load_registry(spark, str(path))
    assert [(r["seq"], r["model_id"], r["status"]) for r in frames["models"].orderBy("seq").collect()] == [
        (0, "m1", "champion"), (1, "m2", "challenger")]
    found = frames["rule_models"].first()
    assert found["model_id"] == "rule_1" and found["rule_config"]["conditions"][0]["value"] == "21"
    assert [r["action"] for r in frames["audit"].orderBy("seq").collect()] == ["one", "two"]
    assert frames["settings"].first()["drift_threshold_psi"] == 0.25
    save_registry(frames, str(tmp_path / "out"))
    again = load_registry(spark, str(tmp_path / "out"))
    assert set(again) == set(frames)
    for name, frame in frames.items():
        assert sorted(map(repr, again[name].collect())) == sorted(map(repr, frame.collect())), name
        assert again[name].schema.simpleString() == frame.schema.simpleString()
    bare = tmp_path / "bare.json"
    bare.write_text(json.dumps({k: v for k, v in doc.items() if k != "rule_models"}))
    filled = load_registry(spark, str(bare), default_rules=frames["rule_models"].withColumn("seq", F.lit(9)))
    assert filled["rule_models"].count() == 1
