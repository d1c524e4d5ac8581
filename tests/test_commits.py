"""Commits of several writers: snapshots, the registry, merges into stored tables."""
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from propensity_spark.operators import governance as gv
from propensity_spark.sources.merge_table import MergeTable
from propensity_spark.sources.registry_file import Registry
from propensity_spark.sources.snapshots import Conflict, Snapshots
from tests.conftest import rows

AUDIT = "seq bigint, timestamp string, triggered_by string, action string, evidence string, approved_by string"


@pytest.fixture
def registry(spark, tmp_path):
    made = Registry(spark, str(tmp_path / "registry"))
    models = spark.createDataFrame([(0, "a", "champion"), (1, "b", "challenger")], "seq bigint, model_id string, status string")
    made.commit({"models": models, "rule_models": spark.createDataFrame([], "seq bigint, model_id string"),
                 "audit": spark.createDataFrame([], AUDIT)}, None)
    return made


def test_a_number_is_taken_once(spark, tmp_path):
    shots = Snapshots(spark, str(tmp_path / "s"))
    assert shots.newest() is None and shots.commit("é 0", None) == 0 and shots.read(0) == "é 0"
    with pytest.raises(Conflict):
        shots.commit("other", None)
    assert shots.commit("1", 0) == 1 and shots.newest() == 1 and shots.read(0) == "é 0"
    assert [p.name for p in (tmp_path / "s").iterdir() if p.name.startswith(".") and "crc" not in p.name] == []


def note(by):
    return lambda frames: frames | {"audit": gv.audit_entry(frames["audit"], by, "noted", "", "2024-01-01")}


def test_interleaved_writers_keep_both_entries(registry):
    read = registry.at(0)
    registry.update(note("first"))
    with pytest.raises(Conflict):
        registry.commit(note("second")(read), 0)
    registry.update(note("second"))
    audit = registry.at(registry.newest())["audit"].orderBy("seq").collect()
    assert [(r["seq"], r["triggered_by"]) for r in audit] == [(0, "first"), (1, "second")]


def test_writers_at_the_same_time(spark, registry):
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda by: registry.update(note(by)), ["w1", "w2", "w3", "w4"]))
    audit = registry.at(registry.newest())["audit"].collect()
    assert sorted(r["triggered_by"] for r in audit) == ["w1", "w2", "w3", "w4"]
    assert sorted(r["seq"] for r in audit) == [0, 1, 2, 3] and registry.newest() == 4


def test_rollback_reads_an_earlier_document(registry):
    registry.update(lambda f: f | {"models": gv.promote(f["models"], "b")})
    assert registry.at(registry.newest())["models"].where("status = 'champion'").first()["model_id"] == "b"
    number = registry.restore(0)
    assert number == 2 and registry.snapshots.read(2) == registry.snapshots.read(0)
    assert registry.at(number)["models"].where("status = 'champion'").first()["model_id"] == "a"


# ---- merges

SCHEMA = "id bigint, value string, seq int"


@pytest.fixture
def table(spark, tmp_path, frame):
    made = MergeTable(spark, str(tmp_path / "t"), "id", spark.createDataFrame([], SCHEMA).schema, buckets=8)
    made.merge(frame([(i, "old", 0) for i in range(100)], SCHEMA), "load", "seq")
    return made


def test_merge_equals_upsert_and_touches_no_other_bucket(frame, table):
    before, old = table.state(), table.read().collect()
    new = frame([(3, "x", 1), (3, "y", 2), (3, "w", 0), (1000, "new", 1)], SCHEMA)
    table.merge(new, "one", "seq")
    want = {r["id"]: r["value"] for r in old} | {3: "y", 1000: "new"}
    assert {r["id"]: r["value"] for r in table.read().collect()} == want and table.read().count() == 101
    after = table.state()
    assert 6 <= sum(before["buckets"][b] == after["buckets"][b] for b in before["buckets"]) < 8
    assert {r["id"] for r in table.read(0).collect()} == set(range(100))


def test_a_batch_counts_once(frame, table):
    new = frame([(3, "x", 1)], SCHEMA)
    assert table.merge(new, "one", "seq") == 1 and table.merge(new, "one", "seq") is None
    assert table.snapshots.newest() == 1


def test_insert_absent_keeps_what_is_there(frame, table):
    table.merge(frame([(3, "x", 1), (200, "b", 2), (200, "a", 1)], SCHEMA), "one", "seq", replace=False)
    got = {r["id"]: r["value"] for r in table.read().collect()}
    assert got[3] == "old" and got[200] == "a" and len(got) == 101


def test_no_rows_and_an_empty_table(spark, frame, tmp_path):
    made = MergeTable(spark, str(tmp_path / "e"), "id", spark.createDataFrame([], SCHEMA).schema)
    assert made.read().count() == 0
    made.merge(frame([], SCHEMA), "nothing", "seq")
    assert made.read().count() == 0 and made.state()["batches"] == ["nothing"]
    made.merge(frame([(None, "n", 1), (5, None, 1)], SCHEMA), "odd", "seq")
    assert sorted(map(repr, rows(made.read().select("id", "value")))) == ["(5, None)", "(None, 'n')"]


def test_merges_at_the_same_time_lose_nothing(spark, frame, table):
    batches = [frame([(i, f"b{n}", 5) for i in range(n * 10, n * 10 + 15)], SCHEMA) for n in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda n: table.merge(batches[n], f"batch-{n}", "seq"), range(4)))
    got = {r["id"]: r["value"] for r in table.read().collect()}
    assert len(got) == 100 and all(got[i] != "old" for i in range(45)) and all(got[i] == "old" for i in range(45, 100))
    assert sorted(table.state()["batches"]) == ["batch-0", "batch-1", "batch-2", "batch-3", "load"]
