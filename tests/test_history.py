"""History from stored counters equals recomputing, and reads the asked steps only."""
import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from propensity_spark.operators import drift as dr
from propensity_spark.operators.history import FeatureHistory, MetricHistory
from tests.conftest import rows

SCHEMA = "id int, score double, label int, at timestamp_ntz"


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(1)
    made = []
    for i in range(900):
        score = rng.choice([None, float("nan")]) if i % 97 == 0 else round(rng.random(), 2)
        made.append((i, score, rng.choice([0, 1, 1, -1, None]), dt.datetime(2024, 1, 1 + i // 100, i % 24)))
    return spark.createDataFrame(made, SCHEMA).cache()


def test_appended_days_and_late_labels_equal_recomputing(spark, log, tmp_path):
    hist = MetricHistory(spark, str(tmp_path), DoubleType())
    known = log.withColumn("was", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("label")))
    for day in range(1, 10):
        part = known.where(F.dayofmonth("at") == day)
        for _ in range(2):  # a job that runs twice
            hist.append(part, f"day-{day}", "was", "score", "at")
    hist.set_baseline("2024-01-04")
    before = rows(dr.metric_history(known, "was", "score", "at", "2024-01-04"))
    assert rows(hist.history()) == before
    changed = known.where("id % 3 = 0")
    hist.append(changed, "labels", "label", "score", "at", old_label="was")
    after = rows(dr.metric_history(log, "label", "score", "at", "2024-01-04"))
    assert rows(hist.history()) == after and after != before
    assert rows(hist.history("2024-01-05", "2024-01-06")) == [r for r in after if r[0].day in (5, 6)]


def test_old_days_are_not_read(spark, log, tmp_path):
    hist = MetricHistory(spark, str(tmp_path), DoubleType())
    for day in (1, 2, 3):
        hist.append(log.where(F.dayofmonth("at") == day), f"day-{day}", "label", "score", "at")
    hist.set_baseline("2024-01-02")
    want = rows(hist.history("2024-01-03"))
    broken = glob.glob(f"{tmp_path}/scores/*/step=2024-01-0[12]/*.parquet")
    assert broken
    for name in broken:
        crc = os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
        with open(name, "wb") as file:
            file.write(b"not parquet")
    assert rows(hist.history("2024-01-03")) == want and len(want) == 1
    hist.append(log.where(F.dayofmonth("at") == 4), "day-4", "label", "score", "at")
    assert len(rows(hist.history("2024-01-03"))) == 2


def test_feature_history_equals_feature_drift(spark, tmp_path):
    data = [(i % 50 * 1.5, None if i % 7 == 0 else float(i % 13), dt.datetime(2024, 1 + i // 300, 1)) for i in range(900)]
    df = spark.createDataFrame(data, "a double, b double, at timestamp_ntz")
    base = df.where(F.month("at") == 1)
    hist = FeatureHistory(spark, str(tmp_path))
    hist.set_baseline(base, ["a", "b"])
    for part in (0, 1, 1):
        hist.append(df.where(F.floor("a") % 2 == part), f"part-{part}", "at", "month")
    got = {(r["step"].month, r["feature"]): r for r in hist.drift().collect()}
    assert len(got) == 6
    for month in (1, 2, 3):
        sides = dr.two_sides(base, df.where(F.month("at") == month))
        for want in dr.feature_drift(sides, "side", ["a", "b"]).collect():
            r = got[month, want["feature"]]
            assert (r["psi"], r["status"], r["baseline_mean"], r["live_mean"]) == (
                want["psi"], want["status"], want["baseline_mean"], want["live_mean"])
    quantiles = {r["feature"]: r for r in hist.quantiles([0.1, 0.5, 0.9]).collect()}
    values = sorted(x[0] for x in data)
    assert quantiles["a"]["n"] == 900 and quantiles["b"]["n"] == sum(x[1] is not None for x in data)
    for i, q in enumerate((0.1, 0.5, 0.9)):
        rank = sum(v <= quantiles["a"][f"q_{i}"] for v in values) / 900
        assert abs(rank - q) < 0.04
