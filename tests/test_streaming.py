import pytest
from pyspark.sql import functions as F

from propensity_spark.operators.models import train
from propensity_spark.operators.search import telemetry
from propensity_spark.plans import bindings as b
from propensity_spark.sources.readers import Tables
from propensity_spark.streaming import jobs
from tests.conftest import rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    """The events in eight files, oldest first, and the stream over them."""
    folder = tmp_path_factory.mktemp("arriving")
    events = Tables(spark, SF)["events"].orderBy("event_id").collect()
    step = len(events) // 8 + 1
    schema = Tables(spark, SF)["events"].schema
    for i in range(8):
        part = spark.createDataFrame(events[i * step:(i + 1) * step], schema).coalesce(1)
        part.write.mode("append").parquet(str(folder))
    return str(folder)


def stream(spark, folder):
    raw = spark.readStream.schema(Tables(spark, SF)["events"].schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return b.request_log(raw)


def test_closed_windows_equal_the_batch(spark, arriving):
    out = jobs.run_append(jobs.windowed_telemetry(stream(spark, arriving)), "closed").collect()
    batch = telemetry(b.request_log(spark.read.parquet(arriving)).withColumn("day", F.to_date("timestamp")), ["day", "endpoint"])
    want = {(str(r["day"]), r["endpoint"]): tuple(r)[2:] for r in batch.collect()}
    got = {(str(r["window_start"])[:10], r["endpoint"]): tuple(r)[2:] for r in out}
    assert got and all(want[k] == v for k, v in got.items())
    last = max(d for d, _ in want)
    assert {k for k in want if k[0] < last} == set(got)


def test_updated_windows_equal_the_batch_and_leave_the_state(spark, arriving):
    out = jobs.run_update(jobs.windowed_telemetry(stream(spark, arriving)), "open", ["window_start", "endpoint"])
    log = b.request_log(spark.read.parquet(arriving)).withColumn("day", F.to_date("timestamp"))
    want = {(str(r["day"]), r["endpoint"]): tuple(r)[2:] for r in telemetry(log, ["day", "endpoint"]).collect()}
    assert {(str(r["window_start"])[:10], r["endpoint"]): tuple(r)[2:] for r in out.collect()} == want
    query = (jobs.windowed_telemetry(stream(spark, arriving)).writeStream.outputMode("update").format("noop")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert kept[-1] < len(want) / 2


def test_resent_rows_are_dropped_and_secrets_masked(spark, arriving):
    twice = stream(spark, arriving)
    twice = twice.unionByName(stream(spark, arriving))
    out = jobs.run_append(jobs.masked_log(twice, ["k"], delay="60 days"), "masked")
    assert out.count() == out.select("log_id").distinct().count() == Tables(spark, SF)["events"].count()
    assert rows(out.select("payload_summary").distinct()) == [('{"k":"********"}',)]


def test_a_row_sent_again_much_later_is_known_without_a_state(spark, arriving, tmp_path):
    events = spark.read.parquet(arriving)
    for i in range(3):  # all rows, then some of them and twice in a file, then all again
        (events if i != 1 else events.limit(50).union(events.limit(50))).coalesce(1).write.parquet(str(tmp_path / f"{i}"))
        raw = spark.read.parquet(str(tmp_path / f"{i}")).coalesce(1)
        raw.write.mode("append").parquet(str(tmp_path / "in"))
    log = stream(spark, str(tmp_path / "in"))
    out = jobs.run_masked_log(log, ["k"], "masked")
    assert out.columns == log.columns and out.count() == out.select("log_id").distinct().count() == events.count()
    assert rows(out.select("payload_summary").distinct()) == [('{"k":"********"}',)]


def test_stored_counters_equal_the_batch(spark, arriving):
    counters = jobs.run_batches(stream(spark, arriving), "telemetry", jobs.telemetry_counters)
    log = b.request_log(spark.read.parquet(arriving)).withColumn("day", F.to_date("timestamp"))
    want = {(str(r["day"]), r["endpoint"]): tuple(r)[2:] for r in telemetry(log, ["day", "endpoint"]).collect()}
    got = {(str(r["window_start"])[:10], r["endpoint"]): tuple(r)[2:] for r in jobs.telemetry_of_counters(counters).collect()}
    assert got == want and counters.count() > len(want)


def test_stream_scores_equal_batch_scores(spark, arriving):
    weights = {"credit_score": 0.001, "age": 0.01}
    profiles = b.demographics(Tables(spark, SF))
    requests = lambda log: log.select("log_id", F.regexp_extract("username", "[0-9]+", 0).cast("long").alias("customer_id"))
    live = jobs.scored_requests(requests(stream(spark, arriving)), profiles, weights, -1.0)
    batch = jobs.scored_requests(requests(b.request_log(spark.read.parquet(arriving))), profiles, weights, -1.0)
    got = jobs.run_append(live.select("log_id", "score"), "scores")
    assert sorted(rows(got)) == sorted(rows(batch.select("log_id", "score")))


def test_windows_do_not_depend_on_the_session_zone(spark, arriving):
    def starts():
        out = jobs.run_update(jobs.windowed_telemetry(stream(spark, arriving)), "zone", ["window_start", "endpoint"])
        return sorted({str(r["window_start"]) for r in out.select("window_start").collect()})

    zone = spark.conf.get("spark.sql.session.timeZone")
    here = starts()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert starts() == here
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert here[0].endswith("00:00:00")


def test_a_trained_model_scores_a_stream(spark, arriving):
    profiles = b.demographics(Tables(spark, SF)).withColumn("target", (F.col("credit_score") > 600).cast("int"))
    model = train(profiles, "logistic_regression", ["age", "credit_score"], "target", {"max_iter": 10})

    def scores(log):
        requests = log.select("log_id", F.regexp_extract("username", "[0-9]+", 0).cast("long").alias("customer_id"))
        return model.score(requests.join(profiles, "customer_id")).select("log_id", "score", "predicted_label")

    got = jobs.run_append(scores(stream(spark, arriving)), "model")
    assert sorted(rows(got)) == sorted(rows(scores(b.request_log(spark.read.parquet(arriving)))))
