import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from propensity_spark.operators.search import telemetry
from propensity_spark.plans import bindings as b
from propensity_spark.plans import model_queries as q
from propensity_spark.sources.readers import Tables
from propensity_spark.sources.schemas import DRIVER_TABLES
from tests.test_streaming import SF


class Parts(Tables):
    def __getitem__(self, name):
        return self.spark.read.schema(DRIVER_TABLES[name]).parquet(f"{self.folder}/{name}-*.parquet")


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """The events by time in 150 files, more than two batches, that arrive in any order."""
    folder = tmp_path_factory.mktemp("shuffled")
    events = pq.read_table(f"{SF}/events.parquet").sort_by("ts")
    order, step = list(range(150)), -(-events.num_rows // 150)
    random.Random(5).shuffle(order)
    for at, i in enumerate(order):
        path = f"{folder}/events-{i:03}.parquet"
        pq.write_table(events.slice(i * step, step), path)
        os.utime(path, (1.7e9 + 10 * at,) * 2)
    return Parts(spark, str(folder))


def test_telemetry_and_masked_log_do_not_depend_on_the_order_of_files(shuffled):
    log = b.request_log(shuffled["events"])
    day = F.date_format("timestamp", "yyyy-MM-dd").alias("day")
    want = telemetry(log.withColumn("day", day), ["day", "endpoint"]).collect()
    assert sorted(map(tuple, q.stream_telemetry(shuffled).collect())) == sorted(map(tuple, want))
    ids = [r[0] for r in q.stream_masked_log(shuffled).select("log_id").collect()]
    assert sorted(ids) == sorted(r[0] for r in log.select("log_id").collect())


def test_psi_counts_every_row(shuffled):
    assert q.stream_psi(shuffled).agg(F.sum("n")).first()[0] == shuffled["events"].count()
