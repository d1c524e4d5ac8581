import datetime as dt
from decimal import Decimal

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from propensity_spark.functions.session import checkpointed, scratch_path, shared_dir
from propensity_spark.operators.customer360 import customer_360
from propensity_spark.sources import readers
from propensity_spark.sources.schemas import BANK_TABLES
from tests.conftest import rows


def test_tsv_keeps_nulls_booleans_and_empty_text(frame, spark, tmp_path):
    schema = "id int, t string, b boolean, d decimal(10,2), at timestamp_ntz"
    data = [(1, "a\tb\nc", True, Decimal("1.50"), dt.datetime(2024, 1, 1, 5)), (2, None, None, None, None),
            (3, "", False, Decimal("0.00"), None), (4, "é\\x", True, None, None)]
    path = str(tmp_path / "t")
    readers.save_tsv(frame(data, schema), path)
    back = rows(readers.load_tsv(spark, path, schema).orderBy("id"))
    assert back == [(1, "a b c", *data[0][2:]), data[1], data[2], data[3]]


def test_log_append_and_normalised_rows(frame, spark, tmp_path):
    log = frame([(1, dt.datetime(2024, 1, 1, 23)), (2, dt.datetime(2024, 1, 2))], "id int, timestamp timestamp_ntz")
    path = str(tmp_path / "log")
    for _ in range(2):
        readers.append_log(log, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 4 and stored.filter("day = date'2024-01-02'").count() == 2
    out = readers.normalise(log.withColumn("m", F.lit("1.50").cast("decimal(5,2)"))).first()
    assert (out["timestamp"], out["m"]) == ("2024-01-01T23:00:00.000000", 1.5)


def test_preview_and_lists(frame):
    df = frame([(i, ["a", "b"]) for i in range(30)], "id int, tables array<string>")
    names, head, total = readers.preview(df)
    assert names == ["id", "tables"] and head.count() == 10 and total is None
    assert readers.preview(df, with_count=True)[2] == 30
    flat = readers.flatten_list(df, "tables")
    assert flat.first()["tables"] == "a, b" and readers.split_list(flat, "tables").first()["tables"] == ["a", "b"]


def test_declared_schemas_parse(spark):
    for name, ddl in BANK_TABLES.items():
        fields = spark.createDataFrame([], ddl).schema
        assert len(fields) == len(set(fields.names)), name


def test_checkpoint_folder_is_the_configured_one(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == folder and scratch_path(spark, "x").startswith(folder)
    assert checkpointed(spark.range(10)).count() == 10
    assert folder in spark.sparkContext.getCheckpointDir()


def test_without_a_configured_folder_a_cluster_is_refused():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
    Session.sparkContext.master = "local[2]"
    assert shared_dir(Session()) == shared_dir(Session())


def test_parallel_database_read_is_planned_by_key_ranges(spark):
    # No database runs here: the options are checked up to the missing driver.
    try:
        readers.read_jdbc(spark, "jdbc:postgresql://localhost/none", "t", "id", (0, 100, 8))
    except Exception as e:
        assert "driver" in str(e).lower()
    else:
        raise AssertionError("no driver is installed")


def test_bucketed_tables_join_without_a_shuffle(spark):
    for name in ("bucket_people", "bucket_cards"):
        frame_ = spark.range(200).select((F.col("id") % 150).alias("customer_id"), F.col("id").alias(name))
        readers.save_bucketed(frame_.dropDuplicates(["customer_id"]), name, "customer_id", 4)
    joined = customer_360(spark.table("bucket_people"), [spark.table("bucket_cards").hint("merge")])
    assert joined.count() == 150
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    for name in ("bucket_people", "bucket_cards"):
        spark.sql(f"DROP TABLE {name}")


def test_text_keys_are_cut_into_predicates():
    assert readers.key_predicates("k", ["m", "d'x", "m"]) == [
        "k COLLATE \"C\" < 'd''x' OR k IS NULL", "k COLLATE \"C\" >= 'd''x' AND k COLLATE \"C\" < 'm'",
        "k COLLATE \"C\" >= 'm'"]
    assert readers.key_predicates("k", []) == ["1 = 1"]
    assert readers.key_predicates("k", [9, 10, 100]) == [
        "k < 9 OR k IS NULL", "k >= 9 AND k < 10", "k >= 10 AND k < 100", "k >= 100"]
    with pytest.raises(ValueError):
        readers.key_predicates("k", ["9", 10])


KEYS = st.one_of(st.none(), st.text(alphabet="aAbBzZéß_ '09", max_size=4))


@given(st.lists(KEYS, max_size=12), st.lists(st.text(alphabet="aAbBzZéß_ '09", max_size=3), max_size=5))
@settings(max_examples=60, deadline=None)
def test_every_text_key_is_in_one_predicate(keys, bounds):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k VARCHAR)")
    for k in keys:
        con.execute("INSERT INTO t VALUES (?)", [k])
    found = [r for p in readers.key_predicates("k", bounds) for r in con.execute(f"SELECT k FROM t WHERE {p}").fetchall()]
    assert sorted(map(repr, found)) == sorted(repr((k,)) for k in keys)


@given(st.lists(st.one_of(st.none(), st.integers(-200, 200)), max_size=12),
       st.lists(st.one_of(st.integers(-150, 150), st.floats(-150, 150)), max_size=5))
@settings(max_examples=60, deadline=None)
def test_every_number_is_in_one_predicate(keys, bounds):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k BIGINT)")
    for k in keys:
        con.execute("INSERT INTO t VALUES (?)", [k])
    found = [r for p in readers.key_predicates("k", bounds) for r in con.execute(f"SELECT k FROM t WHERE {p}").fetchall()]
    assert sorted(map(repr, found)) == sorted(repr((k,)) for k in keys)
