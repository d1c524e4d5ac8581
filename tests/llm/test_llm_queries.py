"""The registered queries and the pipeline on the smallest tables."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from propensity_spark.llm import queries, simhash
from propensity_spark.llm.common import stored
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_one_row_per_document(spark, name):
    got = queries.QUERIES[name](spark, SF)
    ids = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    assert got.select("doc_id").distinct().exceptAll(ids).count() == 0
    assert got.select("doc_id").distinct().count() == ids.count()
    assert name == "op7_packing" or got.count() == ids.count()


def test_fingerprints_as_hex(spark):
    got = {r["doc_id"]: r["fingerprint"] for r in queries.op5_simhash_dedup(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert got[r["doc_id"]] == f"{simhash.fingerprint((r['text'] or '').encode()) % (1 << 64):016x}"


def test_held_out_quality(spark):
    """On the labels that were not learned from."""
    sf = "/root/testdata/sf0.01"
    scored = queries.op1_quality_classifier(spark, sf).where("held_out")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = scored.join(labels, "doc_id").select("quality", "score", "predicted").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95
    assert sum((r["quality"] == 1) == (r["predicted"] == 1) for r in rows) / len(rows) > 0.9


def test_suffix_tree_is_better_than_its_root(spark):
    held = queries.op6_suffix_tree(spark, "/root/testdata/sf0.01").where("held_out")
    r = held.agg(F.sum("base_score").alias("base"), F.sum("score").alias("own")).first()
    assert r["own"] > r["base"]


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stored(stage(spark, docs, SF), name)
        assert after.columns == columns and after.exceptAll(docs).count() == 0
        if name == "near-duplicates":
            groups = simhash.near_duplicates(docs)
            assert after.count() == groups.select("component").distinct().count()
        docs = after
    pieces = corpus_pipeline.pack(spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.run(spark, SF).count() == pieces.count()


def test_pipeline_takes_odd_documents(spark, odd_docs, no_docs):
    extra = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, extra, SF)
        assert got.columns == extra.columns
        assert not Counter(map(tuple, got.collect())) - Counter(map(tuple, extra.collect()))
        assert stage(spark, no_docs, SF).count() == 0
    kept = corpus_pipeline.drop_copies(spark, extra, SF)
    assert kept.where("text = 'one'").count() == 1 and kept.where("text = 'a b c d e f g'").count() == 1
    assert kept.where("text = 'no id here'").count() == 1
    pieces = corpus_pipeline.pack(spark, extra, SF)
    assert pieces.count() >= extra.count() and corpus_pipeline.pack(spark, no_docs, SF).count() == 0
