"""From raw documents to packed sequences: what is poor, copied or contaminated goes, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all documents it is given; all but the last return the columns of
documents. A NULL or repeated doc_id is a document row like any other, except that of equal rows one is enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propensity_spark.llm import decontaminate, packing, quality, simhash
from propensity_spark.llm.common import free_name, stored
from propensity_spark.llm.queries import WORD_BPE, contaminated, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from these documents and the labels, accepts. One pass, no shuffle."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score, predicted = free_name("score", docs.columns), free_name("predicted", docs.columns)
    scored = quality.classify(docs, model, docs.columns, score=score, predicted=predicted)
    return scored.where(F.col(predicted) == 1).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id (of rows with that id, one).

    A document is found again by its id and the hash of its text. Documents that have no id are kept one per group
    that has no other.
    """
    found = simhash.near_duplicates(docs)
    best = found.groupBy("component").agg(
        F.min_by(F.struct("doc_id", "content"), F.struct(F.col("doc_id").isNull(), "doc_id", "content")).alias("best"))
    best = best.select(F.col("best.doc_id").alias("_id"), F.col("best.content").alias("_content"))
    content = free_name("content", docs.columns)
    marked = docs.withColumn(content, F.xxhash64("text"))
    same = marked["doc_id"].eqNullSafe(best["_id"]) & (marked[content] == best["_content"])
    return marked.join(best, same, "left_semi").dropDuplicates(["doc_id", content]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no more of the benchmark's windows in them than the rule allows. One pass, no shuffle."""
    names = [free_name(n, docs.columns) for n in decontaminate.NAMES]
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), docs.columns, names=names)
    return found.where(~contaminated(F.col(names[0]), F.col(names[1]))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences of 2048."""
    return packing.pack(docs, WORD_BPE, end=1)


STAGES = [("quality", keep_good), ("near-duplicates", drop_copies), ("decontamination", drop_contaminated),
          ("packing", pack)]

#: SQL has no neural classifier and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is a stored table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
