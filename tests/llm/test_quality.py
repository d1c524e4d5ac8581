import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from propensity_spark.llm import quality
from tests.llm.conftest import TEXTS


def test_features_of_any_text():
    sizes = {len(quality.features((t or "").encode())) for t in TEXTS}
    assert sizes == {quality.N_FEATURES}
    assert all(np.isfinite(quality.features((t or "").encode())).all() for t in TEXTS)


@pytest.fixture(scope="module")
def corpus(spark):
    """Prose, and prose full of marks, of which a third is labelled."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        text = " ".join("".join(rng.choices("aeioustrn", k=rng.randint(2, 9))) + ("" if good else "%%%")
                        for _ in range(rng.randint(5, 80)))
        rows.append((i, text, good))
        if i % 3 == 0:
            labels.append((i, int(good)))
    return (spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int"), {r[0]: r[2] for r in rows})


def test_learns_from_positives_and_unlabelled(corpus):
    docs, labels, truth = corpus
    model = quality.train(docs, labels, steps=400)
    assert 0.5 < model.prior < 0.85
    got = quality.classify(docs, model, ["doc_id"]).collect()
    right = [(r["predicted"] == 1) == truth[r["doc_id"]] for r in got]
    assert len(got) == 600 and np.mean(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_labels_of_the_held_out_fold_are_not_read(corpus, spark):
    docs, labels, _ = corpus
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                                                  1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.train(docs, x, steps=20) for x in (labels, flipped))
    assert all((a == b).all() for a, b in zip(one.weights, two.weights))


def test_a_frequent_id_is_one_row_of_the_sample(corpus, spark, monkeypatch):
    docs, labels, _ = corpus
    wanted = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).limit(1).first()["doc_id"]
    many = docs.unionByName(spark.range(3000).select(F.lit(wanted).cast(docs.schema["doc_id"].dataType).alias("doc_id"),
                                                     F.concat(F.lit("text "), "id").alias("text")), allowMissingColumns=True)
    sizes = []
    estimate = quality.estimate_prior
    monkeypatch.setattr(quality, "estimate_prior", lambda p, u, *rest: sizes.append(len(p) + len(u)) or estimate(p, u, *rest))
    quality.train(many, labels, sample=10, steps=5)
    assert sizes and max(sizes) <= 20


def test_negative_part_never_counts_below_zero():
    rng = np.random.default_rng(1)
    p = rng.normal(2, 1, (600, quality.N_FEATURES))
    u = np.vstack([rng.normal(2, 1, (300, quality.N_FEATURES)), rng.normal(-2, 1, (100, quality.N_FEATURES))])
    assert abs(quality.estimate_prior(p, u, np.arange(600) % 4, np.arange(400) % 4) - 0.75) < 0.1
    model = quality._fit(p, u, 0.75, 500, 1)
    assert (model.score(p) > 0.5).mean() > 0.95 and (model.score(u[300:]) < 0.3).mean() > 0.95


def test_odd_rows(odd_docs, no_docs, corpus, spark):
    model = quality.train(*corpus[:2], steps=20)
    got = quality.classify(odd_docs, model, ["doc_id", "text"]).collect()
    assert len(got) == odd_docs.count()
    scores = {}
    for r in got:
        assert scores.setdefault(r["text"] or "", r["score"]) == r["score"]
    assert quality.classify(no_docs, model, ["doc_id"]).count() == 0
    labels = spark.createDataFrame([(3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    assert quality.train(no_docs, labels) is None
    assert quality.train(odd_docs, labels.where("false")) is None
    assert {r["score"] for r in quality.classify(odd_docs, None, ["doc_id"]).collect()} == {0.5}
    quality.train(odd_docs, labels)
