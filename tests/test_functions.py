import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from propensity_spark.functions.ordered import global_rank, running_totals
from propensity_spark.functions.scalar import bin_index, contains_text, hash_bucket, linspace, mask_json
from tests.conftest import rows


def test_edges_are_the_doubles_of_a_numeric_library():
    for bins in (5, 10, 19, 20):
        assert linspace(0.0, 1.0, bins) == list(np.linspace(0.0, 1.0, bins + 1))


def test_bins_at_the_edges(frame):
    values = [0.0, 0.1, 0.2, 0.3, 0.6, 0.7, 1.0, -0.01, 1.01, None]
    df = frame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(bin_index(F.col("v"), linspace(0.0, 1.0, 10))).collect()]
    assert got == [0, 1, 2, 2, 5, 6, 9, None, None, None]


def test_mask_only_top_level_values_of_objects(frame):
    texts = ['{"password": "a\\"b", "n": {"password": 1}, "t": [1, 2]}', "[1]", "no json", "", None, '{"a": 1.5}']
    df = frame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(mask_json(F.col("t"), ["password"])).collect()]
    assert got[1:] == ["", "", "", "", '{"a":1.5}']
    assert '"password":"********"' in got[0] and '{"password":1}' in got[0] and "a\\" not in got[0]


def test_hash_bucket_is_pinned(frame):
    digest = hashlib.md5(b"42|42").hexdigest()
    df = frame([(42,)], "id long")
    assert df.select(hash_bucket(F.col("id"), 42)).first()[0] == int(digest[:8], 16) % 10000


def test_search_text_is_literal_unless_asked(frame):
    df = frame([("50% off",), ("500 off",), ("a_b",), ("axb",)], "t string")
    assert rows(df.filter(contains_text(F.col("t"), "50%"))) == [("50% off",)]
    assert rows(df.filter(contains_text(F.col("t"), "A_B"))) == [("a_b",)]
    assert len(rows(df.filter(contains_text(F.col("t"), "A_B", wildcards=True)))) == 2


@pytest.mark.parametrize("kind", ["double", "decimal(5,4)"])
@pytest.mark.parametrize("parts", [1, 16])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_match_pandas(spark, kind, parts, descending):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 900), "s": rng.integers(0, 200, 900) / 200, "n": rng.integers(1, 9, 900)})
    pdf.loc[:300, "g"] = 1  # one group holds a third
    pdf = pdf.groupby(["g", "s"], as_index=False)["n"].sum()
    df = spark.createDataFrame(pdf).withColumn("s", F.col("s").cast(kind)).repartition(parts)
    for by in ([], ["g"]):
        base = pdf if by else pdf.groupby("s", as_index=False)["n"].sum()
        src = df if by else df.groupBy("s").agg(F.sum("n").alias("n"))
        got = running_totals(src, "s", ["n"], by, descending).withColumn("s", F.col("s").cast("double")).toPandas()
        want = base.sort_values("s", ascending=not descending)
        want["cum_n"] = want.groupby(by)["n"].cumsum() if by else want["n"].cumsum()
        want["total_n"] = want.groupby(by)["n"].transform("sum") if by else want["n"].sum()
        cols = [*by, "s", "n", "cum_n", "total_n"]
        got, want = (x[cols].sort_values([*by, "s"]).reset_index(drop=True).astype("float64") for x in (got, want))
        pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("parts", [1, 16])
def test_global_rank_is_unique_and_stable_on_ties(spark, parts):
    pdf = pd.DataFrame({"seq": range(1000), "v": [0.5 if i % 3 == 0 else (i * 37 % 101) / 101 for i in range(1000)]})
    got = global_rank(spark.createDataFrame(pdf).repartition(parts), "v", "seq", "rank").toPandas()
    want = pdf.sort_values(["v", "seq"], ascending=[False, True]).reset_index(drop=True)
    want["rank"] = range(1, 1001)
    assert dict(zip(got["seq"], got["rank"])) == dict(zip(want["seq"], want["rank"]))
