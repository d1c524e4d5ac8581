import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from propensity_spark.operators import features as ft
from propensity_spark.operators import prepare as pr
from propensity_spark.operators.labels import hash_sample, in_sample
from tests.conftest import rows

AFF = "annual_income double, monthly_spend double, average_utilization double, fixed_deposit_balance double, credit_score int, active_loans_count int"


def test_affinity_with_missing_and_odd_income(frame):
    df = frame([(1200.0, 100.0, 0.5, 600.0, 850, 0), (0.0, 1.0, 0.0, 0.0, 850, 2), (-5.0, None, None, None, None, None),
                (None, 0.0, 0.0, 0.0, 0, 0)], AFF)
    out = ft.affinity(df).select("card_affinity", "fund_affinity", "loan_affinity", "recommended_product")
    assert rows(out) == [(0.5, 0.5, 0.3, "Credit Cards"), (12.0, 0.0, 0.1, "Credit Cards"),
                         (0.0, 0.0, round(300 / 850 * 0.3, 4), "Retail Loans"), (0.0, 0.0, round(300 / 850 * 0.3, 4), "Retail Loans")]


def test_rule_of_thumb_and_ratios(frame):
    df = frame([(701, 1000001.0, 30), (700, 1.0, 20), (None, None, None)], "credit_score int, annual_income double, age int")
    assert [(r["propensity"], r["predicted_label"]) for r in ft.rule_of_thumb(df).collect()] == [(0.8, 1), (0.15, 0), (0.15, 0)]
    df = frame([(100.0, 50.0, 0.0, 10.0, 16), (100.0, 50.0, 300.0, 10.0, None)],
               "a double, b double, annual_income double, monthly_spend double, payment_delay_days int")
    out = ft.loan_ratios(df, ["a", "b"]).collect()
    assert [(r["total_outstanding"], r["loan_to_income_ratio"], r["late_flag"]) for r in out] == [(150.0, 0.0, True), (150.0, 0.5, False)]


def test_annuity(frame):
    df = frame([(0.0, 0.1), (1000.0, 0.1), (1e6, 0.12), (1e6, 0.0)], "p double, r double")
    want = 1e6 * 0.01 / (1 - 1.01 ** -60)
    got = [r[0] for r in df.select(ft.annuity(F.col("p"), F.col("r"))).collect()]
    assert got == [0.0, 1500.0, round(want, 2), 1500.0]


def test_stress_caps_and_leaves_the_rest(spark):
    df = spark.range(100).select("id", F.lit(350).alias("credit_score"), F.lit(0.9).alias("average_utilization"),
                                 F.when(F.col("id") > 0, 5).alias("payment_delay_days")).withColumnRenamed("id", "customer_id")
    worse = ft.stress(df, ft.WORSE, n=40).collect()
    assert sum(r["credit_score"] == 300 for r in worse) == 40
    assert sum(r["average_utilization"] == 1.0 for r in worse) == 40
    assert {r["payment_delay_days"] for r in worse} <= {None, 5, 20}
    assert [r["payment_delay_days"] for r in worse if r["customer_id"] == 0] == [None]
    better = ft.stress(df, ft.BETTER, n=100).collect()
    assert all(r["credit_score"] == 460 and r["payment_delay_days"] in (0, None) for r in better)
    assert ft.stress(df, n=40).columns == df.columns


@pytest.mark.parametrize("n", [0, 1, 7, 199, 200, 500])
def test_membership_equals_the_sample(spark, n):
    keys = spark.range(200).withColumnRenamed("id", "customer_id")
    seeds = (1, 2)
    marked = keys.select("customer_id", *[c.alias(f"s{s}") for s, c in zip(seeds, in_sample(keys, "customer_id", n, seeds))])
    for seed in seeds:
        want = sorted(r[0] for r in hash_sample(keys, "customer_id", n, seed).collect())
        assert sorted(r[0] for r in marked.where(f"s{seed}").collect()) == want and len(want) == min(n, 200)


# ---- preparation

@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(1e6, 1, 801), "b": rng.normal(0, 1, 801), "d": rng.integers(0, 3, 801).astype(float)})
    pdf["c"] = pdf["a"] * 2 + rng.normal(0, 0.1, 801)
    pdf["fixed"] = 3.3
    pdf.loc[pdf.index % 4 == 0, "b"] = np.nan
    pdf.loc[pdf.index % 3 == 0, "c"] = np.nan
    pdf["empty"] = np.nan
    pdf.loc[:300, "d"] = 7.0  # more than a third share one value
    schema = ", ".join(f"{c} double" for c in pdf.columns)
    data = [tuple(None if math.isnan(v) else float(v) for v in r) for r in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(data, schema)


def test_correlation_is_pairwise_complete(wide):
    pdf, df = wide
    cols = ["a", "b", "c", "d", "fixed", "empty"]
    want = pdf[cols].corr().fillna(0.0)
    for parts in (1, 16):
        got = pr.correlation(df.repartition(parts), [*cols, "unknown"]).collect()
        assert len(got) == 36
        for r in got:
            # A constant or empty column has no correlation, not even with itself.
            assert r["corr"] == pytest.approx(want.loc[r["feature_a"], r["feature_b"]], abs=1e-7)


def test_text_columns_have_no_correlation(frame):
    df = frame([(1.0, "x"), (2.0, "y")], "a double, t string")
    assert rows(pr.correlation(df, ["a", "t"])) == [("a", "a", 1.0)]


@pytest.mark.parametrize("n", [801, 800])
def test_medians_are_exact(wide, n):
    pdf, df = wide
    want = pdf.head(n).median()
    cols = ["a", "b", "c", "d"]
    df = df.limit(n) if n < 801 else df.repartition(7)
    for accuracy in (10000, 20):
        got = {r["feature"]: r["median"] for r in pr.medians(df, [*cols, "empty"], accuracy).collect()}
        assert got == {c: want[c] for c in cols} | {"empty": None}
    rough = {r["feature"]: r["median"] for r in pr.approximate_medians(df, cols).collect()}
    assert abs(rough["a"] - want["a"]) < 0.1


def test_nan_is_missing_and_infinite_medians_are_ranked(frame):
    nan, inf = float("nan"), float("inf")
    df = frame([(1.0, nan, inf), (nan, 4.0, inf), (3.0, 10.0, 1.0)], "a double, b double, c double")
    assert {r["feature"]: r["median"] for r in pr.medians(df, ["a", "b"]).collect()} == {"a": 2.0, "b": 7.0}
    assert {r["feature"]: r["null_count"] for r in pr.missing_stats(df, ["a", "b", "c"]).collect()} == {
        "a": 1, "b": 1, "c": 0}
    assert rows(pr.impute(df, {"a": "mean", "b": "median", "c": "median"})) == [
        (1.0, 7.0, inf), (2.0, 4.0, inf), (3.0, 10.0, 1.0)]
    assert pr.fill_values(df, {"c": "median"}) == {"c": inf}


@pytest.mark.parametrize("ascending", [True, False])
def test_correlation_far_from_zero_in_any_order(spark, ascending):
    ids = spark.range(6500).coalesce(1).orderBy(F.col("id") if ascending else F.col("id").desc())
    df = ids.select(F.when(F.col("id") >= 1500, F.col("id") % 97 + 1e7).alias("x"),
                    F.when(F.col("id") >= 1500, F.col("id") % 97 * 2 + F.col("id") % 5).alias("y"))
    pdf = df.toPandas()
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in pr.correlation(df, ["x", "y"]).collect()}
    assert got["x", "y"] == pytest.approx(pdf["x"].corr(pdf["y"]), abs=1e-9) and got["x", "x"] == pytest.approx(1.0)


def test_values_outside_a_pair_do_not_touch_it(spark):
    """a is 1e12 where b is missing; on the other rows b is proportional to a."""
    ids = spark.range(10000).repartition(7)
    even = F.col("id") % 2 == 0
    df = ids.select(F.when(even, 1e12).otherwise(F.col("id") % 89 / 7).alias("a"),
                    F.when(~even, F.col("id") % 89 * 2.5).alias("b"),
                    F.when(F.col("id") % 3 > 0, F.col("id") * 0.1 + F.col("id") % 11).alias("c"))
    pdf = df.toPandas()
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in pr.correlation(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(1.0, abs=1e-12) == got["b", "a"]
    for x in "abc":
        for y in "abc":
            want = pdf[[x, y]].dropna()
            want = 1.0 if x == y else np.corrcoef(want[x], want[y])[0, 1]
            assert got[x, y] == pytest.approx(want, abs=1e-9)


def test_missing_and_imputation(frame):
    df = frame([(1.0, None, 3.0, None), (None, 4.0, 5.0, None), (3.0, 10.0, None, None)], "a double, b double, c double, e double")
    got = {r["feature"]: (r["null_count"], r["null_share"]) for r in pr.missing_stats(df, ["a", "e", "zz"]).collect()}
    assert got == {"a": (1, 0.3333), "e": (3, 1.0), "zz": (0, 0.0)}
    assert {r[1:] for r in rows(pr.missing_stats(df.limit(0), ["a"]))} == {(0, 0.0)}
    out = pr.impute(df, {"a": "mean", "b": "median", "c": "drop", "e": "mean"})
    assert out.columns == ["a", "b", "e"]
    assert rows(out) == [(1.0, 7.0, 0.0), (2.0, 4.0, 0.0), (3.0, 10.0, 0.0)]
    train = pr.impute(df, {"b": "median", "a": "other"}, fit_on=df.limit(2))
    assert [(r["a"], r["b"]) for r in train.collect()] == [(1.0, 4.0), (0.0, 4.0), (3.0, 10.0)]


def test_clusters_cut_at_average_distance(frame):
    strong = {("a", "b"): 0.9, ("c", "d"): -0.8, ("a", "c"): 0.1}
    names = ["a", "b", "c", "d", "k"]
    data = []
    for x in names:
        for y in names:
            r = 0.0 if x == y == "k" else 1.0 if x == y else strong.get((x, y), strong.get((y, x), 0.0))
            data.append((x, y, r))
    out = pr.feature_clusters(frame(data, "feature_a string, feature_b string, corr double"), names)
    got = {r["feature"]: r["representative"] for r in out.collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "k": "k"}
    kept = pr.keep_representatives(frame([(1, 2, 3, 4, 5, 9)], "a int, b int, c int, d int, k int, id int"), out, ["id"])
    assert kept.columns == ["id", "a", "c", "k"]
