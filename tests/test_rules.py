import itertools

import pytest
from pyspark.sql import functions as F

from propensity_spark.functions.scalar import hash_order
from propensity_spark.operators import labels, rules
from tests.conftest import rows

DATA = [(1, 30, 50000.0, "25", "Moderate", True), (2, None, -5.0, "abc", None, False), (3, 25, 0.0, "-5", "High", None),
        (4, 60, 25.5, "25.0", "", True)]
SCHEMA = "customer_id int, age int, income double, code string, risk string, late boolean"


def is_number(v):
    return isinstance(v, (bool, int, float)) or (
        isinstance(v, str) and v.lstrip("-").replace(".", "", 1).isdigit() and not v[1:].count("-"))


def brute(row, feature, op, value):
    """One condition, row by row, by its definition."""
    if feature not in row or row[feature] is None:
        return False
    have = float(row[feature]) if is_number(row[feature]) else row[feature]
    want = float(value) if not isinstance(value, list) and is_number(value) else value
    if op == "in":
        return have in want if isinstance(want, list) else str(have) in str(want)
    same = isinstance(have, float) == isinstance(want, float)
    if op in ("==", "!="):
        return (same and have == want) == (op == "==")
    order = {">=": "__ge__", ">": "__gt__", "<=": "__le__", "<": "__lt__"}
    return bool(same and op in order and getattr(have, order[op])(want))


@pytest.fixture(scope="module")
def people(frame):
    return frame(DATA, SCHEMA)


def test_every_condition_matches_its_definition(people):
    names = people.columns
    features = ["age", "income", "code", "risk", "late", "unknown"]
    values = [25, "25", "50000", "-5", 0, "Moderate", "abc", "25.0, 60.0, High", [25, "abc", 1], [True], ""]
    ops = [">=", ">", "<=", "<", "==", "!=", "in", "~"]
    cases = list(itertools.product(features, ops, values))
    cases = [c for c in cases if not (c[1] != "in" and isinstance(c[2], list))]
    types = rules.column_types(people)
    cols = [rules.condition(types, {"feature": f, "operator": o, "value": v}).alias(f"c{i}")
            for i, (f, o, v) in enumerate(cases)]
    for start in range(0, len(cases), 60):
        got = people.select("customer_id", *cols[start:start + 60]).orderBy("customer_id").collect()
        for raw, out in zip(DATA, got):
            row = dict(zip(names, raw))
            for i, case in enumerate(cases[start:start + 60], start):
                assert out[f"c{i}"] == brute(row, *case), (row, case)


def test_logic_words_and_empty_rules(people):
    young, rich = ("age", "<", 40), ("income", ">", 10)
    count = lambda logic, conds: people.filter(
        rules.rule_mask(rules.column_types(people), rules.make_rule("r", "r", conds, logic)["rule_config"])).count()
    assert count("AND", [young, rich]) == 1
    assert count("or", [young, rich]) == 3
    assert count("XOR", [young, rich]) == 1
    assert count("OR", []) == 0


def test_dpd_buckets_at_their_limits(frame):
    df = frame([(d,) for d in (-1, 0, 1, 30, 31, 60, 61, 90, 91, None)], "payment_delay_days int")
    assert rows(rules.dpd_buckets(df)) == [("0 DPD (Current)", 3), ("1-30 DPD", 2), ("31-60 DPD", 2), ("61-90 DPD", 2),
                                           ("90+ DPD", 1)]
    none = rows(rules.dpd_buckets(df.limit(0)))
    assert [n for _, n in none] == [0] * 5


def test_run_of_nobody_and_of_no_rules(spark):
    df = spark.range(5).select(F.col("id").alias("age"))
    nobody = rules.evaluate_rules(df.limit(0), rules.default_rules()).collect()
    assert len(nobody) == 20 and {tuple(r)[2:] for r in nobody} == {(0, 0, 0.0, 0, 0, 0, 0, 0)}
    assert rules.evaluate_rules(df, []).count() == 0


def test_many_rules_are_one_scan(spark):
    df = spark.range(50).select(F.col("id").cast("int").alias("age"))
    many = [rules.make_rule(f"r{i}", f"R{i}", [("age", ">=", i)]) for i in range(150)]
    out = rules.evaluate_rules(df, many)
    assert {r["model_id"]: r["matched_count"] for r in out.collect()} == {f"r{i}": max(0, 50 - i) for i in range(150)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 50") == 1


@pytest.mark.parametrize("parts", [1, 16])
def test_run_counts_add_up(spark, parts):
    df = spark.range(500).select((F.col("id") * 7 % 130 - 10).cast("int").alias("payment_delay_days"),
                                 (F.col("id") % 90).cast("int").alias("age")).repartition(parts)
    out = rules.evaluate_rules(df, rules.default_rules()).collect()
    assert len(out) == 20
    for r in out:
        assert r["total_evaluated"] == 500
        assert r["matched_count"] == sum(r[c] for c in ("dpd_0", "dpd_1_30", "dpd_31_60", "dpd_61_90", "dpd_over_90"))
        assert r["match_rate"] == round(r["matched_count"] / 500, 4)
    delayed = next(r for r in out if r["model_id"] == "rule_model_m02")
    assert delayed["matched_count"] == df.filter("payment_delay_days >= 30").count()


def test_hits_scores_and_samples(people):
    some = [rules.make_rule("a", "A", [("age", ">=", 30)]), rules.make_rule("b", "B", [("income", "!=", 0)])]
    assert sorted(rows(rules.rule_hits(people, some))) == [(1, "a"), (1, "b"), (2, "b"), (4, "a"), (4, "b")]
    assert rows(rules.rule_sample(people, some[0], n=2)) == [(1, 1, 0.95), (2, 0, 0.05)]


def test_rules_survive_the_table_form(spark):
    schema = ("model_id string, model_name string, category string, target_product string, status string, "
              "rule_config struct<logic:string,conditions:array<struct<feature:string,operator:string,value:string>>>")
    docs = spark.createDataFrame([("r1", "R", "c", "p", "Active", ("OR", [("age", ">=", "30"), ("income", "<", "0")]))], schema)
    back = rules.parse_rules(rules.flatten_rules(docs))
    assert rows(back) == rows(docs)
    assert rules.collect_rules(back)[0]["rule_config"]["conditions"][0] == {"feature": "age", "operator": ">=", "value": "30"}


# ---- labels

def test_campaign_families(frame):
    df = frame([(1, 0.0, 2, True, "Aggressive"), (0, 5.0, 0, False, "Very Aggressive"), (None, None, None, None, None),
                (-1, 1.0, 1, True, "AGGRESSIVE")],
               "is_conversion_successful int, monthly_sip_amount double, active_loans_count int, late_payment_flag boolean, risk_profile string")
    want = {"credit_card": [1, 0, 0, 0], "Mutual_Funds/Investments": [0, 1, 0, 1], "loans_propensity": [1, 0, 0, 1],
            "card_defaulter": [1, 0, 0, 1], "investment_aggressiveness_model": [1, 0, 0, 1], "next_best_action": [1, 0, 0, 0]}
    for name, values in want.items():
        assert [r["label"] for r in labels.campaign_labels(df, name).collect()] == values
    with pytest.raises(ValueError):
        labels.campaign_labels(df, "card_defulter")
    assert labels.labelled_only(df, "is_conversion_successful").count() == 2


def test_later_tags_win(frame):
    df = frame([(1, 0, False, 0.0, 0.0), (0, 45, True, 0.0, 0.0), (1, None, None, None, None), (0, 0, False, 2000.0, 0.0),
                (1, 0, True, 0.0, 0.0)],
               "label int, payment_delay_days int, late_payment_flag boolean, monthly_spend double, monthly_loan_emi double")
    out = labels.event_tags(df, auto_cure_max_dpd=0, roll_forward_min_dpd=30, money_collected_min=1000.0)
    assert [r["label"] for r in out.collect()] == [0, 1, 0, 1, 1]
    assert rows(labels.event_tags(df)) == rows(df)


def test_split_and_sample_do_not_depend_on_partitioning(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    for f in (lambda d: labels.hash_split(d, "k", 0.7), lambda d: labels.hash_sample(d, "k", 50)):
        assert sorted(rows(f(df.repartition(1)))) == sorted(rows(f(df.repartition(16))))
    share = labels.hash_split(df, "k", 0.7).filter("part = 'train'").count() / 2000
    assert abs(share - 0.7) < 0.05
    assert labels.hash_sample(df, "k", 50).distinct().count() == 50


@pytest.mark.parametrize("n", [1, 60, 1999, 2000, 2001])
def test_a_sample_is_the_top_n_of_the_hash(spark, n):
    df = spark.range(2000).withColumnRenamed("id", "k")
    want = sorted(rows(df.orderBy(hash_order(F.col("k"), 42), "k").limit(n)))
    assert sorted(rows(labels.hash_sample(df, "k", n))) == want
    assert len(want) == min(n, 2000)
