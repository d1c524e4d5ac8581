"""The threshold index equals the plain evaluation, and does not slow down with the rules."""
import itertools
import random
import time

from propensity_spark.operators import rule_index, rules
from tests.conftest import rows

DATA = [(1, 30, 50000.0, "25", "Moderate", True, 0), (2, None, -5.0, "abc", None, False, 31),
        (3, 25, float("nan"), "-5", "High", None, 65), (4, 60, 25.5, "25.0", "", True, 500), (5, 25, None, None, "abc", True, None)]
SCHEMA = "customer_id int, age int, income double, code string, risk string, late boolean, payment_delay_days int"


def same(df, made, **options):
    got, want = rows(rule_index.evaluate_many(df, made, **options)), rows(rules.evaluate_rules(df, made, **options))
    assert sorted(got) == sorted(want) and len(got) == len(made)


def test_every_condition_alone(frame):
    people = frame(DATA, SCHEMA)
    values = [25, "25", "50000", "-5", 0, "Moderate", "abc", "25.0, 60.0, High", [25, "abc", 1], [25, 60], ["abc", "High"],
              [True], [], ""]
    cases = itertools.product(["age", "income", "code", "risk", "late", "unknown"], [">=", ">", "<=", "<", "==", "!=", "in", "~"],
                              values)
    cases = [c for c in cases if not (c[1] != "in" and isinstance(c[2], list))]
    made = [rules.make_rule(f"r{i}", "x", [c]) for i, c in enumerate(cases)]
    got = []
    for i in range(0, len(made), 50):  # the plain form cannot take them all at once
        got += rows(rules.evaluate_rules(people, made[i:i + 50]))
    assert sorted(rows(rule_index.evaluate_many(people, made))) == sorted(got)


def test_rules_of_many_conditions(frame, monkeypatch):
    people = frame(DATA * 3, SCHEMA)
    rng = random.Random(2)
    conds = [("age", ">=", 25), ("age", "<", 60), ("income", ">", 0), ("income", "!=", 25.5), ("code", ">", "a"),
             ("code", "==", "25"), ("risk", "in", ["abc", "High"]), ("risk", "in", "Moderate or High"), ("risk", "!=", "abc"),
             ("late", "==", 1), ("code", "in", [25, "abc"]), ("unknown", "<", 3)]
    made = [rules.make_rule(f"r{i}", f"n{i}", rng.sample(conds, rng.randrange(0, 5)), rng.choice(["AND", "OR", "or"]))
            for i in range(130)]
    monkeypatch.setattr(rule_index, "BLOCK", 50)
    same(people, made)
    same(people.limit(0), made)
    same(people.drop("payment_delay_days"), made[:20])
    assert rule_index.evaluate_many(people, []).count() == 0


def test_five_thousand_rules_cost_less_than_three_times_twenty(spark):
    people = spark.range(200000).selectExpr(
        "id as customer_id", "int(id % 70 + 18) as age", "double(id * 37 % 100000) as income",
        "string(id % 9) as code", "string(id % 5) as risk", "id % 2 = 0 as late", "int(id % 100) as payment_delay_days")
    people = people.repartition(8).cache()
    assert people.count() == 200000
    rng = random.Random(4)
    made = [rules.make_rule(f"r{i}", "x", [("age", rng.choice([">=", "<"]), rng.randrange(18, 88)),
                                           ("income", rng.choice([">", "<="]), rng.randrange(100000)),
                                           ("risk", "!=", str(rng.randrange(5)))], rng.choice(["AND", "AND", "OR"]))
            for i in range(5000)]

    def seconds(run, some):
        run(people, some).collect()
        start = time.time()
        run(people, some).collect()
        return time.time() - start

    few = max(seconds(rules.evaluate_rules, made[:20]), seconds(rule_index.evaluate_many, made[:20]))
    many = seconds(rule_index.evaluate_many, made)
    assert many < max(3 * few, 6)
    some = rng.sample(made, 40)
    same(people, some)
    people.unpersist()
