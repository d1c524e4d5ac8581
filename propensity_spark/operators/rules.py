"""Declarative business rules, compiled to columns and run over a whole population in one scan."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StringType

from propensity_spark.functions.scalar import all_of, any_of, as_int, is_true, ratio
from propensity_spark.sources.schemas import RULE_CONFIG

NUMBER = r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"

# Default rules: name, category, product, conditions joined by AND (fixed values).
DEFAULT_RULES = [
    ("High-Income Premium CC Eligibility", "Acquisition", "Credit Card",
     [("annual_income", ">=", 100000), ("credit_score", ">=", 750)]),
    ("Delinquency 30+ DPD Hard Stop Filter", "Risk Control", "Retail Loans", [("payment_delay_days", ">=", 30)]),
    ("Affluent Wealth Cross-Sell Trigger", "Cross-Sell", "Mutual Funds",
     [("fixed_deposit_balance", ">=", 250000), ("equity_portfolio_value", ">=", 100000)]),
    ("Low Utilization CC Line Increase", "Portfolio Mgt", "Credit Card",
     [("average_utilization", "<=", 0.25), ("payment_delay_days", "==", 0)]),
    ("High Debt Burden Loan Rejection", "Risk Control", "Retail Loans",
     [("active_loans_count", ">=", 3), ("monthly_loan_emi", ">=", 45000)]),
    ("Young Professional Entry CC Rule", "Acquisition", "Credit Card",
     [("age", ">=", 21), ("age", "<=", 30), ("annual_income", ">=", 40000)]),
    ("Senior Citizen High FD Loyalty Rule", "Retention", "Mutual Funds",
     [("age", ">=", 60), ("fixed_deposit_balance", ">=", 500000)]),
    ("Moderate DPD Pre-Emptive Warning Rule", "Collections", "Credit Card",
     [("payment_delay_days", ">=", 10), ("payment_delay_days", "<", 30)]),
    ("Prime Credit Loan Rate Discount Rule", "Pricing", "Retail Loans",
     [("credit_score", ">=", 800), ("total_outstanding_loan", "<=", 200000)]),
    ("SIP Investor Equity Upgrade Trigger", "Cross-Sell", "Mutual Funds",
     [("monthly_sip_amount", ">=", 5000), ("mutual_fund_holdings", ">=", 50000)]),
    ("Zero Activity Card Inactivity Alert", "Retention", "Credit Card",
     [("monthly_spend", "==", 0), ("average_utilization", "==", 0)]),
    ("Multi-Loan High EMI Risk Watchlist", "Risk Control", "Retail Loans", [("active_loans_count", ">=", 4)]),
    ("High Balance FD to SIP Conversion", "Cross-Sell", "Mutual Funds",
     [("fixed_deposit_balance", ">=", 300000), ("monthly_sip_amount", "==", 0)]),
    ("Super Prime Top-Tier CC Approval", "Acquisition", "Credit Card",
     [("credit_score", ">=", 820), ("annual_income", ">=", 150000)]),
    ("Severe Delinquency 60+ DPD Action", "Collections", "Credit Card", [("payment_delay_days", ">=", 60)]),
    ("Salary Account Loan Pre-Approval", "Acquisition", "Retail Loans",
     [("annual_income", ">=", 60000), ("credit_score", ">=", 720)]),
    ("Aggressive Investor Risk Profile Match", "Product Matching", "Mutual Funds",
     [("equity_portfolio_value", ">=", 200000)]),
    ("High Spend Card Upgrade Eligibility", "Portfolio Mgt", "Credit Card",
     [("monthly_spend", ">=", 35000), ("credit_score", ">=", 740)]),
    ("Over-Leveraged Customer Credit Freeze", "Risk Control", "Retail Loans",
     [("average_utilization", ">=", 0.90)]),
    ("Starter SIP Micro-Investment Campaign", "Acquisition", "Mutual Funds",
     [("age", "<=", 28), ("monthly_sip_amount", "==", 0)]),
]


def make_rule(model_id: str, name: str, conditions: Iterable[tuple], logic: str = "AND", **extra) -> dict:
    items = [{"feature": f, "operator": o, "value": v} for f, o, v in conditions]
    return {"model_id": model_id, "model_name": name, "rule_config": {"logic": logic, "conditions": items}, **extra}


def default_rules() -> list[dict]:
    return [
        make_rule(f"rule_model_m{i:02d}", name, conditions, category=category, target_product=product,
                  status="Active" if i <= 5 else "Migrated")
        for i, (name, category, product, conditions) in enumerate(DEFAULT_RULES, 1)
    ]


# ---- one condition

def _as_number(value: object) -> float | None:
    if isinstance(value, (bool, int, float)) or (isinstance(value, str) and re.match(NUMBER, value)):
        return float(value)
    return None


def _number_text(x: Column) -> Column:
    """A double as plain text: 25 is 25.0."""
    whole = F.concat(x.cast("bigint").cast("string"), F.lit(".0"))
    return F.when(x == F.floor(x), whole).otherwise(F.rtrim(x.cast("decimal(38,21)").cast("string"), F.lit("0")))


def column_types(df: DataFrame) -> dict[str, DataType]:
    return {f.name: f.dataType for f in df.schema}


def _sides(name: str, kind: DataType) -> tuple[Column, Column]:
    """(numeric side, text side) of a feature; text that looks like a number counts as a number."""
    col = F.col(name)
    if isinstance(kind, StringType):
        numeric = col.rlike(NUMBER)
        return F.when(numeric, col.try_cast("double")), F.when(~numeric, col)
    if isinstance(kind, BooleanType):
        return col.cast("int").cast("double"), F.lit(None).cast("string")
    if isinstance(kind, NumericType):
        return col.cast("double"), F.lit(None).cast("string")
    return F.lit(None).cast("double"), col.cast("string")


COMPARE = {
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    "<": lambda a, b: a < b,
    "==": lambda a, b: a == b,
}


def condition(types: dict[str, DataType], cond: dict) -> Column:
    """A condition as a Column that is never NULL, over columns of the given types.

    A missing feature, a NULL or an unknown operator is false, also for `!=`. A number never equals or precedes
    text. `in` is membership for a list, and a substring test for anything else.
    """
    name, op, value = cond.get("feature"), cond.get("operator"), cond.get("value")
    if name not in types:
        return F.lit(False)
    number, text = _sides(name, types[name])
    if op == "in":
        return is_true(_is_in(number, text, value))
    wanted = _as_number(value)
    side, lit = (text, F.lit(str(value))) if wanted is None else (number, F.lit(wanted))
    if op == "!=":
        return F.col(name).isNotNull() & ~is_true(side == lit)
    if op in COMPARE:
        return is_true(COMPARE[op](side, lit))
    return F.lit(False)


def _is_in(number: Column, text: Column, value: object) -> Column:
    if isinstance(value, (list, tuple)):
        numbers = [float(v) for v in value if isinstance(v, (bool, int, float))]
        texts = [v for v in value if isinstance(v, str)]
        return is_true(number.isin(numbers)) | is_true(text.isin(texts))
    wanted = _as_number(value)
    within = F.lit(str(value) if wanted is None else str(wanted))
    shown = F.coalesce(_number_text(number), text)
    return F.instr(within, shown) > 0


def rule_mask(types: dict[str, DataType], config: dict) -> Column:
    """All conditions (any of them for logic OR); a rule without conditions matches nothing."""
    conds = [condition(types, c) for c in config.get("conditions") or []]
    if not conds:
        return F.lit(False)
    return any_of(conds) if str(config.get("logic", "AND")).upper() == "OR" else all_of(conds)


# ---- whole population

# Fixed values.
DPD_BUCKETS = ["0 DPD (Current)", "1-30 DPD", "31-60 DPD", "61-90 DPD", "90+ DPD"]


def dpd_bucket(delay: Column) -> Column:
    """Index into DPD_BUCKETS; NULL counts as 0 days."""
    days = F.coalesce(delay, F.lit(0))
    return F.when(days <= 0, 0).when(days <= 30, 1).when(days <= 60, 2).when(days <= 90, 3).otherwise(4)


def dpd_buckets(df: DataFrame, delay: str = "payment_delay_days") -> DataFrame:
    """Rows per delay bucket; all five buckets are always present."""
    days = dpd_bucket(F.col(delay))
    counts = df.agg(*[F.count_if(days == i).alias(f"_{i}") for i in range(5)])
    rows = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"_{i}").alias("n"))
                     for i, b in enumerate(DPD_BUCKETS)])
    return counts.select(F.inline(rows))


#: Rules whose hits are one number of a row.
MASK = 60


def evaluate_rules(df: DataFrame, rules: list[dict], delay: str = "payment_delay_days") -> DataFrame:
    """One row per rule: population, matches, match rate and matches per delay bucket.

    One scan whatever the number of rules: a row's hits are bits of a few numbers, rows with the same hits and delay
    bucket are counted together before the shuffle, and only those counts are laid out per rule. What comes back is
    rules x buckets and is laid on the list of rules, so a rule that never fired, and an empty population, give a row
    of zeros. For thousands of rules there is rule_index.evaluate_many().
    """
    types = column_types(df)
    bucket = dpd_bucket(F.col(delay)) if delay in types else F.lit(-1)
    masks = []
    for start in range(0, len(rules), MASK):
        bits = [F.when(rule_mask(types, r["rule_config"]), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
                for i, r in enumerate(rules[start:start + MASK])]
        masks.append(reduce(Column.bitwiseOR, bits))
    names = [f"_hits_{i}" for i in range(len(masks))]
    same = df.select(bucket.alias("bucket"), *[m.alias(n) for m, n in zip(masks, names)]).groupBy("bucket", *names).agg(
        F.count(F.lit(1)).alias("count"))
    # From here on there is a row per set of hits. -1 counts the population.
    fired = [F.when(F.col(names[i // MASK]).bitwiseAND(F.lit(1 << i % MASK).cast("bigint")) != 0, F.lit(i))
             for i in range(len(rules))]
    each = same.select("bucket", "count", F.explode(F.array_compact(F.array(F.lit(-1), *fired))).alias("rule"))
    return counts_per_rule(each, rules)


def counts_per_rule(counts: DataFrame, rules: list[dict]) -> DataFrame:
    """The rows of evaluate_rules() from counts (rule, bucket, count); rule -1 is the population."""
    in_bucket = [F.sum(F.when(F.col("bucket") == i, F.col("count")).otherwise(0)) for i in range(5)]
    per_rule = counts.groupBy("rule").agg(F.sum("count").alias("n"), F.array(*in_bucket).alias("days"))
    one = per_rule.agg(F.map_from_entries(F.collect_list(F.struct("rule", F.struct("n", "days")))).alias("found"))
    listed = json.dumps([{"rule": i, "model_id": r["model_id"], "model_name": r["model_name"]}
                         for i, r in enumerate(rules)])
    kind = "array<struct<rule:int,model_id:string,model_name:string>>"
    rows = one.select("found", F.inline(F.from_json(F.lit(listed), kind)))
    total = F.coalesce(F.try_element_at("found", F.lit(-1))["n"], F.lit(0))
    own = F.try_element_at("found", F.col("rule"))
    matched = F.coalesce(own["n"], F.lit(0))
    names = ["dpd_0", "dpd_1_30", "dpd_31_60", "dpd_61_90", "dpd_over_90"]
    return rows.select(
        "model_id", "model_name", total.alias("total_evaluated"), matched.alias("matched_count"),
        F.round(F.coalesce(ratio(matched, total), F.lit(0.0)), 4).alias("match_rate"),
        *[F.coalesce(F.get(own["days"], F.lit(i)), F.lit(0)).alias(n) for i, n in enumerate(names)])


def rule_scores(df: DataFrame, rule: dict) -> DataFrame:
    """Add prediction 0/1 and score 0.95/0.05 of one rule."""
    mask = rule_mask(column_types(df), rule["rule_config"])
    return df.withColumns({"prediction": as_int(mask), "score": F.when(mask, 0.95).otherwise(0.05)})


def rule_sample(df: DataFrame, rule: dict, key: str = "customer_id", n: int = 20) -> DataFrame:
    """Predictions and scores of the first n rows by key."""
    return rule_scores(df, rule).select(key, "prediction", "score").orderBy(key).limit(n)


def rule_hits(df: DataFrame, rules: list[dict], key: str = "customer_id") -> DataFrame:
    """One row per row of df and rule that fired; row-local, no shuffle."""
    types = column_types(df)
    fired = [F.when(rule_mask(types, r["rule_config"]), F.lit(r["model_id"])) for r in rules]
    fired = F.array_compact(F.array(*fired))
    return df.select(key, F.explode(fired).alias("model_id"))


# ---- rules as tables

def flatten_rules(rules: DataFrame) -> DataFrame:
    """Rule documents to table rows: the logic word, and the conditions as JSON text."""
    return rules.select(
        "model_id", "model_name", "category", "target_product", "status",
        F.col("rule_config.logic").alias("logic_operator"),
        F.to_json("rule_config.conditions").alias("rule_conditions"),
    )


def parse_rules(table: DataFrame) -> DataFrame:
    """Table rows back to rule documents."""
    conditions = F.from_json("rule_conditions", RULE_CONFIG[len("struct<logic:string,conditions:"):-1])
    return table.select(
        "model_id", "model_name", "category", "target_product", "status",
        F.struct(F.col("logic_operator").alias("logic"), conditions.alias("conditions")).alias("rule_config"),
    )


def collect_rules(rules: DataFrame) -> list[dict]:
    """Rule documents as configuration for evaluate_rules. The rule table is configuration-sized."""
    return [r.asDict(recursive=True) for r in rules.orderBy("model_id").collect()]
