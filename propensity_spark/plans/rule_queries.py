"""Rule, label, preparation and derived-feature queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensity_spark.operators import features as ft
from propensity_spark.operators import labels as lb
from propensity_spark.operators import prepare as pr
from propensity_spark.operators import rules as ru
from propensity_spark.operators.rule_index import evaluate_many
from propensity_spark.operators.customer360 import FEATURES
from propensity_spark.operators.leads import top_leads
from propensity_spark.plans import bindings as b
from propensity_spark.plans.registry import query
from propensity_spark.sources.readers import Tables, stored

# ---- rules

EXTRA_RULES = [
    ru.make_rule("x_any", "Any of", [("segment", "in", ["BUILDING", "MACHINERY"]), ("credit_score", "<", "350")], "OR"),
    ru.make_rule("x_text", "Text in text", [("risk_profile", "in", "Aggressive or Moderate")]),
    ru.make_rule("x_not", "Not equal", [("risk_profile", "!=", "Moderate"), ("annual_income", ">", "-5000")]),
    ru.make_rule("x_unknown", "Unknown feature", [("shoe_size", ">=", 1)]),
    ru.make_rule("x_operator", "Unknown operator", [("age", "~", 1)]),
    ru.make_rule("x_empty", "No conditions", []),
    ru.make_rule("x_number", "Number in text", [("age", "in", "30.0, 31.0, 45.0")]),
]
EXTRA_SQL = {
    "x_any": "segment IN ('BUILDING', 'MACHINERY') OR credit_score < 350",
    "x_text": "contains('Aggressive or Moderate', risk_profile)",
    "x_not": "risk_profile <> 'Moderate' AND annual_income > -5000",
    "x_unknown": "false", "x_operator": "false", "x_empty": "false",
    "x_number": "contains('30.0, 31.0, 45.0', age || '.0')",
}
ALL_RULES = ru.default_rules() + EXTRA_RULES


def _rule_sql(rule: dict) -> str:
    if rule["model_id"] in EXTRA_SQL:
        return EXTRA_SQL[rule["model_id"]]
    return " AND ".join(f"{c['feature']} {c['operator'].replace('==', '=')} {c['value']}"
                        for c in rule["rule_config"]["conditions"])


HITS_SQL = ", hits AS (" + "\nUNION ALL ".join(
    f"SELECT customer_id, '{r['model_id']}' AS model_id, '{r['model_name']}' AS model_name, "
    f"coalesce({_rule_sql(r)}, false) AS hit, coalesce(payment_delay_days, 0) AS delay FROM population"
    for r in ALL_RULES) + ")"
RUN_SQL = """
SELECT model_id, model_name, count(*) AS total_evaluated, count(*) FILTER (WHERE hit) AS matched_count,
  round(count(*) FILTER (WHERE hit) / count(*), 4) AS match_rate,
  count(*) FILTER (WHERE hit AND delay <= 0) AS dpd_0,
  count(*) FILTER (WHERE hit AND delay > 0 AND delay <= 30) AS dpd_1_30,
  count(*) FILTER (WHERE hit AND delay > 30 AND delay <= 60) AS dpd_31_60,
  count(*) FILTER (WHERE hit AND delay > 60 AND delay <= 90) AS dpd_61_90,
  count(*) FILTER (WHERE hit AND delay > 90) AS dpd_over_90
FROM hits GROUP BY model_id, model_name"""


@query(f", population AS (SELECT * FROM with_outcomes)\n{HITS_SQL}\n{RUN_SQL}", ["with_outcomes"])
def rule_monthly_run(t: Tables) -> DataFrame:
    return evaluate_many(b.with_outcomes(t), ALL_RULES)


MANY_SQL = """, rule AS (SELECT DISTINCT 'r_' || p_brand || '_' || p_size AS model_id, p_size AS s,
  CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS k FROM part),
hits AS (SELECT model_id, model_id AS model_name, coalesce(payment_delay_days, 0) AS delay, coalesce(CASE s % 4
  WHEN 0 THEN age >= 18 + s AND credit_score < 300 + 10 * k
  WHEN 1 THEN age < 18 + s OR annual_income > 20000 * k
  WHEN 2 THEN segment <> 'BUILDING' AND average_utilization <= s / 50.0 AND credit_score >= 300 + 10 * k
  ELSE (segment = 'MACHINERY' OR segment = 'AUTOMOBILE') AND age = 18 + s END, false) AS hit
  FROM rule, profile)
"""


def _many_rules(t: Tables) -> list[dict]:
    """A rule per brand and size: more than a thousand, of four kinds."""
    kinds = [
        lambda s, k: ([("age", ">=", 18 + s), ("credit_score", "<", 300 + 10 * k)], "AND"),
        lambda s, k: ([("age", "<", str(18 + s)), ("annual_income", ">", 20000 * k)], "OR"),
        lambda s, k: ([("segment", "!=", "BUILDING"), ("average_utilization", "<=", s / 50.0),
                       ("credit_score", ">=", 300 + 10 * k)], "AND"),
        lambda s, k: ([("segment", "in", ["MACHINERY", "AUTOMOBILE"]), ("age", "==", 18 + s)], "AND"),
    ]
    kinds_of = t["part"].select("p_brand", "p_size").distinct().orderBy("p_brand", "p_size").collect()
    made = []
    for r in kinds_of:
        conditions, logic = kinds[r["p_size"] % 4](r["p_size"], int("".join(c for c in r["p_brand"] if c.isdigit())))
        name = f"r_{r['p_brand']}_{r['p_size']}"
        made.append(ru.make_rule(name, name, conditions, logic))
    return made


@query(MANY_SQL + RUN_SQL, ["profile"])
def rule_run_many(t: Tables) -> DataFrame:
    """More than a thousand rules over everyone by the threshold index."""
    return evaluate_many(b.profile(t), _many_rules(t))


@query(f", population AS (SELECT * FROM profile)\n{HITS_SQL}\nSELECT * FROM ({RUN_SQL}) WHERE model_id = 'x_any'",
       ["profile"])
def rule_evaluate(t: Tables) -> DataFrame:
    return ru.evaluate_rules(b.profile(t), EXTRA_RULES[:1])


@query(f""", population AS (SELECT * FROM profile)\n{HITS_SQL}
SELECT customer_id, model_id FROM hits WHERE hit""", ["profile"])
def rule_hits(t: Tables) -> DataFrame:
    return ru.rule_hits(b.profile(t), ALL_RULES)


@query("""SELECT customer_id, CAST(coalesce(payment_delay_days >= 30, false) AS INT) AS prediction,
  CASE WHEN payment_delay_days >= 30 THEN CAST(0.95 AS DOUBLE) ELSE 0.05 END AS score FROM profile""", ["profile"])
def rule_scores(t: Tables) -> DataFrame:
    return ru.rule_scores(b.profile(t), ru.default_rules()[1]).select("customer_id", "prediction", "score")


@query("""SELECT customer_id, CAST(coalesce(payment_delay_days >= 30, false) AS INT) AS prediction,
  CASE WHEN payment_delay_days >= 30 THEN CAST(0.95 AS DOUBLE) ELSE 0.05 END AS score FROM profile
ORDER BY customer_id LIMIT 20""", ["profile"])
def rule_sample(t: Tables) -> DataFrame:
    return ru.rule_sample(b.profile(t), ru.default_rules()[1])


@query("""SELECT bucket, count(*) FILTER (WHERE payment_delay_days > low AND payment_delay_days <= high) AS n
FROM (VALUES ('0 DPD (Current)', -1, 0), ('1-30 DPD', 0, 30), ('31-60 DPD', 30, 60), ('61-90 DPD', 60, 90),
  ('90+ DPD', 90, 1000000)) v(bucket, low, high), delay_lines GROUP BY bucket""", ["delay_lines"])
def dpd_buckets(t: Tables) -> DataFrame:
    return ru.dpd_buckets(b.delay_lines(t))


@query("""SELECT model_id, model_name, category, 'Credit Card' AS target_product, 'Active' AS status,
  'AND' AS logic_operator, '[' || coalesce(array_to_string(list_transform(range(n_conditions), lambda i:
    '{"feature":"' || feature || '","operator":">=","value":"' || value || '"}'), ','), '') || ']' AS rule_conditions
FROM registry_rules""", ["registry_rules"])
def rules_as_table(t: Tables) -> DataFrame:
    """Through both directions: documents to rows, back, and to rows again."""
    return ru.flatten_rules(ru.parse_rules(ru.flatten_rules(b.registry_rules(t))))


# ---- labels

@query("""SELECT customer_id, CAST(coalesce(is_conversion_successful = 1, false) AS INT) AS card,
  CAST(coalesce(monthly_sip_amount > 0, false) AS INT) AS funds,
  CAST(coalesce(active_loans_count > 0, false) AS INT) AS loans,
  CAST(coalesce(late_payment_flag, false) AS INT) AS defaulter,
  CAST(coalesce(lower(risk_profile) = 'aggressive', false) AS INT) AS aggressiveness FROM with_outcomes""",
       ["with_outcomes"])
def campaign_labels(t: Tables) -> DataFrame:
    names = {"card": "credit_card", "funds": "mutual_funds", "loans": "loans", "defaulter": "defaulter",
             "aggressiveness": "investment_aggressiveness"}
    return b.with_outcomes(t).select("customer_id", *[lb.campaign_target(c).alias(n) for n, c in names.items()])


@query("""SELECT customer_id, CAST(CASE
  WHEN coalesce(monthly_spend, 0) >= 30000 OR coalesce(monthly_loan_emi, 0) >= 60000 THEN 1
  WHEN coalesce(monthly_spend, 0) >= 60000 OR coalesce(monthly_loan_emi, 0) >= 30000 THEN 1
  WHEN coalesce(payment_delay_days, 0) >= 1000 THEN 1
  WHEN coalesce(payment_delay_days, 0) <= 40 AND NOT coalesce(late_payment_flag, false) THEN 0
  ELSE CAST(coalesce(is_conversion_successful = 1, false) AS INT) END AS INT) AS label FROM with_outcomes""",
       ["with_outcomes"])
def event_tagging(t: Tables) -> DataFrame:
    out = lb.campaign_labels(b.with_outcomes(t), "credit_card")
    out = lb.event_tags(out, auto_cure_max_dpd=40, roll_forward_min_dpd=1000, money_collected_min=30000.0)
    return out.select("customer_id", "label")


def _bucket_sql(key: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5({key} || '|{seed}'), 1, 8) AS BIGINT) % 10000"


@query(f"""SELECT c_custkey, CASE WHEN {_bucket_sql('c_custkey', 42)} < 8000 THEN 'train' ELSE 'test' END AS part
FROM customer""")
def hash_split(t: Tables) -> DataFrame:
    return lb.hash_split(t["customer"].select("c_custkey"), "c_custkey", 0.8)


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5(c_custkey || '|7'), c_custkey LIMIT 100")
def hash_sample(t: Tables) -> DataFrame:
    return lb.hash_sample(t["customer"].select("c_custkey", "c_name"), "c_custkey", 100, seed=7)


# ---- preparation

@query("".join(f"{'UNION ALL ' if i else ''}SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS null_count,"
               f" round(count(*) FILTER (WHERE {c} IS NULL) / greatest(1, count(*)), 4) AS null_share FROM with_outcomes\n"
               for i, c in enumerate(FEATURES)) + "UNION ALL SELECT 'shoe_size', 0, 0.0", ["with_outcomes"])
def missing_stats(t: Tables) -> DataFrame:
    return pr.missing_stats(b.with_outcomes(t), [*FEATURES, "shoe_size"])


@query("""SELECT customer_id, age, coalesce(mutual_fund_holdings, 0.0) AS mutual_fund_holdings,
  round(coalesce(equity_portfolio_value, (SELECT avg(equity_portfolio_value) FROM profile)), 4)
    AS equity_portfolio_value,
  coalesce(fixed_deposit_balance, (SELECT median(fixed_deposit_balance) FROM profile)) AS fixed_deposit_balance,
  coalesce(payment_delay_days, (SELECT median(payment_delay_days) FROM profile)) AS payment_delay_days
FROM profile""", ["profile"])
def impute(t: Tables) -> DataFrame:
    used = ["mutual_fund_holdings", "equity_portfolio_value", "fixed_deposit_balance", "payment_delay_days",
            "monthly_sip_amount"]
    out = pr.impute(stored(b.profile(t).select("customer_id", "age", *used), "features"), {
        "mutual_fund_holdings": "zero", "equity_portfolio_value": "mean", "fixed_deposit_balance": "median",
        "payment_delay_days": "median", "monthly_sip_amount": "drop"})
    return out.withColumn("equity_portfolio_value", F.round("equity_portfolio_value", 4))


LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, median({c}) AS median FROM lineitem" for c in LINE_COLUMNS))
def feature_medians(t: Tables) -> DataFrame:
    return pr.medians(t["lineitem"], LINE_COLUMNS)


@query("""SELECT 'l_quantity' AS feature, median(l_quantity) AS median FROM lineitem WHERE l_linenumber > 1
UNION ALL SELECT 'nothing', NULL""")
def medians_with_nan(t: Tables) -> DataFrame:
    """NaN counts as missing, and a feature without values keeps its row."""
    nan = F.lit(float("nan"))
    lines = t["lineitem"].select(F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).otherwise(nan).alias("l_quantity"),
                                 F.when(F.col("l_linenumber") > 1, nan).alias("nothing"))
    return pr.medians(lines, ["l_quantity", "nothing"])


@query("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber > 2 THEN l_quantity END, m.q) AS l_quantity
FROM lineitem, (SELECT avg(l_quantity) AS q FROM lineitem WHERE l_linenumber > 2) m""")
def impute_nan(t: Tables) -> DataFrame:
    known = F.when(F.col("l_linenumber") > 2, F.col("l_quantity")).otherwise(F.lit(float("nan")))
    lines = t["lineitem"].select("l_orderkey", "l_linenumber", known.alias("l_quantity"))
    return pr.impute(lines, {"l_quantity": "mean"})


@query(f"""SELECT model_id, model_name, 0 AS total_evaluated, 0 AS matched_count, 0.0 AS match_rate, 0 AS dpd_0,
  0 AS dpd_1_30, 0 AS dpd_31_60, 0 AS dpd_61_90, 0 AS dpd_over_90 FROM (VALUES {', '.join(
      f"('{r['model_id']}', '{r['model_name']}')" for r in ALL_RULES)}) v(model_id, model_name)""")
def rule_run_of_nobody(t: Tables) -> DataFrame:
    """A cohort without rows gives every rule a row."""
    return ru.evaluate_rules(b.profile(t).filter("age > 200"), ALL_RULES)


def _lines(t: Tables) -> DataFrame:
    """Line figures with a constant column and one that is missing for a part of the rows."""
    return t["lineitem"].select(
        *LINE_COLUMNS, F.lit(3.5).alias("fixed"),
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice") + F.col("l_tax") * 100000).alias("gross"))


CORR_COLUMNS = [*LINE_COLUMNS, "fixed", "gross"]


def _corr_sql(x: str, y: str) -> str:
    if "fixed" in (x, y):
        return f"SELECT '{x}' AS feature_a, '{y}' AS feature_b, 0.0 AS corr"
    return f"SELECT '{x}' AS feature_a, '{y}' AS feature_b, round(coalesce(corr({x}, {y}), 0.0), 6) + 0.0 AS corr FROM lines"


@query(" UNION ALL ".join(_corr_sql(x, y) for x in CORR_COLUMNS for y in CORR_COLUMNS), ["lines"])
def correlation(t: Tables) -> DataFrame:
    return pr.correlation(_lines(t), CORR_COLUMNS).withColumn("corr", F.round("corr", 6))


FAR = ["late", "near", "l_tax"]


@query(""", far AS (SELECT CASE WHEN l_orderkey > 500 THEN 1e7 + l_quantity END AS late,
  l_quantity + l_tax * 10 AS near, l_tax FROM lineitem)
""".replace(", far", "WITH far", 1) + " UNION ALL ".join(
    f"SELECT '{x}' AS feature_a, '{y}' AS feature_b, round(corr({x}, {y}), 5) + 0.0 AS corr FROM far"
    for x in FAR for y in FAR))
def correlation_far(t: Tables) -> DataFrame:
    """A column that starts with missing rows and lies far from 0."""
    late = F.when(F.col("l_orderkey") > 500, F.col("l_quantity") + 1e7).alias("late")
    near = (F.col("l_quantity") + F.col("l_tax") * 10).alias("near")
    out = pr.correlation(t["lineitem"].select(late, near, "l_tax"), FAR)
    return out.withColumn("corr", F.round("corr", 5))


MASKED = ["spike", "line", "price"]


@query("""WITH masked AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 1e12 ELSE l_quantity END AS spike,
  CASE WHEN l_linenumber % 2 = 1 THEN l_quantity * 3 - 7 END AS line,
  CASE WHEN l_linenumber % 3 > 0 THEN l_extendedprice END AS price FROM lineitem)
""" + " UNION ALL ".join(
    f"SELECT '{x}' AS feature_a, '{y}' AS feature_b, round(corr({x}, {y}), 9) + 0.0 AS corr FROM masked"
    for x in MASKED for y in MASKED))
def correlation_masked(t: Tables) -> DataFrame:
    """Outliers that stand only where the other column is missing: spike and line are one straight line."""
    number, quantity = F.col("l_linenumber"), F.col("l_quantity")
    lines = t["lineitem"].select(
        F.when(number % 2 == 0, 1e12).otherwise(quantity).alias("spike"),
        F.when(number % 2 == 1, quantity * 3 - 7).alias("line"),
        F.when(number % 3 > 0, F.col("l_extendedprice")).alias("price"))
    return pr.correlation(lines, MASKED).withColumn("corr", F.round("corr", 9))


def _copies(t: Tables) -> DataFrame:
    """`double` and `less` say what l_quantity says."""
    q = F.col("l_quantity")
    return t["lineitem"].select("l_orderkey", "l_linenumber", "l_quantity", (q * 2).alias("double"),
                                (F.lit(100) - q).alias("less"), "l_tax")


COPIES = ["l_quantity", "double", "l_tax", "less"]


@query("""SELECT * FROM (VALUES (1, 'l_quantity', 'l_quantity', 1), (1, 'double', 'l_quantity', 0),
  (1, 'less', 'l_quantity', 0), (2, 'l_tax', 'l_tax', 1)) v(cluster_id, feature, representative, is_representative)""")
def clusters_of_copies(t: Tables) -> DataFrame:
    out = pr.feature_clusters(pr.correlation(_copies(t), COPIES), COPIES)
    return out.withColumn("is_representative", F.col("is_representative").cast("int"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem")
def representatives(t: Tables) -> DataFrame:
    lines = _copies(t)
    clusters = pr.feature_clusters(pr.correlation(lines, COPIES), COPIES)
    return pr.keep_representatives(lines, clusters, ["l_orderkey", "l_linenumber"])


def _clusters_sql(cols: list[str], source: str, cut: float = 0.5) -> str:
    """Average linkage, one merge of the nearest two groups per step; a group is known by its first feature's place."""
    corr = " UNION ALL ".join(f"SELECT {i} AS a, {j} AS b, " + (
        "0.0" if "fixed" in (x, y) else f"(SELECT coalesce(corr({x}, {y}), 0.0) FROM {source})") + " AS r"
        for i, x in enumerate(cols) for j, y in enumerate(cols))
    steps = [f"g0 AS (SELECT * FROM (VALUES {', '.join(f'({i}, {i})' for i in range(len(cols)))}) v(f, g))"]
    for k in range(len(cols) - 1):
        steps.append(f"""m{k} AS MATERIALIZED (SELECT x.g AS a, y.g AS b, avg(1.0 - least(abs(r), 1.0)) AS d
  FROM g{k} x JOIN g{k} y ON x.g < y.g JOIN dist ON dist.a = x.f AND dist.b = y.f GROUP BY x.g, y.g
  ORDER BY d, a, b LIMIT 1),
g{k + 1} AS MATERIALIZED (SELECT f, CASE WHEN g = b AND d <= {cut} THEN a ELSE g END AS g
  FROM g{k} LEFT JOIN m{k} ON true)""")
    names = f"(VALUES {', '.join(f'({i}, {c!r})' for i, c in enumerate(cols))})"
    return f""", dist AS MATERIALIZED ({corr}),
{', '.join(steps)}
SELECT CAST(dense_rank() OVER (ORDER BY g) AS INT) AS cluster_id, n.c AS feature, h.c AS representative,
  CAST(f = g AS INT) AS is_representative
FROM g{len(cols) - 1} JOIN {names} n(i, c) ON n.i = f JOIN {names} h(i, c) ON h.i = g"""


@query(_clusters_sql(CORR_COLUMNS, "lines"), ["lines"])
def feature_clusters(t: Tables) -> DataFrame:
    out = pr.feature_clusters(pr.correlation(_lines(t), CORR_COLUMNS), CORR_COLUMNS)
    return out.withColumn("is_representative", F.col("is_representative").cast("int"))


# ---- derived features

AFFINITY_SQL = """, raw AS (SELECT *, CASE WHEN coalesce(annual_income, 0) <= 0 THEN 1.0 ELSE annual_income END AS inc
  FROM profile), aff AS (SELECT *,
  coalesce(monthly_spend, 0.0) * 12.0 / inc * (1.0 - coalesce(average_utilization, 0.0)) AS ca,
  coalesce(fixed_deposit_balance, 0.0) / inc AS fa,
  coalesce(nullif(credit_score, 0), 300) / CAST(850.0 AS DOUBLE)
    / (coalesce(active_loans_count, 0) + CAST(1.0 AS DOUBLE)) * 0.3 AS la FROM raw)
SELECT customer_id, round(ca, 4) AS card_affinity, round(fa, 4) AS fund_affinity, round(la, 4) AS loan_affinity,
  CASE WHEN ca >= fa AND ca >= la THEN 'Credit Cards' WHEN fa >= la THEN 'Mutual Funds' ELSE 'Retail Loans' END
    AS recommended_product FROM aff"""
AFFINITY = ["customer_id", "card_affinity", "fund_affinity", "loan_affinity", "recommended_product"]


@query(AFFINITY_SQL, ["profile"])
def affinity(t: Tables) -> DataFrame:
    return ft.affinity(b.profile(t)).select(*AFFINITY)


THUMB_SQL = """round(CAST(0.15 AS DOUBLE) + CASE WHEN credit_score > 700 THEN 0.3 ELSE 0.0 END
  + CASE WHEN annual_income > 1000000 THEN 0.2 ELSE 0.0 END
  + CASE WHEN age BETWEEN 25 AND 45 THEN 0.15 ELSE 0.0 END, 4)"""


@query(f"""SELECT customer_id, {THUMB_SQL} AS propensity,
  CAST({THUMB_SQL} >= 0.55 AS INT) AS predicted_label FROM demographics""", ["demographics"])
def rule_of_thumb(t: Tables) -> DataFrame:
    return ft.rule_of_thumb(b.demographics(t)).select("customer_id", "propensity", "predicted_label")


@query(f""", scored AS (SELECT customer_id, {THUMB_SQL} AS propensity FROM demographics),
affinities AS (SELECT * FROM ({AFFINITY_SQL.replace(', raw AS', 'WITH raw AS', 1)}))
SELECT customer_id, propensity, card_affinity, fund_affinity, loan_affinity, recommended_product
FROM scored JOIN affinities USING (customer_id) ORDER BY propensity DESC, customer_id LIMIT 100""", ["profile"])
def next_best_action_leads(t: Tables) -> DataFrame:
    scored = ft.affinity(ft.rule_of_thumb(b.profile(t)))
    return top_leads(scored, "propensity").select(AFFINITY[0], "propensity", *AFFINITY[1:])


@query("""SELECT customer_id, round(CASE WHEN total_outstanding_loan <= 0 THEN 0.0 WHEN average_interest_rate > 0 THEN
    greatest(1500.0, total_outstanding_loan * (average_interest_rate / 12)
      / (1 - pow(1 + average_interest_rate / 12, -60))) ELSE 1500.0 END, 2) AS emi,
  CASE WHEN annual_income > 0 THEN round((total_outstanding_loan + monthly_loan_emi) / annual_income, 4) ELSE 0.0 END
    AS loan_to_income_ratio, round(monthly_spend * 0.015 * 12, 2) AS cashback_earned,
  CAST(coalesce(payment_delay_days > 15, false) AS INT) AS late_flag
FROM profile WHERE total_outstanding_loan IS NOT NULL""", ["profile"])
def loan_figures(t: Tables) -> DataFrame:
    known = b.profile(t).filter(F.col("total_outstanding_loan").isNotNull())
    out = ft.loan_ratios(known, ["total_outstanding_loan", "monthly_loan_emi"])
    emi = ft.annuity(F.col("total_outstanding_loan"), F.col("average_interest_rate"))
    return out.select("customer_id", F.round(emi, 2).alias("emi"), "loan_to_income_ratio",
                      F.round("cashback_earned", 2).alias("cashback_earned"), F.col("late_flag").cast("int"))


STRESS_SQL = """, s AS (SELECT customer_id FROM demographics ORDER BY md5(customer_id || '|1'), customer_id LIMIT 400),
c AS (SELECT customer_id FROM demographics ORDER BY md5(customer_id || '|2'), customer_id LIMIT 400),
stressed AS (SELECT customer_id,
  CASE WHEN customer_id IN (FROM s) THEN greatest(300, credit_score - 110) ELSE credit_score END AS credit_score,
  CASE WHEN customer_id IN (FROM c) AND average_utilization IS NOT NULL
    THEN least(1.0, average_utilization * CAST(1.35 AS DOUBLE)) ELSE average_utilization END AS average_utilization,
  CASE WHEN customer_id IN (FROM c) THEN payment_delay_days + 15 ELSE payment_delay_days END AS payment_delay_days
FROM profile)
"""


def _stress_base(t: Tables) -> DataFrame:
    """A third of the customers have no card."""
    usage = F.when(F.col("customer_id") % 3 != 0, F.col("average_utilization")).alias("average_utilization")
    return stored(b.profile(t).select("customer_id", "credit_score", usage, "payment_delay_days"), "stress")


@query(STRESS_SQL + """SELECT customer_id, credit_score,
  CASE WHEN customer_id % 3 <> 0 THEN round(average_utilization, 6) END AS average_utilization,
  payment_delay_days FROM stressed""", ["profile"])
def stress(t: Tables) -> DataFrame:
    out = ft.stress(_stress_base(t), n=400)
    return out.withColumn("average_utilization", F.round("average_utilization", 6))


@query(STRESS_SQL.split("stressed AS")[0] + """stressed AS (SELECT customer_id,
  CASE WHEN customer_id IN (FROM s) THEN least(850, credit_score + 110) ELSE credit_score END AS credit_score,
  CASE WHEN customer_id IN (FROM c) THEN average_utilization / CAST(1.35 AS DOUBLE) ELSE average_utilization END
    AS average_utilization,
  CASE WHEN customer_id IN (FROM c) AND payment_delay_days IS NOT NULL THEN greatest(0, payment_delay_days - 15)
    ELSE payment_delay_days END AS payment_delay_days FROM profile)
SELECT customer_id, credit_score, CASE WHEN customer_id % 3 <> 0 THEN round(average_utilization, 6) END
  AS average_utilization, payment_delay_days FROM stressed""", ["profile"])
def stress_inverse(t: Tables) -> DataFrame:
    out = ft.stress(_stress_base(t), ft.BETTER, n=400)
    return out.withColumn("average_utilization", F.round("average_utilization", 6))


@query("""SELECT user_id AS customer_id, event_id FROM events WHERE user_id IN (
  SELECT c_custkey FROM customer ORDER BY md5(c_custkey || '|3'), c_custkey LIMIT 500)""")
def cohort_by_keys(t: Tables) -> DataFrame:
    keys = t["customer"].select(F.col("c_custkey").alias("customer_id"))
    log = t["events"].select(F.col("user_id").alias("customer_id"), "event_id")
    return ft.cohort_by_keys(log, lb.hash_sample(keys, "customer_id", 500, seed=3))

