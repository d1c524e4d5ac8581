"""Customer-360, cohorts, leads, search and log queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensity_spark.functions.scalar import mask_json
from propensity_spark.functions.session import scratch_path
from propensity_spark.operators import customer360 as c360
from propensity_spark.operators import leads as ld
from propensity_spark.operators import search as se
from propensity_spark.operators.indexes import PageIndex, TextIndex
from propensity_spark.operators.templates import template_features, template_query
from propensity_spark.plans import bindings as b
from propensity_spark.plans.registry import query
from propensity_spark.sources.readers import Tables, normalise, save_bucketed, stored

SHOWN = ["customer_id", "segment", "late", *c360.FEATURES, "risk_profile", "is_conversion_successful"]
SHOWN_SQL = "customer_id, segment, CAST(late_payment_flag AS INT) AS late, " + ", ".join(
    c360.FEATURES) + ", risk_profile, CAST(is_conversion_successful AS DOUBLE) AS is_conversion_successful"


def _shown(df: DataFrame, *more: str) -> DataFrame:
    """The columns to compare; whole numbers that may be missing are shown as double, as both engines hand them out."""
    outcome = F.col("is_conversion_successful").cast("double")
    shown = df.withColumns({"late": F.col("late_payment_flag").cast("int"), "is_conversion_successful": outcome})
    return shown.select(*SHOWN, *more)


@query(f"SELECT {SHOWN_SQL} FROM with_outcomes", ["with_outcomes"])
def customer_360(t: Tables) -> DataFrame:
    return _shown(b.with_outcomes(t))


@query(f"""
, newest AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY timestamp DESC, prediction_id DESC) AS rn
  FROM predictions)
SELECT {SHOWN_SQL}, CAST(propensity_score AS DOUBLE) AS propensity_score
FROM profile LEFT JOIN (SELECT * FROM newest WHERE rn = 1) USING (customer_id)""", ["profile", "predictions"])
def customer_360_latest(t: Tables) -> DataFrame:
    parts = [b.credit_card_history(t), b.loan_details(t), b.investment_profiles(t)]
    out = c360.customer_360(b.demographics(t), parts, log=b.predictions(t), latest=("timestamp", "prediction_id"))
    return _shown(out.withColumn("propensity_score", F.col("propensity_score").cast("double")), "propensity_score")


@query(f"SELECT {SHOWN_SQL} FROM with_outcomes WHERE customer_id = 7", ["with_outcomes"])
def customer_lookup(t: Tables) -> DataFrame:
    parts = [b.credit_card_history(t), b.loan_details(t), b.investment_profiles(t)]
    base, log = (c360.lookup(f, "customer_id", 7) for f in (b.demographics(t), b.predictions(t)))
    return _shown(c360.customer_360(base, parts, log=log))


BUCKETS = 16


@query("SELECT customer_id, age, credit_limit, payment_delay_days, fixed_deposit_balance, 0 AS n_shuffles FROM profile",
       ["profile"])
def customer_360_bucketed(t: Tables) -> DataFrame:
    """The star over tables that are stored in the same buckets: a merge of buckets, nothing is shuffled."""
    frames = [b.demographics(t), b.credit_card_history(t), b.loan_details(t), b.investment_profiles(t)]
    names = [f"star_{uuid.uuid4().hex}" for _ in frames]
    for name, frame in zip(names, frames):
        save_bucketed(frame, name, "customer_id", BUCKETS, scratch_path(t.spark, name))
    base, *parts = [t.spark.table(name) for name in names]
    joined = c360.customer_360(base, [p.hint("merge") for p in parts])
    shuffles = joined._jdf.queryExecution().executedPlan().toString().count("Exchange")
    out = stored(joined.select("customer_id", "age", "credit_limit", "payment_delay_days", "fixed_deposit_balance",
                               F.lit(shuffles).alias("n_shuffles")), "star")
    for name in names:
        t.spark.sql(f"DROP TABLE {name}")
    return out


COHORT = {"minimum": {"age": 25, "annual_income": 100000.0, "credit_score": 400}, "maximum": {"age": 65},
          "equals": {"segment": "BUILDING", "location": "All"}}
COHORT_SQL = "age >= 25 AND age <= 65 AND annual_income >= 100000 AND credit_score >= 400 AND segment = 'BUILDING'"


@query(f"SELECT {SHOWN_SQL} FROM with_outcomes WHERE {COHORT_SQL}", ["with_outcomes"])
def cohort_filter(t: Tables) -> DataFrame:
    return _shown(c360.cohort_filter(b.with_outcomes(t), **COHORT))


@query(f"""SELECT {SHOWN_SQL}, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp FROM with_outcomes
WHERE age >= 30 AND timestamp >= TIMESTAMP '2024-01-10' AND timestamp <= TIMESTAMP '2024-01-20'""", ["with_outcomes"])
def cohort_time_window(t: Tables) -> DataFrame:
    out = c360.cohort_filter(b.with_outcomes(t), minimum={"age": 30}, time="timestamp", start="2024-01-10",
                             end="2024-01-20")
    return normalise(_shown(out, "timestamp"))


@query(f"""SELECT count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers FROM with_outcomes
WHERE {COHORT_SQL}""", ["with_outcomes"])
def cohort_count(t: Tables) -> DataFrame:
    return c360.cohort_count(b.with_outcomes(t), **COHORT)


# The pull over all four tables; its columns and joins are fixed values.
TEMPLATE = """SELECT d.customer_id, d.age, d.annual_income, d.credit_score,
  c.credit_limit, c.monthly_spend, c.average_utilization, l.payment_delay_days,
  l.active_loans_count, l.total_outstanding_loan, l.monthly_loan_emi,
  i.mutual_fund_holdings, i.equity_portfolio_value, i.fixed_deposit_balance
FROM demographics d LEFT JOIN credit_card_history c ON d.customer_id = c.customer_id
LEFT JOIN loan_details l ON d.customer_id = l.customer_id
LEFT JOIN investment_profiles i ON d.customer_id = i.customer_id
WHERE {{COHORT_FILTERS}} ORDER BY d.customer_id"""
PULLED = ["customer_id", "age", "annual_income", "credit_limit", "payment_delay_days", "mutual_fund_holdings",
          "fixed_deposit_balance"]


@query(f"""SELECT {', '.join(PULLED)} FROM profile
WHERE age BETWEEN 21 AND 65 AND annual_income >= 25000 AND credit_score >= 600""", ["profile"])
def template_pull(t: Tables) -> DataFrame:
    return template_query(
        t.spark, TEMPLATE, {"age_min": 21, "age_max": 65, "income_min": 25000.0, "credit_score_min": 600, "gender": "All"},
        PULLED, demographics=b.demographics(t), credit_card_history=b.credit_card_history(t),
        loan_details=b.loan_details(t), investment_profiles=b.investment_profiles(t))


@query("""SELECT meta_id, table_name, column_name, pk, fk FROM semantic_metadata
WHERE contains(lower(coalesce(table_name, '') || '|' || coalesce(column_name, '') || '|' || data_type || '|' || pk || '|'
  || fk || '|' || business_definition || '|' || data_sensitivity), 'yes (')
ORDER BY lower(coalesce(column_name, '')) DESC, meta_id LIMIT 25 OFFSET 25""", ["semantic_metadata"])
def catalogue_search(t: Tables) -> DataFrame:
    out = se.search_catalog(b.semantic_metadata(t), "YES (", "column_name", True, number=2)
    return out.select("meta_id", "table_name", "column_name", "pk", "fk")


@query("""SELECT customer_id, credit_score, annual_income, round(monthly_spend * 12.0 / nullif(annual_income, 0), 6)
  AS spend_to_income_ratio, round(monthly_loan_emi * 12.0 / nullif(annual_income, 0), 6) AS debt_burden_ratio
FROM demographics JOIN credit_card_history USING (customer_id) JOIN loan_details USING (customer_id)""",
       ["demographics", "credit_card_history", "loan_details"])
def delinquency_ratios(t: Tables) -> DataFrame:
    out = c360.delinquency_ratios(c360.star_join(b.demographics(t), [b.credit_card_history(t), b.loan_details(t)]))
    return out.select("customer_id", "credit_score", "annual_income",
                      *[F.round(c, 6).alias(c) for c in ("spend_to_income_ratio", "debt_burden_ratio")])


@query("""SELECT customer_id, age, annual_income, credit_score, credit_limit, average_utilization,
  coalesce(payment_delay_days, 0) AS payment_delay_days,
  mutual_fund_holdings + equity_portfolio_value + fixed_deposit_balance AS total_investment_value,
  round(monthly_loan_emi * 12 / CASE WHEN annual_income > 0 THEN annual_income ELSE 1.0 END, 6)
    AS debt_to_income_ratio, monthly_sip_amount
FROM profile WHERE age BETWEEN 18 AND 85 AND annual_income >= 500000 AND credit_score >= 300""", ["profile"])
def engineered_features(t: Tables) -> DataFrame:
    out = c360.engineered_features(b.profile(t), income_min=500000.0, keep=("customer_id",))
    return out.withColumn("debt_to_income_ratio", F.round("debt_to_income_ratio", 6))


@query(f"SELECT {', '.join(c360.FEATURES)} FROM profile", ["profile"])
def selected_features(t: Tables) -> DataFrame:
    return c360.select_features(b.profile(t))


# ---- leads

def _card_details(t: Tables) -> list[DataFrame]:
    return [b.credit_card_history(t), b.loan_details(t).select("customer_id", "payment_delay_days")]


def _card_leads(t: Tables, search: str = "") -> DataFrame:
    return ld.strong_leads(b.demographics(t), _card_details(t), "credit_card_history", b.predictions(t), search)


CARD_LEADS_SQL = """SELECT customer_id, annual_income, credit_score, credit_limit, monthly_spend,
  average_utilization, coalesce(propensity_score, 0) AS propensity_score, prediction_id
FROM demographics JOIN credit_card_history USING (customer_id) JOIN loan_details USING (customer_id)
LEFT JOIN predictions USING (customer_id)
WHERE credit_score > 700 AND annual_income > 800000 AND payment_delay_days = 0"""
CARD_FRAMES = ["demographics", "credit_card_history", "loan_details", "predictions"]
AS_DOUBLE = "* REPLACE (CAST(propensity_score AS DOUBLE) AS propensity_score)"


@query(f"SELECT {AS_DOUBLE} FROM ({CARD_LEADS_SQL})", CARD_FRAMES)
def strong_leads_cards(t: Tables) -> DataFrame:
    return normalise(_card_leads(t))


@query("""SELECT customer_id, annual_income, credit_score, fixed_deposit_balance, equity_portfolio_value,
  monthly_sip_amount, risk_profile FROM demographics JOIN investment_profiles USING (customer_id)
WHERE annual_income > 1000000 AND fixed_deposit_balance > 100000""", ["demographics", "investment_profiles"])
def strong_leads_funds(t: Tables) -> DataFrame:
    return ld.strong_leads(b.demographics(t), [b.investment_profiles(t)], "investment_profiles")


LOAN_LEADS_SQL = """SELECT customer_id, annual_income, credit_score, active_loans_count, total_outstanding_loan,
  monthly_loan_emi FROM demographics JOIN loan_details USING (customer_id)
WHERE credit_score > 720 AND total_outstanding_loan < 300000"""


@query(LOAN_LEADS_SQL, ["demographics", "loan_details"])
def strong_leads_loans(t: Tables) -> DataFrame:
    return ld.strong_leads(b.demographics(t), [b.loan_details(t)], "loan_details")


@query(f"""SELECT {AS_DOUBLE} FROM ({CARD_LEADS_SQL})
WHERE contains(CAST(customer_id AS VARCHAR), '12') OR contains(CAST(CAST(annual_income AS BIGINT) AS VARCHAR), '12')
  OR contains(CAST(credit_score AS VARCHAR), '12') OR contains(CAST(CAST(round(credit_limit) AS BIGINT) AS VARCHAR), '12')
  OR contains(CAST(CAST(monthly_spend AS BIGINT) AS VARCHAR), '12')
  OR contains(CAST(average_utilization AS VARCHAR), '12')
  OR contains(CAST(propensity_score * 100 AS VARCHAR), '12')""", CARD_FRAMES)
def lead_search(t: Tables) -> DataFrame:
    return normalise(_card_leads(t, "12"))


@query(f"""SELECT {AS_DOUBLE} FROM ({CARD_LEADS_SQL}) ORDER BY propensity_score DESC NULLS FIRST,
  credit_score DESC NULLS FIRST, customer_id, prediction_id LIMIT 50 OFFSET 50""", CARD_FRAMES)
def lead_page(t: Tables) -> DataFrame:
    return normalise(ld.lead_page(_card_leads(t), "credit_card_history", number=2, size=50))


@query(f"""SELECT * FROM ({LOAN_LEADS_SQL}) ORDER BY monthly_loan_emi NULLS LAST, customer_id LIMIT 20""",
       ["demographics", "loan_details"])
def lead_page_sorted(t: Tables) -> DataFrame:
    return ld.lead_page(strong_leads_loans(t), "loan_details", "monthly_loan_emi", False, 1, 20)


@query(f"SELECT count(*) AS total FROM ({CARD_LEADS_SQL})", CARD_FRAMES)
def lead_count(t: Tables) -> DataFrame:
    return ld.lead_count(_card_leads(t))


# ---- search, paging, request log

@query("""SELECT * FROM customer WHERE contains(CAST(c_custkey AS VARCHAR), '42') OR contains(lower(c_name), '42')
  OR contains(CAST(c_nationkey AS VARCHAR), '42') OR contains(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), '42')
  OR contains(lower(c_mktsegment), '42')""")
def search_any_column(t: Tables) -> DataFrame:
    return se.search_any(t["customer"], "42")


@query(r"SELECT * FROM part WHERE p_name ILIKE '%r_d%wid%' OR p_type ILIKE '%r_d%wid%'")
def search_with_wildcards(t: Tables) -> DataFrame:
    return se.search_any(t["part"], "R_D%wid", ["p_name", "p_type"], wildcards=True)


LOG_OUT = "* REPLACE (strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS timestamp)"


@query("""SELECT * EXCLUDE (timestamp) FROM request_log WHERE contains(lower(username), 'user_1')
  OR contains(lower(user_role), 'user_1') OR contains(lower(endpoint), 'user_1') OR contains(lower(method), 'user_1')
  OR contains(CAST(status_code AS VARCHAR), 'user_1') OR contains(lower(payload_summary), 'user_1')""",
       ["request_log"])
def log_search(t: Tables) -> DataFrame:
    return se.search_any(b.request_log(t["events"]), "USER_1", se.LOG_SEARCH_COLUMNS).drop("timestamp")


@query(f"""SELECT {LOG_OUT} FROM request_log WHERE contains(lower(endpoint), 'purch')
ORDER BY request_log.timestamp DESC NULLS FIRST, log_id DESC LIMIT 25 OFFSET 50""", ["request_log"])
def log_page(t: Tables) -> DataFrame:
    return se.log_page(b.request_log(t["events"]), " purch ", 3, 25)


@query("""SELECT event_id, user_id, event_type, value FROM events WHERE value > 50.0 OR (value = 50.0 AND event_id > 100)
ORDER BY value, event_id LIMIT 40""")
def page_after(t: Tables) -> DataFrame:
    rows = t["events"].select("event_id", "user_id", "event_type", "value")
    return se.page_after(rows, "value", "event_id", (50.0, 100), 40)


@query("""SELECT prediction_id, customer_id, CAST(propensity_score AS DOUBLE) AS propensity_score FROM predictions
ORDER BY propensity_score DESC, prediction_id LIMIT 40 OFFSET 1240""", ["predictions"])
def page_by_index(t: Tables) -> DataFrame:
    """Page 32 of a listing from the ranges it lies in."""
    rows = b.predictions(t).select("prediction_id", "customer_id", F.col("propensity_score").cast("double")
                                   .alias("propensity_score"))
    index = PageIndex.build(rows, scratch_path(t.spark, "pages"), [("propensity_score", True)], "prediction_id", 8)
    return index.page(32, 40)


@query("""SELECT * EXCLUDE (timestamp) FROM request_log WHERE contains(lower(username), 'user_12')
  OR contains(lower(user_role), 'user_12') OR contains(lower(endpoint), 'user_12') OR contains(lower(method), 'user_12')
  OR contains(CAST(status_code AS VARCHAR), 'user_12') OR contains(lower(payload_summary), 'user_12')""", ["request_log"])
def log_search_by_index(t: Tables) -> DataFrame:
    log = b.request_log(t["events"])
    index = TextIndex.build(log, scratch_path(t.spark, "trigrams"), se.LOG_SEARCH_COLUMNS)
    return index.search("USER_12").drop("timestamp")


@query(r"SELECT * FROM part WHERE p_name ILIKE '%r_d%wid%' OR p_type ILIKE '%r_d%wid%'")
def wildcards_by_index(t: Tables) -> DataFrame:
    index = TextIndex.build(t["part"], scratch_path(t.spark, "trigrams"), ["p_name", "p_type"])
    return index.search("R_D%wid", wildcards=True)


TELEMETRY = """count(*) AS total_requests,
  round(CAST(sum(CAST(latency_ms AS DECIMAL(12,2))) AS DOUBLE) / count(latency_ms), 2) AS avg_latency_ms,
  round(count(*) FILTER (WHERE status_code >= 200 AND status_code < 300) * 100.0 / greatest(1, count(*)), 2)
    AS success_rate"""


@query(f"SELECT {TELEMETRY} FROM request_log", ["request_log"])
def telemetry(t: Tables) -> DataFrame:
    return se.telemetry(b.request_log(t["events"]))


@query(f"SELECT endpoint, user_role, {TELEMETRY} FROM request_log GROUP BY endpoint, user_role", ["request_log"])
def telemetry_by_endpoint(t: Tables) -> DataFrame:
    return se.telemetry(b.request_log(t["events"]), ["endpoint", "user_role"])


@query("""SELECT log_id, username, CASE WHEN json_extract(payload_summary, '$.k') IS NOT NULL
  THEN '{"k":"********"}' ELSE payload_summary END AS payload_summary FROM request_log""", ["request_log"])
def masked_payloads(t: Tables) -> DataFrame:
    log = b.request_log(t["events"])
    return log.select("log_id", "username", mask_json(F.col("payload_summary"), ["k"]).alias("payload_summary"))


@query("""SELECT prediction_id, customer_id, CAST(propensity_score AS DOUBLE) AS propensity_score,
  is_conversion_successful, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp FROM predictions""",
       ["predictions"])
def normalised_predictions(t: Tables) -> DataFrame:
    return normalise(b.predictions(t))


@query(r"""
, names AS (SELECT template_id, code,
  regexp_extract_all(regexp_extract(code,
    '(?is)(selected_columns|selected_features|columns|features)\s*=\s*\[(.*?)\]', 2),
    '[''"]([a-zA-Z0-9_-]+)[''"]', 1) AS listed,
  list_filter(regexp_extract_all(code, '[''"]([a-zA-Z0-9_-]+)[''"]', 1), lambda w: length(w) > 1 AND w NOT IN
    ('SparkSession', 'col', 'table', 'pyspark', 'input_table', 'select', 'credit_card', 'mutual_funds', 'loans',
     'defaulter')) AS words FROM template_texts),
picked AS (SELECT template_id, CASE WHEN len(listed) > 0 THEN listed ELSE words END AS names FROM names)
SELECT template_id, array_to_string(list_filter(names, lambda w, i: list_position(names, w) = i), ', ') AS features
FROM picked""", ["template_texts"])
def template_feature_names(t: Tables) -> DataFrame:
    out = template_features(b.template_texts(t))
    return out.select("template_id", F.concat_ws(", ", "features").alias("features"))
