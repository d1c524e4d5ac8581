"""The driver tables in the shape the operators work on, each as a DataFrame and as the same SQL.

Money is summed in whole cents and ratios are rounded half up in whole numbers, so both engines agree to the digit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensity_spark.operators.customer360 import customer_360
from propensity_spark.sources.readers import Tables


def cents(name: str) -> Column:
    """Money in whole cents. `round` on doubles goes through decimals, floor does not."""
    return F.floor(F.col(name) * 100 + 0.5)


def _sum_if(cond: Column, value: Column) -> Column:
    return F.sum(F.when(cond, value).otherwise(F.lit(0)))


def demographics(t: Tables) -> DataFrame:
    located = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    located = located.join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("c_custkey")
    return located.select(
        key.alias("customer_id"), (key * 7 % 68 + 18).cast("int").alias("age"),
        F.col("c_mktsegment").alias("segment"), (cents("c_acctbal") * 2).cast("double").alias("annual_income"),
        (key * 37 % 551 + 300).cast("int").alias("credit_score"), F.col("n_name").alias("location"),
        F.col("r_name").alias("region"),
    )


def credit_card_history(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    return t["orders"].groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.max("o_totalprice").alias("credit_limit"),
        F.round(F.sum(cents("o_totalprice")) / 12000.0).alias("monthly_spend"),
        (F.floor((F.count_if(F.col("o_orderstatus") == "O") * 20000 + n) / (n * 2)) / 10000.0)
        .alias("average_utilization"),
    )


def loan_details(t: Tables) -> DataFrame:
    """Lines are reduced to one row per order before the join, on the key the join uses."""
    price = cents("l_extendedprice")
    lines = t["lineitem"].groupBy("l_orderkey").agg(
        (F.max(F.col("l_linenumber") * 100000 + F.unix_date(F.to_date("l_shipdate"))) % 100000).alias("ship_day"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        _sum_if(F.col("l_linestatus") == "O", price).alias("open_cents"),
        F.sum(price).alias("cents"), F.sum(cents("l_tax")).alias("tax"), F.count(F.lit(1)).alias("n"),
    )
    placed = t["orders"].select("o_orderkey", "o_custkey", F.unix_date(F.to_date("o_orderdate")).alias("day"))
    delay = F.greatest(F.col("ship_day") - F.col("day"), F.lit(0))
    out = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    return out.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        (F.max(F.col("o_orderkey") * 100000 + delay) % 100000).cast("int").alias("payment_delay_days"),
        F.count_if(F.col("returned") >= 3).cast("int").alias("active_loans_count"),
        F.round(F.sum("open_cents") / 400.0).alias("total_outstanding_loan"),
        (F.floor((F.sum("tax") * 200 + F.sum("n")) / (F.sum("n") * 2)) / 10000.0).alias("average_interest_rate"),
        F.round(F.sum("cents") / 4800.0).alias("monthly_loan_emi"),
    ).withColumn("late_payment_flag", F.col("payment_delay_days") > 15)


def investment_profiles(t: Tables) -> DataFrame:
    value, kind = cents("value"), F.col("event_type")
    profiles = F.array(*[F.lit(p) for p in ("Aggressive", "Very Aggressive", "Moderate", "Conservative")])
    return t["events"].groupBy(F.col("user_id").alias("customer_id")).agg(
        _sum_if(kind == "purchase", value).cast("double").alias("mutual_fund_holdings"),
        (_sum_if(kind == "view", value) * 2).cast("double").alias("equity_portfolio_value"),
        F.sum(value).cast("double").alias("fixed_deposit_balance"),
        F.round(_sum_if((kind == "click") & (value > 10000), value) / 10.0).alias("monthly_sip_amount"),
        F.get(profiles, (F.count(F.lit(1)) % 4).cast("int")).alias("risk_profile"),
    )


def predictions(t: Tables) -> DataFrame:
    """One scored row per event; the score is the value in 200ths, rounded half up in whole numbers."""
    score = F.floor((F.least(cents("value"), F.lit(20000)) + 1) / 2) / 10000.0
    kind = F.col("event_type")
    return t["events"].select(
        F.col("event_id").alias("prediction_id"), F.col("user_id").alias("customer_id"),
        score.cast("decimal(5,4)").alias("propensity_score"),
        F.when(kind == "purchase", 1).when(kind == "signup", -1).otherwise(0).alias("is_conversion_successful"),
        F.col("ts").alias("timestamp"),
    )


def request_log(events: DataFrame) -> DataFrame:
    user, kind = F.col("user_id"), F.col("event_type")
    roles = F.array(*[F.lit(r) for r in ("analyst", "admin", "guest")])
    return events.select(
        F.col("event_id").alias("log_id"), F.col("ts").alias("timestamp"),
        F.concat(F.lit("user_"), user.cast("string")).alias("username"),
        F.get(roles, (user % 3).cast("int")).alias("user_role"),
        F.concat(F.lit("/api/"), kind).alias("endpoint"),
        F.when(kind.isin("purchase", "signup"), "POST").otherwise("GET").alias("method"),
        F.when(kind == "error", 500).otherwise(200).alias("status_code"),
        F.col("value").alias("latency_ms"), F.col("props").alias("payload_summary"),
    )


def details(t: Tables) -> list[DataFrame]:
    return [credit_card_history(t), loan_details(t), investment_profiles(t)]


def profile(t: Tables) -> DataFrame:
    """The 1:1 part of customer-360."""
    return customer_360(demographics(t), details(t))


def with_outcomes(t: Tables) -> DataFrame:
    log = predictions(t).select("customer_id", "is_conversion_successful", "timestamp")
    return customer_360(demographics(t), [credit_card_history(t), loan_details(t), investment_profiles(t)], log=log)


def delay_lines(t: Tables) -> DataFrame:
    lines = t["lineitem"].select("l_orderkey", "l_shipdate").join(
        t["orders"].select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return lines.select(F.greatest(days, F.lit(0)).alias("payment_delay_days"))


def score_sides(t: Tables) -> DataFrame:
    """Scores before and from 2024-01-16 as the expected and the actual side."""
    early = F.col("timestamp") < F.lit("2024-01-16").cast("timestamp_ntz")
    return predictions(t).withColumn("side", F.when(early, "expected").otherwise("actual"))


def registry_models(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    auc, pr = F.when(size % 7 != 0, size / 100.0 + 0.5), F.when(size % 5 != 0, size / 100.0 + 0.4)
    return t["part"].select(
        F.concat(F.lit("m_"), key.cast("string")).alias("model_id"), key.alias("seq"),
        F.col("p_type").alias("algorithm_type"), F.col("p_brand").alias("version"),
        F.when(key == 0, "champion").when(key % 4 == 3, "migrated").otherwise("challenger").alias("status"),
        F.when(size % 3 == 0, "Rule").otherwise("ML").alias("model_category"),
        F.create_map(F.lit("roc_auc"), auc, F.lit("pr_auc"), pr).alias("baselines"),
        F.create_map(F.lit("latency"), key % 800 / 10.0).alias("live_metrics"),
    )


def registry_rules(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    cond = F.struct(
        F.when(key % 2 == 0, "annual_income").otherwise("credit_score").alias("feature"),
        F.lit(">=").alias("operator"), F.floor("s_acctbal").cast("string").alias("value"))
    gini = F.when(key % 9 != 0, (F.floor("s_acctbal") / 10000.0).cast("string"))
    return t["supplier"].select(
        F.concat(F.lit("rule_"), key.cast("string")).alias("model_id"), F.col("s_name").alias("model_name"),
        F.when(key % 2 == 0, "Acquisition").otherwise("Risk Control").alias("category"),
        F.lit("Credit Card").alias("target_product"), F.lit("Active").alias("status"),
        F.struct(F.lit("AND").alias("logic"), F.array_repeat(cond, (key % 4).cast("int")).alias("conditions"))
        .alias("rule_config"),
        F.create_map(F.lit("gini"), gini).alias("performance_summary"),
    )


def audit_trail(t: Tables) -> DataFrame:
    def model(number: Column) -> Column:
        return F.concat(F.lit("m_"), number.cast("string"))

    swap = F.concat(model(F.col("event_id") % 300), F.lit(" -> "), model(F.col("user_id") % 20))
    kind = F.col("event_type")
    return t["events"].select(
        F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("triggered_by"),
        F.when(kind == "purchase", F.concat(F.lit("Model Hot-Swap completed: "), swap))
        .when(kind == "signup", F.concat(F.lit("Automated Hot-Swap completed: "), swap))
        .otherwise(F.concat(F.lit("Traffic split updated: "), kind)).alias("action"),
        F.col("props").alias("evidence"), F.lit("system").alias("approved_by"),
    )


def semantic_metadata(t: Tables) -> DataFrame:
    """Catalogue rows made of parts."""
    size = F.col("p_size")
    return t["part"].select(
        F.concat(F.lit("meta_"), F.col("p_partkey").cast("string")).alias("meta_id"),
        F.col("p_brand").alias("table_name"), F.when(size % 11 != 0, F.col("p_name")).alias("column_name"),
        F.col("p_type").alias("data_type"), (size % 5 == 0).alias("is_primary_key"),
        (size % 3 == 0).alias("is_foreign_key"), F.when(size % 2 == 0, F.col("p_brand")).alias("referenced_table"),
        F.col("p_name").alias("business_definition"),
        F.when(size > 25, "PII").otherwise("Public").alias("data_sensitivity"))


def template_texts(t: Tables) -> DataFrame:
    """Template code built from part rows: with a list, with an empty list, and without one."""
    kind, word = F.lower("p_type"), F.element_at(F.split("p_name", " "), 1)
    listed = F.concat(F.lit('import x\nselected_columns = [\n "age", '), F.lit("'"), kind, F.lit("', "),
                      F.lit('"'), word, F.lit('", "age", # note\n]\ndf.select("other")'))
    empty = F.concat(F.lit('features = []\ndf.select("'), word, F.lit('", "loans", "x", '), F.lit("'col')"))
    bare = F.concat(F.lit('df.filter(col("'), kind, F.lit('") > 1).select("SparkSession", "'), word, F.lit('")'))
    key = F.col("p_partkey")
    return t["part"].select(
        key.alias("template_id"),
        F.when(key % 3 == 0, listed).when(key % 3 == 1, empty).otherwise(bare).alias("code"))


# ---- the same frames as SQL, by the name of the function above

SQL: dict[str, str] = {
    "demographics": """
SELECT c_custkey AS customer_id, CAST(18 + c_custkey * 7 % 68 AS INT) AS age, c_mktsegment AS segment,
  round(c_acctbal * 100) * 2 AS annual_income, CAST(300 + c_custkey * 37 % 551 AS INT) AS credit_score,
  n_name AS location, r_name AS region
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "credit_card_history": """
SELECT o_custkey AS customer_id, max(o_totalprice) AS credit_limit,
  round(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 12000.0) AS monthly_spend,
  CAST((count(*) FILTER (WHERE o_orderstatus = 'O') * 20000 + count(*)) // (count(*) * 2) AS DOUBLE) / 10000.0
    AS average_utilization
FROM orders GROUP BY o_custkey""",
    "loan_details": """
SELECT o_custkey AS customer_id,
  CAST(max(o_orderkey * 100000 + greatest(0, ship_day - date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))))
    % 100000 AS INT) AS payment_delay_days,
  CAST(count(*) FILTER (WHERE returned >= 3) AS INT) AS active_loans_count,
  round(CAST(sum(open_cents) AS DOUBLE) / 400.0) AS total_outstanding_loan,
  CAST((sum(tax) * 200 + sum(n)) // (sum(n) * 2) AS DOUBLE) / 10000.0 AS average_interest_rate,
  round(CAST(sum(cents) AS DOUBLE) / 4800.0) AS monthly_loan_emi,
  max(o_orderkey * 100000 + greatest(0, ship_day - date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))))
    % 100000 > 15 AS late_payment_flag
FROM (
  SELECT l_orderkey,
    max(l_linenumber * 100000 + date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) % 100000 AS ship_day,
    count(*) FILTER (WHERE l_returnflag = 'R') AS returned,
    sum(CASE WHEN l_linestatus = 'O' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS open_cents,
    sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, sum(CAST(round(l_tax * 100) AS BIGINT)) AS tax,
    count(*) AS n
  FROM lineitem GROUP BY l_orderkey) JOIN orders ON l_orderkey = o_orderkey
GROUP BY o_custkey""",
    "investment_profiles": """
SELECT user_id AS customer_id,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN c ELSE 0 END) AS DOUBLE) AS mutual_fund_holdings,
  CAST(sum(CASE WHEN event_type = 'view' THEN c ELSE 0 END) * 2 AS DOUBLE) AS equity_portfolio_value,
  CAST(sum(c) AS DOUBLE) AS fixed_deposit_balance,
  round(CAST(sum(CASE WHEN event_type = 'click' AND c > 10000 THEN c ELSE 0 END) AS DOUBLE) / 10.0)
    AS monthly_sip_amount,
  CASE count(*) % 4 WHEN 0 THEN 'Aggressive' WHEN 1 THEN 'Very Aggressive' WHEN 2 THEN 'Moderate'
    ELSE 'Conservative' END AS risk_profile
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events) GROUP BY user_id""",
    "predictions": """
SELECT event_id AS prediction_id, user_id AS customer_id,
  CAST(((least(CAST(round(value * 100) AS BIGINT), 20000) + 1) // 2) / 10000.0 AS DECIMAL(5,4)) AS propensity_score,
  CAST(CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN -1 ELSE 0 END AS INT) AS is_conversion_successful,
  ts AS timestamp FROM events""",
    "request_log": """
SELECT event_id AS log_id, ts AS timestamp, 'user_' || user_id AS username,
  CASE user_id % 3 WHEN 0 THEN 'analyst' WHEN 1 THEN 'admin' ELSE 'guest' END AS user_role,
  '/api/' || event_type AS endpoint,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
  CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS INT) AS status_code, value AS latency_ms,
  props AS payload_summary FROM events""",
    "profile": """
SELECT d.*, c.* EXCLUDE (customer_id), l.* EXCLUDE (customer_id), i.* EXCLUDE (customer_id)
FROM demographics d LEFT JOIN credit_card_history c USING (customer_id)
LEFT JOIN loan_details l USING (customer_id) LEFT JOIN investment_profiles i USING (customer_id)""",
    "with_outcomes": """
SELECT f.*, p.is_conversion_successful, p.timestamp
FROM profile f LEFT JOIN predictions p USING (customer_id)""",
    "delay_lines": """
SELECT greatest(0, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS payment_delay_days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "lines": """
SELECT *, CAST(3.5 AS DOUBLE) AS fixed,
  CASE WHEN l_returnflag <> 'R' THEN l_extendedprice + l_tax * 100000 END AS gross FROM lineitem""",
    "score_sides": """
SELECT *, CASE WHEN timestamp < TIMESTAMP '2024-01-16' THEN 'expected' ELSE 'actual' END AS side FROM predictions""",
    "registry_models": """
SELECT 'm_' || p_partkey AS model_id, p_partkey AS seq, p_type AS algorithm_type, p_brand AS version,
  CASE WHEN p_partkey = 0 THEN 'champion' WHEN p_partkey % 4 = 3 THEN 'migrated' ELSE 'challenger' END AS status,
  CASE WHEN p_size % 3 = 0 THEN 'Rule' ELSE 'ML' END AS model_category,
  CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS DOUBLE) / 100.0 + 0.5 END AS roc_auc,
  CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS DOUBLE) / 100.0 + 0.4 END AS pr_auc,
  CAST(p_partkey % 800 AS DOUBLE) / 10.0 AS latency FROM part""",
    "registry_rules": """
SELECT 'rule_' || s_suppkey AS model_id, s_name AS model_name,
  CASE WHEN s_suppkey % 2 = 0 THEN 'Acquisition' ELSE 'Risk Control' END AS category,
  CASE WHEN s_suppkey % 2 = 0 THEN 'annual_income' ELSE 'credit_score' END AS feature,
  CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) AS value, CAST(s_suppkey % 4 AS INT) AS n_conditions,
  CASE WHEN s_suppkey % 9 <> 0 THEN floor(s_acctbal) / 10000.0 END AS gini FROM supplier""",
    "audit_trail": """
SELECT event_id AS seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, 'user_' || user_id AS triggered_by,
  CASE event_type
    WHEN 'purchase' THEN 'Model Hot-Swap completed: m_' || event_id % 300 || ' -> m_' || user_id % 20
    WHEN 'signup' THEN 'Automated Hot-Swap completed: m_' || event_id % 300 || ' -> m_' || user_id % 20
    ELSE 'Traffic split updated: ' || event_type END AS action,
  event_type, event_id % 300 AS old_no, user_id % 20 AS new_no, props AS evidence, 'system' AS approved_by
FROM events""",
    "semantic_metadata": """
SELECT 'meta_' || p_partkey AS meta_id, p_brand AS table_name, CASE WHEN p_size % 11 <> 0 THEN p_name END AS column_name,
  p_type AS data_type, CASE WHEN p_size % 5 = 0 THEN 'Yes' ELSE 'No' END AS pk,
  CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN 'Yes (' || p_brand || ')' WHEN p_size % 3 = 0 THEN 'Yes' ELSE 'No' END
    AS fk, p_name AS business_definition, CASE WHEN p_size > 25 THEN 'PII' ELSE 'Public' END AS data_sensitivity
FROM part""",
    "template_texts": """
SELECT p_partkey AS template_id, CASE p_partkey % 3
  WHEN 0 THEN 'import x' || chr(10) || 'selected_columns = [' || chr(10) || ' "age", ''' || lower(p_type) || ''', "'
    || split_part(p_name, ' ', 1) || '", "age", # note' || chr(10) || ']' || chr(10) || 'df.select("other")'
  WHEN 1 THEN 'features = []' || chr(10) || 'df.select("' || split_part(p_name, ' ', 1)
    || '", "loans", "x", ''col'')'
  ELSE 'df.filter(col("' || lower(p_type) || '") > 1).select("SparkSession", "' || split_part(p_name, ' ', 1)
    || '")' END AS code FROM part""",
}
NEEDS = {
    "profile": ["demographics", "credit_card_history", "loan_details", "investment_profiles"],
    "with_outcomes": ["profile", "predictions"],
    "score_sides": ["predictions"],
}


def sql_with(names: list[str], body: str) -> str:
    """`body` behind the CTEs it names, and the ones those need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" + body.strip()


Query = Callable[[Tables], DataFrame]
