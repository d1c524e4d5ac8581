import datetime as dt

import pytest
from pyspark.sql import functions as F

from propensity_spark.operators import customer360 as c
from propensity_spark.operators import leads, search
from propensity_spark.operators.templates import cohort_clause, template_features, template_preview, template_query
from tests.conftest import rows

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def base(frame):
    return frame([("a", 30, 1000.0, "Male"), ("b", 40, 0.0, "Female"), ("c", 50, None, None)],
                 "customer_id string, age int, annual_income double, gender string")


@pytest.fixture(scope="module")
def log(frame):
    data = [(i, "a" if i % 3 else "b", i / 100, DAY + dt.timedelta(days=i)) for i in range(30)] + [(99, "z", 0.5, DAY)]
    return frame(data, "prediction_id long, customer_id string, score double, timestamp timestamp_ntz")


def test_customer_without_history_keeps_a_row_of_nulls(base, frame):
    cards = frame([("a", 5.0)], "customer_id string, spend double")
    out = {r["customer_id"]: r["spend"] for r in c.customer_360(base, [cards]).collect()}
    assert out == {"a": 5.0, "b": None, "c": None}


def test_fan_out_is_a_left_join_and_runs_nothing(base, log, spark):
    want = sorted(rows(base.join(log, "customer_id", "left")), key=str)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    out = c.fan_out(base, log, "customer_id")
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert sorted(rows(out), key=str) == want
    assert out.columns == base.join(log, "customer_id", "left").columns


def test_latest_keeps_one_row_per_customer(base, log):
    out = c.customer_360(base, [], log=log, latest=("timestamp", "prediction_id")).collect()
    assert {r["customer_id"]: r["prediction_id"] for r in out} == {"a": 29, "b": 27, "c": None}


def test_cohort_skips_absent_limits(base):
    assert c.cohort_filter(base).count() == 3
    assert c.cohort_filter(base, minimum={"age": None}, equals={"gender": "All"}).count() == 3
    assert c.cohort_filter(base, minimum={"age": 35}, maximum={"age": 45}).count() == 1
    assert c.cohort_filter(base, minimum={"annual_income": 0.0}).count() == 2  # NULL income is out


def test_time_limit_makes_the_outer_join_inner(base, log):
    out = c.cohort_filter(c.customer_360(base, [], log=log), time="timestamp", start="2024-01-05", end="2024-01-06")
    assert sorted(r["prediction_id"] for r in out.collect()) == [4, 5]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "Inner" in plan


def test_cohort_count_counts_joined_rows(base, log):
    row = c.cohort_count(c.customer_360(base, [], log=log)).first()
    assert (row["n_rows"], row["n_customers"]) == (31, 3)


def test_key_lookup_reaches_the_scan(base, tmp_path, spark):
    base.write.parquet(str(tmp_path / "base"))
    out = c.lookup(spark.read.parquet(str(tmp_path / "base")), "customer_id", "a")
    assert out.count() == 1
    assert "EqualTo(customer_id,a)" in out._jdf.queryExecution().executedPlan().toString()
    assert c.lookup(base, "customer_id", "nobody").count() == 0


def test_ratio_of_zero_income_is_null(frame):
    df = frame([(100.0, 50.0, 0.0), (100.0, 50.0, 1200.0)], "monthly_spend double, monthly_loan_emi double, annual_income double")
    out = rows(c.delinquency_ratios(df).select("spend_to_income_ratio", "debt_burden_ratio"))
    assert out == [(None, None), (1.0, 0.5)]


def test_engineered_features_keep_null_in_a_sum(frame):
    cols = ["age int", "annual_income double", "credit_score int", "credit_limit double", "average_utilization double",
            "payment_delay_days int", "active_loans_count int", "mutual_fund_holdings double",
            "equity_portfolio_value double", "fixed_deposit_balance double", "monthly_loan_emi double",
            "monthly_sip_amount double"]
    df = frame([(30, 2e6, 700, 1.0, 0.1, None, None, 1.0, 2.0, 3.0, 100.0, 0.0),
                (30, 2e6, 700, 1.0, 0.1, 4, 1, 1.0, None, 3.0, 100.0, 0.0),
                (90, 2e6, 700, 1.0, 0.1, 4, 1, 1.0, 2.0, 3.0, 100.0, 0.0)], ", ".join(cols))
    out = c.engineered_features(df).collect()
    assert [(r["payment_delay_days"], r["total_investment_value"]) for r in out] == [(0, 6.0), (4, None)]
    assert out[0]["debt_to_income_ratio"] == 100.0 * 12 / 2e6


def test_features_become_double_and_bad_text_null(frame):
    df = c.as_features(frame([("12",), ("x",)], "age string"))
    assert rows(df) == [(12.0,), (None,)]


# ---- templates

def test_template_text_and_bound_values():
    text, args = cohort_clause({"age_min": 21, "age_max": 65, "income_min": 25000, "credit_score_min": 600})
    assert text == ("d.age >= :minimum_age AND d.annual_income >= :minimum_annual_income AND "
                    "d.credit_score >= :minimum_credit_score AND d.age <= :maximum_age")
    assert args == {"minimum_age": 21, "maximum_age": 65, "minimum_annual_income": 25000, "minimum_credit_score": 600}
    assert cohort_clause({"age_min": 21, "income_min": 0, "credit_score_min": 300, "gender": "All"}) == ("TRUE", {})
    assert cohort_clause({"income_min": None, "gender": None}) == ("TRUE", {})


def test_template_leaves_views_of_the_session_alone(spark, base):
    spark.range(3).createOrReplaceTempView("people")
    out = template_query(spark, "WITH x AS (SELECT * FROM people) SELECT d.customer_id FROM x d WHERE {{COHORT_FILTERS}}",
                         {}, people=base)
    assert out.count() == base.count() and spark.table("people").count() == 3
    spark.catalog.dropTempView("people")
    look = template_preview(spark, "SELECT d.age FROM people d WHERE {{COHORT_FILTERS}};", {"gender": "Male"},
                            with_count=True, people=base)
    assert look["sql"] == "SELECT d.age FROM people d WHERE d.gender = :equals_gender;" and look["columns"] == ["age"]
    assert look["values"] == {"equals_gender": "Male"} and look["total"] == look["rows"].count() == 1


def test_template_value_is_no_sql(spark, base):
    sql = "SELECT d.customer_id, d.age FROM people d WHERE {{COHORT_FILTERS}}"
    assert template_query(spark, sql, {"gender": "x' OR '1'='1"}, people=base).count() == 0
    out = template_query(spark, sql, {"gender": "Male"}, ["age"], people=base)
    assert rows(out) == [(30,)]


def test_template_feature_names(frame):
    texts = ['selected_columns = [\n "age", \'income\', "age", # "x"\n]\nselect("late")', 'features=[] \nf("b1", "x", "loans")',
             "SELECTED_FEATURES = ['only']", "nothing quoted"]
    out = template_features(frame([(t,) for t in texts], "code string"))
    assert [r["features"] for r in out.collect()] == [["age", "income", "x"], ["b1"], ["only"], []]


# ---- search, paging, leads

def test_search_any_handles_null_and_every_type(frame):
    df = frame([(1, None, 12.5, DAY), (2, "Blue", None, DAY), (3, "red", 7.0, DAY)], "id int, t string, v double, d timestamp_ntz")
    assert [r["id"] for r in search.search_any(df, "BLU").collect()] == [2]
    assert [r["id"] for r in search.search_any(df, "12.50").collect()] == [1]
    assert search.search_any(df, "2024-01-01").count() == 3
    assert search.search_any(df, "").count() == 3
    assert search.search_any(df, "2", ["t"]).count() == 0


def test_page_orders_nulls_as_the_reference_database(frame):
    df = frame([(1, 5), (2, None), (3, 1), (4, 5)], "id int, v int")
    assert [r["id"] for r in search.page(df, [("v", False)], "id").collect()] == [3, 1, 4, 2]
    assert [r["id"] for r in search.page(df, [("v", True)], "id").collect()] == [2, 1, 4, 3]
    assert [r["id"] for r in search.page(df, [("v", False)], "id", 2, 3).collect()] == [2]
    assert search.page(df, [("v", False)], "id", 9, 3).count() == 0
    with pytest.raises(ValueError):
        search.page(df, [("v; DROP TABLE x", False)], "id")


def test_page_after_continues_a_page(frame):
    df = frame([(i, i % 3) for i in range(20)], "id int, v int")
    first = search.page(df, [("v", False)], "id", 1, 6).collect()
    after = search.page_after(df, "v", "id", (first[-1]["v"], first[-1]["id"]), 6).collect()
    assert after == search.page(df, [("v", False)], "id", 2, 6).collect()


def test_telemetry_of_an_empty_log(frame):
    log = frame([], "status_code int, latency_ms double")
    assert rows(search.telemetry(log)) == [(0, 0.0, 0.0)]


def test_catalogue(spark, base):
    out = search.catalog({"people": base})
    assert [r["column_name"] for r in out.collect()] == ["age", "annual_income", "customer_id", "gender"]
    schema = ("meta_id string, table_name string, column_name string, is_primary_key boolean, is_foreign_key boolean, "
              "referenced_table string, business_definition string")
    meta = spark.createDataFrame([("1", "cards", "customer_id", None, True, "people", "owner"),
                                  ("2", "people", "customer_id", True, False, None, "key")], schema)
    got = {r["meta_id"]: (r["pk"], r["fk"]) for r in search.search_catalog(meta).collect()}
    assert got == {"1": ("No", "Yes (people)"), "2": ("Yes", "No")}
    assert [r["meta_id"] for r in search.search_catalog(meta, "yes (PEOPLE").collect()] == ["1"]
    assert [r["meta_id"] for r in search.search_catalog(meta, sort="table_name", descending=True).collect()] == ["2", "1"]


def test_leads_default_order_and_whitelist(frame):
    base = frame([(i, 900000.0, 700 + i) for i in range(5)], "customer_id int, annual_income double, credit_score int")
    cards = frame([(i, 1.0, 2.0, 0.5, 0 if i != 4 else 3) for i in range(5)],
                  "customer_id int, credit_limit double, monthly_spend double, average_utilization double, payment_delay_days int")
    log = frame([(1, 2, "0.9"), (2, 2, "0.4")], "prediction_id int, customer_id int, s string").select(
        "prediction_id", "customer_id", F.col("s").cast("decimal(5,4)").alias("propensity_score"))
    out = leads.strong_leads(base, [cards], "credit_card_history", log)
    got = [(r["customer_id"], float(r["propensity_score"])) for r in leads.lead_page(out, "credit_card_history").collect()]
    assert got == [(2, 0.9), (2, 0.4), (3, 0.0), (1, 0.0)]
    found = leads.strong_leads(base, [cards], "credit_card_history", log, search="90.0")
    assert [r["prediction_id"] for r in found.collect()] == [1]
    with pytest.raises(ValueError):
        leads.strong_leads(base, [cards], "users")
    assert [r["customer_id"] for r in leads.top_leads(base, "credit_score", n=2).collect()] == [4, 3]
