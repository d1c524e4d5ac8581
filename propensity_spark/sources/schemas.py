"""Declared schemas. Tables are never read with inference."""

from __future__ import annotations

# Names, order and types are fixed values.
BANK_TABLES = {
    "demographics": """customer_id string, age int, gender string, annual_income decimal(15,2),
        employment_type string, credit_score int, location string, marital_status string,
        education_level string, home_ownership string, years_at_current_job int, active_bank_accounts int,
        monthly_rent_mortgage decimal(15,2), total_assets decimal(15,2), primary_branch_code string""",
    "credit_card_history": """customer_id string, card_type string, credit_limit decimal(15,2),
        monthly_spend decimal(15,2), average_utilization decimal(5,4), payment_delay_days int,
        cash_withdrawals_count int, rewards_points_balance int, active_cards_count int,
        annual_fees_paid decimal(15,2), credit_inquiries_last_6m int, credit_history_months int,
        late_payment_flag boolean, international_spend_ratio decimal(5,4), cashback_earned_ytd decimal(15,2)""",
    "loan_details": """customer_id string, active_loans_count int, personal_loan_balance decimal(15,2),
        home_loan_balance decimal(15,2), auto_loan_balance decimal(15,2), total_outstanding_loan decimal(15,2),
        average_interest_rate decimal(5,4), monthly_loan_emi decimal(15,2), loan_defaults_count int,
        tenure_remaining_months int, co_signer_present boolean, collateral_value decimal(15,2),
        loan_application_status string, loan_to_income_ratio decimal(5,4), repayment_mode string""",
    "investment_profiles": """customer_id string, mutual_fund_holdings decimal(15,2),
        equity_portfolio_value decimal(15,2), fixed_deposit_balance decimal(15,2),
        monthly_sip_amount decimal(15,2), risk_profile string, investment_duration_years int,
        primary_broker_code string, tax_saving_investments decimal(15,2),
        retirement_fund_balance decimal(15,2), gold_investment_value decimal(15,2),
        dividend_yield_annual decimal(5,4), automated_reinvest_flag boolean, last_trade_date timestamp_ntz,
        advisor_referred_flag boolean""",
    "predictions": """prediction_id string, customer_id string, model_id string, target_product_type string,
        propensity_score decimal(5,4), predicted_label int, explanation_coeff_1 decimal(20,6),
        explanation_coeff_2 decimal(20,6), explanation_coeff_3 decimal(20,6), is_conversion_successful int,
        timestamp timestamp_ntz, latency_ms decimal(10,2), fairness_adverse_impact_ratio decimal(5,4),
        drift_flag boolean, audit_trail_reference string""",
    "semantic_metadata": """meta_id string, table_name string, column_name string, data_type string,
        is_primary_key boolean, is_foreign_key boolean, referenced_table string, referenced_column string,
        business_definition string, semantic_category string, is_null boolean, default_value string,
        data_sensitivity string, source_system string, validation_rules string""",
    "api_audit_logs": """log_id bigint, timestamp timestamp_ntz, username string, user_role string,
        endpoint string, method string, status_code int, latency_ms decimal(10,2), payload_summary string,
        client_ip string""",
}

RULE_CONFIG = "struct<logic:string,conditions:array<struct<feature:string,operator:string,value:string>>>"

REGISTRY = f"""
    settings struct<failover_mode:string,drift_threshold_psi:double,performance_threshold_auc:double>,
    active_routing struct<champion_id:string>,
    traffic_split struct<mode:string,champion_ratio:double,challenger_ratio:double,selected_challenger_id:string>,
    models map<string,struct<model_id:string,algorithm_type:string,version:string,status:string,
        model_category:string,serving_path:string,created_at:string,hyperparameters:map<string,string>,
        baselines:map<string,double>,live_metrics:map<string,double>>>,
    rule_models map<string,struct<model_id:string,model_name:string,category:string,status:string,
        target_product:string,rule_config:{RULE_CONFIG},performance_summary:map<string,string>>>,
    audit_log array<struct<timestamp:string,triggered_by:string,action:string,evidence:string,
        approved_by:string>>"""

DRIVER_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}
