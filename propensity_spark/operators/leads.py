"""Strong-lead lists per product, with search, sort and paging."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensity_spark.functions.scalar import any_of, contains_text, is_true, money_text
from propensity_spark.operators.customer360 import fan_out, star_join
from propensity_spark.operators.search import check_allowed, page


@dataclass(frozen=True)
class LeadProduct:
    """What makes a strong lead for a product and how its list is shown."""

    columns: tuple[str, ...]
    predicate: Column
    default_sort: tuple[tuple[str, bool], ...]
    money: tuple[str, ...]
    text: tuple[str, ...]
    uses_log: bool = False


def lead_products() -> dict[str, LeadProduct]:
    """Products and their limits (fixed values)."""
    c = F.col
    return {
        "credit_card_history": LeadProduct(
            ("customer_id", "annual_income", "credit_score", "credit_limit", "monthly_spend",
             "average_utilization", "propensity_score"),
            (c("credit_score") > 700) & (c("annual_income") > 800000) & (c("payment_delay_days") == 0),
            (("propensity_score", True), ("credit_score", True)),
            ("annual_income", "credit_limit", "monthly_spend"),
            ("customer_id", "credit_score", "average_utilization"),
            uses_log=True,
        ),
        "investment_profiles": LeadProduct(
            ("customer_id", "annual_income", "credit_score", "fixed_deposit_balance", "equity_portfolio_value",
             "monthly_sip_amount", "risk_profile"),
            (c("annual_income") > 1000000) & (c("fixed_deposit_balance") > 100000),
            (("fixed_deposit_balance", True), ("annual_income", True)),
            ("annual_income", "fixed_deposit_balance", "equity_portfolio_value", "monthly_sip_amount"),
            ("customer_id", "credit_score", "risk_profile"),
        ),
        "loan_details": LeadProduct(
            ("customer_id", "annual_income", "credit_score", "active_loans_count", "total_outstanding_loan",
             "monthly_loan_emi"),
            (c("credit_score") > 720) & (c("total_outstanding_loan") < 300000),
            (("credit_score", True), ("annual_income", True)),
            ("annual_income", "total_outstanding_loan", "monthly_loan_emi"),
            ("customer_id", "credit_score", "active_loans_count"),
        ),
    }


def strong_leads(
    base: DataFrame, details: list[DataFrame], product: str, log: DataFrame | None = None, search: str = "",
    log_key: str = "prediction_id",
) -> DataFrame:
    """All strong leads of a product. With a log a customer appears once per prediction."""
    spec = lead_products()[check_allowed(product, lead_products())]
    leads = star_join(base, details).filter(spec.predicate)
    if spec.uses_log:
        leads = fan_out(leads, log.select("customer_id", log_key, "propensity_score"), "customer_id")
        leads = leads.withColumn("propensity_score", F.coalesce(F.col("propensity_score"), F.lit(0.0).cast(
            "decimal(5,4)")))
    if search:
        shown = [money_text(F.col(m)) for m in spec.money] + [F.col(t).cast("string") for t in spec.text]
        if spec.uses_log:
            shown.append((F.col("propensity_score") * 100).cast("string"))
        leads = leads.filter(any_of([is_true(contains_text(s, search)) for s in shown]))
    return leads.select(*spec.columns, *([log_key] if spec.uses_log else []))


def lead_page(
    leads: DataFrame, product: str, sort: str | None = None, descending: bool = False, number: int = 1,
    size: int = 100, log_key: str = "prediction_id",
) -> DataFrame:
    """One page of a lead list, by a chosen column or the product's default order."""
    spec = lead_products()[product]
    order = [(sort, descending)] if sort in spec.columns else list(spec.default_sort)
    if spec.uses_log:
        order.append(("customer_id", False))
        return page(leads, order, log_key, number, size)
    return page(leads, order, "customer_id", number, size)


def lead_count(leads: DataFrame) -> DataFrame:
    return leads.agg(F.count(F.lit(1)).alias("total"))


def top_leads(scored: DataFrame, score: str, key: str = "customer_id", n: int = 100) -> DataFrame:
    """The n rows with the highest score."""
    return scored.orderBy(F.col(score).desc_nulls_last(), F.col(key)).limit(n)
