"""Derived features: product affinities, rule-of-thumb propensity, annuity, ratios, stress transform."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensity_spark.functions.scalar import is_true, ratio
from propensity_spark.operators.labels import in_sample


def _or(name: str, default: float) -> Column:
    """A number with NULL and 0 replaced."""
    col = F.col(name).cast("double")
    return F.when(col.isNull() | (col == 0), F.lit(default)).otherwise(col)


def affinity(df: DataFrame) -> DataFrame:
    """Add card, fund and loan affinity and the product with the highest one (the first on ties)."""
    income = _or("annual_income", 1.0)
    income = F.when(income <= 0, F.lit(1.0)).otherwise(income)
    card = _or("monthly_spend", 0.0) * 12.0 / income * (1.0 - _or("average_utilization", 0.0))
    fund = _or("fixed_deposit_balance", 0.0) / income
    loan = _or("credit_score", 300.0) / 850.0 / (_or("active_loans_count", 0.0) + 1.0) * 0.3
    raw = df.withColumns({"_card": card, "_fund": fund, "_loan": loan})
    best = F.greatest("_card", "_fund", "_loan")
    product = (
        F.when(F.col("_card") == best, "Credit Cards").when(F.col("_fund") == best, "Mutual Funds")
        .otherwise("Retail Loans")
    )
    return raw.select(
        *df.columns,
        F.round("_card", 4).alias("card_affinity"), F.round("_fund", 4).alias("fund_affinity"),
        F.round("_loan", 4).alias("loan_affinity"), product.alias("recommended_product"),
    )


def rule_of_thumb(df: DataFrame) -> DataFrame:
    """Add a propensity from three fixed bonuses, and its label at 0.55."""
    score, income, age = F.col("credit_score"), F.col("annual_income"), F.col("age")
    raw = (
        F.lit(0.15)
        + F.when(score > 700, 0.3).otherwise(0.0)
        + F.when(income > 1000000, 0.2).otherwise(0.0)
        + F.when(age.between(25, 45), 0.15).otherwise(0.0)
    )
    out = df.withColumn("propensity", F.round(F.least(F.greatest(raw, F.lit(0.01)), F.lit(0.99)), 4))
    return out.withColumn("predicted_label", (F.col("propensity") >= 0.55).cast("int"))


def annuity(principal: Column, yearly_rate: Column, months: int = 60, floor: float = 1500.0) -> Column:
    """Monthly payment of a loan, at least `floor`; 0 without a loan. Without interest it is the floor."""
    r = yearly_rate / 12
    paid = F.round(F.try_divide(principal * r, 1 - F.pow(1 + r, F.lit(-months))), 2)
    paid = F.when(yearly_rate > 0, paid).otherwise(F.lit(0.0))
    return F.when(principal > 0, F.greatest(paid, F.lit(floor))).otherwise(F.lit(0.0))


def loan_ratios(df: DataFrame, balances: list[str]) -> DataFrame:
    """Add total outstanding, loan-to-income, yearly cashback and the late flag."""
    total = sum((F.col(b) for b in balances[1:]), F.col(balances[0]))
    income = F.col("annual_income")
    return df.withColumn("total_outstanding", total).withColumns({
        "loan_to_income_ratio": F.round(
            F.when(income > 0, ratio(F.col("total_outstanding"), income)).otherwise(0.0), 4),
        "cashback_earned": F.col("monthly_spend") * 0.015 * 12,
        "late_flag": is_true(F.col("payment_delay_days") > 15),
    })


@dataclass(frozen=True)
class Stress:
    """Shift of credit score and delay, factor on utilisation and the most it may become (None: no limit)."""

    score: int
    utilization: float
    delay: int
    most: float | None = None


# Fixed values.
WORSE = Stress(score=-110, utilization=1.35, delay=15, most=1.0)
BETTER = Stress(score=110, utilization=1 / 1.35, delay=-15)


def stress(
    df: DataFrame, spec: Stress = WORSE, n: int = 4000, key: str = "customer_id", seeds: tuple[int, int] = (1, 2)
) -> DataFrame:
    """A stressed copy of df: score shifted for one sample of n keys, utilisation and delay for another.

    What is missing stays missing. df is read for the samples and for the result, so it should be a stored table.
    """
    scored, carded = in_sample(df.select(key).distinct(), key, n, seeds)
    score = F.least(F.greatest(F.col("credit_score") + spec.score, F.lit(300)), F.lit(850))
    usage = F.col("average_utilization") * spec.utilization
    usage = usage if spec.most is None else F.least(usage, F.lit(spec.most))
    delay = F.greatest(F.col("payment_delay_days") + spec.delay, F.lit(0))
    return df.withColumns({
        "credit_score": F.when(scored & F.col("credit_score").isNotNull(), score)
        .otherwise(F.col("credit_score")),
        "average_utilization": F.when(carded & F.col("average_utilization").isNotNull(), usage)
        .otherwise(F.col("average_utilization")),
        "payment_delay_days": F.when(carded & F.col("payment_delay_days").isNotNull(), delay)
        .otherwise(F.col("payment_delay_days")),
    })


def cohort_by_keys(df: DataFrame, keys: DataFrame, key: str = "customer_id") -> DataFrame:
    """Rows of df whose key is in a sampled key set."""
    return df.join(keys.select(key), key, "left_semi")
