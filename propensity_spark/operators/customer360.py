"""Customer-360 assembly: the left-join star, the prediction-log fan-out and the projections over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensity_spark.functions.scalar import all_of, ratio

# The 15 model features; names and order are fixed values.
FEATURES = [
    "age", "annual_income", "credit_score", "credit_limit", "monthly_spend", "average_utilization",
    "payment_delay_days", "active_loans_count", "total_outstanding_loan", "average_interest_rate",
    "monthly_loan_emi", "mutual_fund_holdings", "equity_portfolio_value", "fixed_deposit_balance",
    "monthly_sip_amount",
]
PROFILE = ["segment", "late_payment_flag", "risk_profile"]


def fan_out(base: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """base LEFT JOIN log where one customer may own a large share of the log.

    In an outer join Spark can split a skewed partition only on the preserved side, and here the log is the other one.
    So the join is written as its two halves: an inner join, of which either side can be split, and the customers the
    log lacks, found from one row per customer of it. Nothing runs until the result does.
    """
    none = base.join(log.select(key).distinct(), key, "left_anti")
    return base.join(log, key).unionByName(none, allowMissingColumns=True)


def latest_per_key(log: DataFrame, key: str, time: str, tie_break: str) -> DataFrame:
    """The newest log row of each customer; a partial aggregate, so a hot customer is no hot task."""
    row = F.struct(*[c for c in log.columns if c != key])
    newest = log.groupBy(key).agg(F.max_by(row, F.struct(time, tie_break)).alias("_row"))
    return newest.select(key, "_row.*")


def customer_360(
    base: DataFrame,
    parts: list[DataFrame],
    key: str = "customer_id",
    log: DataFrame | None = None,
    latest: tuple[str, str] | None = None,
) -> DataFrame:
    """base LEFT JOIN each 1:1 part, then LEFT JOIN the 1:N log.

    With `latest` = (time column, unique column) only the newest log row per customer is kept.
    """
    out = base
    for part in parts:
        out = out.join(part, key, "left")
    if log is None:
        return out
    if latest:
        return out.join(latest_per_key(log, key, *latest), key, "left")
    return fan_out(out, log, key)


def star_join(base: DataFrame, parts: list[DataFrame], key: str = "customer_id") -> DataFrame:
    """base INNER JOIN each part."""
    out = base
    for part in parts:
        out = out.join(part, key)
    return out


def as_features(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Cast the features present in df to double; text that is no number becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in features if c in df.columns})


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one customer; the predicate reaches the scan."""
    return df.filter(F.col(key) == F.lit(value))


# ---- cohorts

def cohort_predicates(
    minimum: dict[str, float | None] | None = None,
    maximum: dict[str, float | None] | None = None,
    equals: dict[str, str | None] | None = None,
    time: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> list[Column]:
    """Optional conjunctive predicates. None is skipped, and so is 'All' in `equals`."""
    out = [F.col(c) >= F.lit(v) for c, v in (minimum or {}).items() if v is not None]
    out += [F.col(c) <= F.lit(v) for c, v in (maximum or {}).items() if v is not None]
    out += [F.col(c) == F.lit(v) for c, v in (equals or {}).items() if v not in (None, "All")]
    if time and start:
        out.append(F.col(time) >= F.lit(start).cast("timestamp_ntz"))
    if time and end:
        out.append(F.col(time) <= F.lit(end).cast("timestamp_ntz"))
    return out


def cohort_filter(df: DataFrame, **limits) -> DataFrame:
    return df.filter(all_of(cohort_predicates(**limits)))


def cohort_count(df: DataFrame, key: str = "customer_id", **limits) -> DataFrame:
    """Size of a cohort in joined rows, and in distinct customers."""
    return cohort_filter(df, **limits).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_customers")
    )


#: What a cohort request may ask for: its name, the column it limits, and the value at which it limits nothing.
REQUEST_MINIMUM = {"age_min": ("age", None), "income_min": ("annual_income", 0), "credit_score_min": ("credit_score", 300)}
REQUEST_MAXIMUM = {"age_max": ("age", None)}
REQUEST_EQUALS = {"gender": "gender"}


def cohort_limits(request: dict) -> dict[str, dict]:
    """A cohort request as the limits of cohort_predicates(). Ages limit only as a pair; floors only above theirs."""
    ages = "age_min" in request and "age_max" in request

    def wanted(names: dict) -> dict:
        return {column: request[name] for name, (column, floor) in names.items()
                if request.get(name) is not None and (ages if column == "age" else request[name] > floor)}

    return {"minimum": wanted(REQUEST_MINIMUM), "maximum": wanted(REQUEST_MAXIMUM),
            "equals": {column: request.get(name) for name, column in REQUEST_EQUALS.items()}}


def semi_joined(frames: list[DataFrame], keys: DataFrame, key: str = "customer_id") -> list[DataFrame]:
    """Each frame reduced to some keys; Spark takes a small key frame below the frame's own grouping by the key."""
    return [f.join(keys.select(key), key, "left_semi") for f in frames]


# ---- projections

def delinquency_ratios(df: DataFrame, income: str = "annual_income") -> DataFrame:
    """Spend and debt burden as yearly shares of income; NULL when income is 0."""
    return df.withColumns({
        "spend_to_income_ratio": ratio(F.col("monthly_spend") * 12.0, F.col(income)),
        "debt_burden_ratio": ratio(F.col("monthly_loan_emi") * 12.0, F.col(income)),
    })


def select_features(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    return df.select(*features)


def engineered_features(df: DataFrame, income_min: float = 1000000.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Filter, treat missing delay and loan count as 0, derive portfolio value and debt-to-income, project.

    A NULL holding makes the portfolio value NULL.
    """
    income = F.col("annual_income")
    wanted = df.filter(
        F.col("age").between(18, 85) & (income >= income_min) & (F.col("credit_score") >= 300)
    )
    return wanted.select(
        *keep, "age", "annual_income", "credit_score", "credit_limit", "average_utilization",
        F.coalesce("payment_delay_days", F.lit(0)).alias("payment_delay_days"),
        (F.col("mutual_fund_holdings") + F.col("equity_portfolio_value") + F.col("fixed_deposit_balance"))
        .alias("total_investment_value"),
        (F.col("monthly_loan_emi") * 12 / F.when(income > 0, income).otherwise(1.0))
        .alias("debt_to_income_ratio"),
        "monthly_sip_amount",
    )
