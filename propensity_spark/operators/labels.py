"""Campaign targets, event-tagging overrides, splits and sampled cohorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensity_spark.functions.scalar import as_int, hash_bucket, hash_order, is_true

# Campaign spellings per family (fixed values).
CAMPAIGNS = {
    "card": ["credit_card", "credit_card_propensity"],
    "funds": ["mutual_funds", "mutual_funds_propensity", "mutual_fund_propensity_model", "mutual_funds/investments"],
    "loans": ["loans", "loans_propensity", "loans_propensity_model"],
    "defaulter": ["defaulter", "card_defaulter", "card_payment_defaulter", "card_payment_defaulter_model"],
    "aggressiveness": ["investment_aggressiveness", "investment_aggressiveness_model"],
    "next_best_action": ["next_best_action", "next_best_action_model"],
}


def campaign_family(campaign: str) -> str:
    for family, names in CAMPAIGNS.items():
        if campaign.lower() in names:
            return family
    raise ValueError(f"Invalid campaign: {campaign}")


def campaign_target(campaign: str) -> Column:
    """0/1 target of a campaign; NULL inputs count as 0."""
    family = campaign_family(campaign)
    if family in ("card", "next_best_action"):
        return as_int(F.col("is_conversion_successful") == 1)
    if family == "funds":
        return as_int(F.col("monthly_sip_amount") > 0)
    if family == "loans":
        return as_int(F.col("active_loans_count") > 0)
    if family == "defaulter":
        return as_int(F.col("late_payment_flag"))
    return as_int(F.lower("risk_profile") == "aggressive")


def campaign_labels(df: DataFrame, campaign: str, label: str = "label") -> DataFrame:
    return df.withColumn(label, campaign_target(campaign))


def event_tags(
    df: DataFrame,
    label: str = "label",
    auto_cure_max_dpd: int | None = None,
    roll_forward_min_dpd: int | None = None,
    money_collected_min: float | None = None,
) -> DataFrame:
    """Override labels by events. Cure is applied first, then roll-forward, then money collected; later wins.

    An override whose limit is None is off.
    """
    delay = F.coalesce(F.col("payment_delay_days"), F.lit(0))
    out = F.col(label)
    if auto_cure_max_dpd is not None:
        cured = (delay <= auto_cure_max_dpd) & ~is_true(F.col("late_payment_flag"))
        out = F.when(cured, 0).otherwise(out)
    if roll_forward_min_dpd is not None:
        out = F.when(delay >= roll_forward_min_dpd, 1).otherwise(out)
    if money_collected_min is not None:
        spend = F.coalesce(F.col("monthly_spend"), F.lit(0.0))
        emi = F.coalesce(F.col("monthly_loan_emi"), F.lit(0.0))
        out = F.when((spend >= money_collected_min) | (emi >= money_collected_min), 1).otherwise(out)
    return df.withColumn(label, out)


def labelled_only(df: DataFrame, label: str) -> DataFrame:
    """Rows with a known outcome; pending (-1) and missing ones are left out."""
    return df.filter(F.col(label).isin(0, 1))


def hash_split(df: DataFrame, key: str, train_ratio: float, seed: int = 42) -> DataFrame:
    """Add `part` = train / test by a hash of the key, so the split is the same under any partitioning."""
    limit = round(train_ratio * 10000)
    return df.withColumn("part", F.when(hash_bucket(F.col(key), seed) < limit, "train").otherwise("test"))


DIGEST_RANGES = 65536


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first n rows in the order of a hash of the key: a repeatable random cohort.

    The rows are counted per leading digits of the hash; whole ranges are kept up to the one that holds the n-th row,
    and only that one, a 65536th of the rows, is ordered. So no task gets the sample, whatever its size.
    """
    order = hash_order(F.col(key), seed)
    leading = F.conv(F.substring(order, 1, 4), 16, 10).cast("int")
    counts = df.groupBy(leading.alias("r")).count().collect()  # at most DIGEST_RANGES rows
    sizes = {r["r"]: r["count"] for r in counts}
    taken = 0
    for last in range(DIGEST_RANGES):
        here = sizes.get(last, 0)
        if taken + here >= n:
            edge = df.filter(leading == last).orderBy(order, key).limit(n - taken)
            return edge if not taken else df.filter(leading < last).unionByName(edge)
        taken += here
    return df


def in_sample(keys: DataFrame, key: str, n: int, seeds: tuple[int, ...]) -> list[Column]:
    """For every seed the condition that a row's key is in hash_sample(keys, key, n, seed); keys are distinct.

    One count over all seeds finds the range that holds the n-th key, and one ordered look into these ranges that key;
    after that membership is a comparison with it, and rows need no join.
    """
    orders = {seed: hash_order(F.col(key), seed) for seed in seeds}
    leading = {s: F.conv(F.substring(o, 1, 4), 16, 10).cast("int") for s, o in orders.items()}
    each = F.array(*[F.struct(F.lit(s).alias("seed"), r.alias("r")) for s, r in leading.items()])
    sizes: dict[int, dict[int, int]] = {s: {} for s in seeds}
    for r in keys.select(F.inline(each)).groupBy("seed", "r").count().collect():  # at most DIGEST_RANGES a seed
        sizes[r["seed"]][r["r"]] = r["count"]
    edges = []
    for seed in seeds:
        taken = 0
        for last, here in sorted(sizes[seed].items()):
            if taken + here >= n > 0:
                found = keys.where(leading[seed] == last).orderBy(orders[seed], key).offset(n - taken - 1).limit(1)
                edges.append(found.select(F.lit(seed).alias("seed"), orders[seed].alias("digest"), F.col(key).alias("key")))
                break
            taken += here
    limits = {r["seed"]: r for r in reduce(DataFrame.unionByName, edges).collect()} if edges else {}
    out = []
    for seed, order in orders.items():
        if n <= 0 or seed not in limits:
            out.append(F.lit(n > 0))  # nobody, or fewer than n
            continue
        digest, last = F.lit(limits[seed]["digest"]), F.lit(limits[seed]["key"])
        out.append((order < digest) | ((order == digest) & (F.col(key) <= last)))
    return out
