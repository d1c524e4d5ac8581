"""Evaluation, fairness, drift and failover queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensity_spark.functions.scalar import linspace
from propensity_spark.functions.session import scratch_path
from propensity_spark.operators import drift as dr
from propensity_spark.operators import history as hi
from propensity_spark.operators import metrics as me
from propensity_spark.operators.customer360 import star_join
from propensity_spark.operators.features import stress as stress_frame
from propensity_spark.plans import bindings as b
from propensity_spark.plans.registry import query
from propensity_spark.plans.rule_queries import STRESS_SQL
from propensity_spark.sources.readers import Tables, stored

# ---- evaluation

LABEL, SCORE = "is_conversion_successful", "propensity_score"


def _metrics_sql(source: str, label: str, score: str, by: str = "") -> str:
    """CTE body for all metrics of one label / score pair, per group `by`."""
    part, lead = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {lead}CAST(p + n AS BIGINT) AS n_labelled, round(coalesce(wins / nullif(p * n, 0), 0.5), 4) AS roc_auc,
  round(coalesce(ap / nullif(p, 0), 0.0), 4) AS pr_auc,
  round(coalesce(2 * tp / nullif(tp + fp + p, 0), 0.0), 4) AS f1_score, round(loss / (p + n), 4) AS log_loss,
  round(coalesce(ks, 0.0), 4) AS ks_statistic,
  round(2 * round(coalesce(wins / nullif(p * n, 0), 0.5), 4) - 1, 4) AS gini
FROM (
  SELECT {lead}CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(neg) AS DOUBLE) AS n, sum(pos * (cn - neg / 2.0)) AS wins,
    sum(pos * (ap - cp + pos) / (ap - cp + pos + an - cn + neg)) AS ap,
    CAST(sum(CASE WHEN s >= 0.55 THEN pos ELSE 0 END) AS DOUBLE) AS tp,
    CAST(sum(CASE WHEN s >= 0.55 THEN neg ELSE 0 END) AS DOUBLE) AS fp,
    sum(-(pos * ln(greatest(least(s, 1 - 2.220446049250313e-16), 2.220446049250313e-16))
      + neg * ln(1 - greatest(least(s, 1 - 2.220446049250313e-16), 2.220446049250313e-16)))) AS loss,
    max(abs(cp / nullif(ap, 0) - cn / nullif(an, 0))) AS ks
  FROM (
    SELECT *, CAST(sum(pos) OVER ({part}ORDER BY s) AS DOUBLE) AS cp, CAST(sum(neg) OVER ({part}ORDER BY s) AS DOUBLE) AS cn,
      CAST(sum(pos) OVER ({part}) AS DOUBLE) AS ap, CAST(sum(neg) OVER ({part}) AS DOUBLE) AS an
    FROM (SELECT {lead}CAST({score} AS DOUBLE) AS s, count(*) FILTER (WHERE {label} = 1) AS pos,
            count(*) FILTER (WHERE {label} = 0) AS neg
          FROM {source} WHERE {label} IN (0, 1) AND {score} IS NOT NULL GROUP BY {lead}s)) {group})"""


@query(_metrics_sql("predictions", LABEL, SCORE), ["predictions"])
def binary_metrics(t: Tables) -> DataFrame:
    return me.binary_metrics(b.predictions(t), LABEL, SCORE)


SEGMENTED = ", segmented AS (SELECT * FROM predictions JOIN demographics USING (customer_id))"


def _segmented(t: Tables) -> DataFrame:
    return b.predictions(t).join(b.demographics(t), "customer_id")


@query(f"{SEGMENTED}{_metrics_sql('segmented', LABEL, SCORE, 'segment')}", ["predictions", "demographics"])
def binary_metrics_by_segment(t: Tables) -> DataFrame:
    return me.binary_metrics(_segmented(t), LABEL, SCORE, by=["segment"])


DOCUMENT_SQL = """, scored AS (SELECT quality, lang, 1.0 / (1.0 + exp(-(n_chars - 1000) / 700.0)) AS score
  FROM documents JOIN labels USING (doc_id))"""


def _documents(t: Tables) -> DataFrame:
    """Labelled documents with a raw double score from their length."""
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("n_chars") - 1000) / 700.0))
    docs = t["documents"].select("doc_id", "n_chars", "lang").join(t["labels"], "doc_id")
    return docs.select("quality", "lang", score.alias("score"))


@query(f"WITH {DOCUMENT_SQL[2:]}{_metrics_sql('scored', 'quality', 'score')}")
def document_metrics(t: Tables) -> DataFrame:
    return me.binary_metrics(_documents(t), "quality", "score")


def _curve_sql(kind: str) -> str:
    order = "DESC" if kind == "roc" else "ASC"
    point = {
        "roc": ("0", "r", "fp / n", "tp / p", "0.0", "0.0"),
        "pr": ("m", "r - 1", "tp / p", "tp / (tp + fp)", "0.0", "1.0"),
    }[kind]
    return f""", counts AS (SELECT {SCORE} AS s, count(*) FILTER (WHERE {LABEL} = 1) AS pos,
  count(*) FILTER (WHERE {LABEL} = 0) AS neg FROM predictions WHERE {LABEL} IN (0, 1) GROUP BY s),
cum AS (SELECT row_number() OVER (ORDER BY s {order}) AS r, count(*) OVER () AS m,
  CAST(sum(pos) OVER (ORDER BY s DESC) AS DOUBLE) AS tp, CAST(sum(neg) OVER (ORDER BY s DESC) AS DOUBLE) AS fp,
  CAST(sum(pos) OVER () AS DOUBLE) AS p, CAST(sum(neg) OVER () AS DOUBLE) AS n FROM counts),
points AS (SELECT m, {point[1]} AS place, {point[2]} AS x, {point[3]} AS y FROM cum
  UNION ALL SELECT max(m), max({point[0]}), {point[4]}, {point[5]} FROM cum)
SELECT CAST(i AS INT) AS idx, round(x, 4) AS x, round(y, 4) AS y
FROM range(15) g(i), points WHERE (i * m) // 14 = place"""


@query(_curve_sql("roc"), ["predictions"])
def roc_curve(t: Tables) -> DataFrame:
    return me.curve(b.predictions(t), LABEL, SCORE, "roc")


@query(_curve_sql("pr"), ["predictions"])
def pr_curve(t: Tables) -> DataFrame:
    return me.curve(b.predictions(t), LABEL, SCORE, "pr")


BINS = "(VALUES " + ", ".join(f"('{n}', {lo}::DOUBLE, {hi}::DOUBLE)" for n, lo, hi in me.RISK_BINS) + ") v(bin, lo, hi)"


@query(f"""SELECT bin, round(coalesce(CAST(sum({SCORE}) AS DOUBLE) / nullif(count({SCORE}), 0), (lo + hi) / 2), 4)
    AS predicted_rate,
  round(coalesce(count(*) FILTER (WHERE {LABEL} = 1) / nullif(count({SCORE}), 0), 0.0), 4) AS actual_rate,
  count({SCORE}) AS n
FROM {BINS} LEFT JOIN (SELECT * FROM predictions WHERE {LABEL} IN (0, 1))
  ON CAST({SCORE} AS DOUBLE) >= lo AND CAST({SCORE} AS DOUBLE) <= hi GROUP BY bin, lo, hi""", ["predictions"])
def risk_slope(t: Tables) -> DataFrame:
    return me.risk_slope(b.predictions(t), LABEL, SCORE)


FAIR_SQL = """round(coalesce(
    (count(*) FILTER (WHERE segment = 'AUTOMOBILE' AND label = 1) / nullif(count(*) FILTER (WHERE segment = 'AUTOMOBILE'), 0))
    / nullif(count(*) FILTER (WHERE segment = 'BUILDING' AND label = 1)
        / nullif(count(*) FILTER (WHERE segment = 'BUILDING'), 0), 0), 1.0), 4) AS adverse_impact_ratio"""


@query(f""", labelled AS (SELECT segment, month(timestamp) AS m, region,
  CAST({SCORE} >= 0.25 AS INT) AS label FROM predictions JOIN demographics USING (customer_id))
SELECT region, {FAIR_SQL} FROM labelled GROUP BY region""", ["predictions", "demographics"])
def fairness(t: Tables) -> DataFrame:
    labelled = _segmented(t).withColumn("label", (F.col(SCORE) >= 0.25).cast("int"))
    return me.adverse_impact(labelled, "label", "segment", "BUILDING", "AUTOMOBILE", by=["region"])


@query(f"""SELECT count(*) AS scored_count, round(coalesce(CAST(sum({SCORE}) AS DOUBLE) / count(*), 0.0), 4)
  AS average_propensity_score FROM predictions""", ["predictions"])
def score_summary(t: Tables) -> DataFrame:
    return me.score_summary(b.predictions(t), SCORE)


# ---- drift

def edges_sql(bins: int) -> str:
    e = linspace(0.0, 1.0, bins)
    rows = ", ".join(f"({i}, '{e[i]!r}'::DOUBLE, '{e[i + 1]!r}'::DOUBLE)" for i in range(bins))
    return f"(VALUES {rows}) b(bin, lo, hi)"


def in_bin_sql(value: str, bins: int) -> str:
    return f"({value} >= lo AND ({value} < hi OR (bin = {bins - 1} AND {value} <= hi)))"


@query(f"""SELECT CAST(bin AS INT) AS bin, round((lo + hi) / 2, 3) AS midpoint,
  count(*) FILTER (WHERE side = 'expected' AND {in_bin_sql('s', 19)}) AS expected,
  count(*) FILTER (WHERE side = 'actual' AND {in_bin_sql('s', 19)}) AS actual
FROM {edges_sql(19)}, (SELECT side, CAST({SCORE} AS DOUBLE) AS s FROM score_sides) GROUP BY bin, lo, hi""",
       ["score_sides"])
def score_distribution(t: Tables) -> DataFrame:
    return dr.score_distribution(b.score_sides(t), "side", SCORE)


def _psi_sql(source: str, value: str, by: str = "") -> str:
    """PSI per group from a source with columns side and `value`."""
    lead, group, part = (f"{by}, ", f"{by}, ", f"PARTITION BY {by}") if by else ("", "", "")
    return f"""
SELECT {lead}round(sum((a - e) * ln(a / e)), 4) AS psi FROM (
  SELECT {lead}bin, e / sum(e) OVER ({part}) AS e, a / sum(a) OVER ({part}) AS a FROM (
    SELECT {lead}bin, CASE WHEN ec = 0 THEN 0.0001 ELSE ec / en END AS e, CASE WHEN ac = 0 THEN 0.0001 ELSE ac / an END AS a
    FROM (SELECT {lead}bin, count(*) FILTER (WHERE side = 'expected') AS en, count(*) FILTER (WHERE side = 'actual') AS an,
        count(*) FILTER (WHERE side = 'expected' AND {in_bin_sql('s', 10)}) AS ec,
        count(*) FILTER (WHERE side = 'actual' AND {in_bin_sql('s', 10)}) AS ac
      FROM {edges_sql(10)}, (SELECT *, CAST({value} AS DOUBLE) AS s FROM {source}) GROUP BY {group}bin, lo, hi))
) {'GROUP BY ' + by if by else ''}"""


@query(_psi_sql("score_sides", SCORE), ["score_sides"])
def psi(t: Tables) -> DataFrame:
    return dr.psi(b.score_sides(t), "side", SCORE)


@query(f", segmented AS (SELECT * FROM score_sides JOIN demographics USING (customer_id)){_psi_sql('segmented', SCORE, 'segment')}",
       ["score_sides", "demographics"])
def psi_by_segment(t: Tables) -> DataFrame:
    return dr.psi(b.score_sides(t).join(b.demographics(t), "customer_id"), "side", SCORE, by=["segment"])


def _ks_sql(source: str, value: str, by: str = "") -> str:
    lead, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return f"""
SELECT {lead}round(max(abs(ce / nullif(te, 0) - ca / nullif(ta, 0))), 4) AS ks FROM (
  SELECT {lead}sum(e) OVER ({part} ORDER BY v) AS ce, sum(a) OVER ({part} ORDER BY v) AS ca,
    sum(e) OVER ({part}) AS te, sum(a) OVER ({part}) AS ta
  FROM (SELECT {lead}{value} AS v, count(*) FILTER (WHERE side = 'expected') AS e,
      count(*) FILTER (WHERE side = 'actual') AS a FROM {source} GROUP BY {lead}v)) {'GROUP BY ' + by if by else ''}"""


@query(_ks_sql("score_sides", SCORE), ["score_sides"])
def ks(t: Tables) -> DataFrame:
    return dr.ks(b.score_sides(t), "side", SCORE)


LINE_SIDES_SQL = """(SELECT *, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'expected' ELSE 'actual' END AS side
  FROM lineitem)"""


def _line_sides(t: Tables) -> DataFrame:
    early = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return t["lineitem"].withColumn("side", F.when(early, "expected").otherwise("actual"))


@query(_ks_sql(LINE_SIDES_SQL, "l_extendedprice", "l_returnflag"))
def ks_of_prices(t: Tables) -> DataFrame:
    """KS over raw money values, per return flag."""
    return dr.ks(_line_sides(t), "side", "l_extendedprice", by=["l_returnflag"])


def _drift_sql(source: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS feature, side, CAST({c} AS DOUBLE) AS value,
  CASE WHEN hi > lo THEN least(greatest((CAST({c} AS DOUBLE) - lo) / (hi - lo), 0.0), 1.0) ELSE 0.0 END AS scaled
FROM {source}, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {source}
  WHERE side = 'expected') WHERE {c} IS NOT NULL""")
    return f""", drift_rows AS ({' UNION ALL '.join(parts)}), drift_psi AS ({_psi_sql('drift_rows', 'scaled', 'feature')})
SELECT feature, round(sum(value) FILTER (WHERE side = 'expected')
    / count(*) FILTER (WHERE side = 'expected'), 4) AS baseline_mean,
  round(sum(value) FILTER (WHERE side = 'actual')
    / count(*) FILTER (WHERE side = 'actual'), 4) AS live_mean,
  max(psi) + 0.0 AS psi, CASE WHEN max(psi) >= 0.25 THEN 'Critical' ELSE 'Stable' END AS status
FROM drift_rows JOIN drift_psi USING (feature) GROUP BY feature"""


LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("WITH sides AS " + LINE_SIDES_SQL + _drift_sql("sides", LINE_FEATURES))
def feature_drift(t: Tables) -> DataFrame:
    return dr.feature_drift(_line_sides(t), "side", LINE_FEATURES)


@query("WITH sides AS " + LINE_SIDES_SQL + _drift_sql("sides", ["l_tax"]) + """
UNION ALL SELECT 'never', NULL, NULL, 0.0, 'Stable' FROM (SELECT 1)""")
def feature_drift_empty(t: Tables) -> DataFrame:
    """A feature without values, NaN at best, keeps its row."""
    empty = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).alias("never")
    return dr.feature_drift(_line_sides(t).select("side", "l_tax", empty), "side", ["l_tax", "never"])


STRESSED = ["credit_score", "average_utilization", "payment_delay_days"]


@query(STRESS_SQL.replace("LIMIT 400", "LIMIT 4000") + """, sides AS (
  SELECT 'expected' AS side, credit_score, average_utilization, payment_delay_days FROM profile
  UNION ALL SELECT 'actual', credit_score, average_utilization, payment_delay_days FROM stressed)
""" + _drift_sql("sides", STRESSED), ["profile"])
def stressed_drift(t: Tables) -> DataFrame:
    base = stored(b.profile(t).select("customer_id", *STRESSED), "profile")
    return dr.feature_drift(dr.two_sides(base, stress_frame(base, n=4000)), "side", STRESSED)


HISTORY_SQL = f""", stepped AS (SELECT *, CAST(timestamp AS DATE) AS step FROM predictions),
live AS (SELECT step, {SCORE}, 'actual' AS side FROM stepped),
base AS (SELECT s.step, p.{SCORE}, 'expected' AS side FROM (SELECT DISTINCT step FROM stepped) s, predictions p
  WHERE p.timestamp < TIMESTAMP '2024-01-11'),
both_sides AS (FROM live UNION ALL FROM base),
psis AS ({_psi_sql('both_sides', SCORE, 'step')}), metrics AS ({_metrics_sql('stepped', LABEL, SCORE, 'step')})
SELECT CAST(step AS VARCHAR) AS step, n_labelled, roc_auc, pr_auc, f1_score, log_loss, ks_statistic, gini, psi
FROM metrics JOIN psis USING (step)"""


@query(HISTORY_SQL, ["predictions"])
def metric_history(t: Tables) -> DataFrame:
    out = dr.metric_history(b.predictions(t), LABEL, SCORE, "timestamp", "2024-01-11")
    return out.withColumn("step", F.col("step").cast("string"))


@query(HISTORY_SQL, ["predictions"])
def history_by_day(t: Tables) -> DataFrame:
    """The same from stored counters: the early days, then the newest ones with pending outcomes, twice, then the
    outcomes."""
    log = b.predictions(t)
    hist = hi.MetricHistory(t.spark, scratch_path(t.spark, "history"), log.schema[SCORE].dataType)
    late = F.col("timestamp") >= F.lit("2024-01-25").cast("timestamp_ntz")
    hist.append(log.where(~late), "early", LABEL, SCORE, "timestamp")
    hist.set_baseline("2024-01-11")
    pending = log.where(late).withColumn("was", F.lit(-1))
    for _ in range(2):
        hist.append(pending, "new", "was", SCORE, "timestamp")
    hist.append(pending, "outcomes", LABEL, SCORE, "timestamp", old_label="was")
    return hist.history().withColumn("step", F.col("step").cast("string"))


@query("WITH base AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'),\n" + """
live AS (SELECT strftime(date_trunc('year', l_shipdate), '%Y-%m-%d') AS step, * FROM lineitem),
raw AS (""" + " UNION ALL ".join(f"""
SELECT '{c}' AS feature, 'actual' AS side, step, CAST({c} AS DOUBLE) AS value FROM live
UNION ALL SELECT '{c}', 'expected', step, CAST({c} AS DOUBLE) FROM base, (SELECT DISTINCT step FROM live)"""
    for c in ("l_quantity", "l_extendedprice")) + f"""),
both_sides AS (SELECT *, feature || '|' || step AS k, least(greatest((value - least_) / (most - least_), 0.0), 1.0) AS scaled
  FROM raw JOIN (SELECT feature, min(value) AS least_, max(value) AS most FROM raw WHERE side = 'expected' GROUP BY feature)
    USING (feature)),
psis AS ({_psi_sql('both_sides', 'scaled', 'k')})
SELECT step, feature, count(*) FILTER (WHERE side = 'actual') AS n,
  count(*) FILTER (WHERE side = 'actual') AS n_sketched,
  round(avg(value) FILTER (WHERE side = 'actual'), 2) AS live_mean, max(psi) AS psi, TRUE AS median_near
FROM both_sides JOIN psis USING (k) GROUP BY step, feature""")
def feature_history(t: Tables) -> DataFrame:
    """Drift per year from stored counters, the lines in two batches of which one is counted twice; the sketches' median
    of all years lies within two percent of the ranks."""
    lines = t["lineitem"].select("l_shipdate", "l_quantity", "l_extendedprice", "l_linenumber")
    cols = ["l_quantity", "l_extendedprice"]
    hist = hi.FeatureHistory(t.spark, scratch_path(t.spark, "features"))
    hist.set_baseline(lines.where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")), cols)
    for batch in ("first", "second", "second"):
        part = F.col("l_linenumber") == 1
        hist.append(lines.where(part if batch == "first" else ~part), batch, "l_shipdate", "year")
    found = {r["feature"]: r["q_0"] for r in hist.quantiles([0.5]).collect()}
    ranks = lines.agg(*[F.count_if(F.col(c) < found[c]).alias(f"{c}_below") for c in cols],
                      *[F.count_if(F.col(c) <= found[c]).alias(f"{c}_upto") for c in cols], F.count(F.lit(1)).alias("n")).first()
    near = all(ranks[f"{c}_below"] / ranks["n"] <= 0.52 and ranks[f"{c}_upto"] / ranks["n"] >= 0.48 for c in cols)
    steps = [r["step"] for r in hist.drift().select("step").distinct().collect()]
    each = [hist.quantiles([0.5], str(s), str(s)).select(F.lit(s).alias("step"), "feature", F.col("n").alias("n_sketched"))
            for s in steps]
    sketched = reduce(DataFrame.unionByName, each)
    return hist.drift().join(sketched, ["step", "feature"]).select(
        F.col("step").cast("string").alias("step"), "feature", "n", "n_sketched",
        F.round("live_mean", 2).alias("live_mean"), "psi", F.lit(near).alias("median_near"))


@query(f""", stepped AS (SELECT * EXCLUDE ({LABEL}), CAST(timestamp AS DATE) AS step,
  CASE WHEN timestamp >= TIMESTAMP '2024-01-25' THEN -1 ELSE {LABEL} END AS {LABEL} FROM predictions),
live AS (SELECT step, {SCORE}, 'actual' AS side FROM stepped),
base AS (SELECT s.step, p.{SCORE}, 'expected' AS side FROM (SELECT DISTINCT step FROM stepped) s, predictions p
  WHERE p.timestamp < TIMESTAMP '2024-01-11'),
both_sides AS (FROM live UNION ALL FROM base),
psis AS ({_psi_sql('both_sides', SCORE, 'step')}), metrics AS ({_metrics_sql('stepped', LABEL, SCORE, 'step')})
SELECT CAST(step AS VARCHAR) AS step, coalesce(n_labelled, 0) AS n_labelled, coalesce(roc_auc, 0.5) AS roc_auc,
  coalesce(pr_auc, 0.5) AS pr_auc, coalesce(log_loss, 0.693) AS log_loss, coalesce(ks_statistic, 0.0) AS ks_statistic, psi
FROM psis LEFT JOIN metrics USING (step)""", ["predictions"])
def metric_history_pending(t: Tables) -> DataFrame:
    """The outcomes of the newest days are all pending."""
    late = F.col("timestamp") >= F.lit("2024-01-25").cast("timestamp_ntz")
    log = b.predictions(t).withColumn(LABEL, F.when(late, -1).otherwise(F.col(LABEL)))
    out = dr.metric_history(log, LABEL, SCORE, "timestamp", "2024-01-11")
    return out.select(F.col("step").cast("string"), "n_labelled", "roc_auc", "pr_auc", "log_loss", "ks_statistic", "psi")


# ---- decisions

def _live_metrics(t: Tables) -> DataFrame:
    """One row: AUC, PSI and fairness of the logged scores."""
    labelled = _segmented(t).withColumn("label", (F.col(SCORE) >= 0.25).cast("int"))
    one = F.lit(1).alias("_one")
    fair = me.adverse_impact(labelled, "label", "segment", "BUILDING", "AUTOMOBILE")
    rows = star_join(
        me.binary_metrics(b.predictions(t), LABEL, SCORE).select(one, "roc_auc"),
        [dr.psi(b.score_sides(t), "side", SCORE).select(one, "psi"),
         fair.select(one, F.col("adverse_impact_ratio").alias("fairness"))], "_one")
    return rows.drop("_one")


ALERT_SQL = f""", auc AS ({_metrics_sql('predictions', LABEL, SCORE)}), psis AS ({_psi_sql('score_sides', SCORE)}),
fair AS (SELECT {FAIR_SQL} FROM (SELECT segment, CAST({SCORE} >= 0.25 AS INT) AS label
  FROM predictions JOIN demographics USING (customer_id))),
best AS (SELECT model_id, roc_auc FROM registry_models WHERE model_id <> 'm_0' AND status = 'challenger'
  ORDER BY roc_auc DESC NULLS LAST, seq LIMIT 1),
alert AS (SELECT 'm_0' AS champion_id, auc.roc_auc AS live_auc, psi, adverse_impact_ratio AS fairness,
  best.model_id AS challenger_id, best.roc_auc AS challenger_auc, psi >= 0.25 OR auc.roc_auc < 0.75 AS degraded,
  true AS needs_approval FROM auc, psis, fair, best)"""
ALERT_FRAMES = ["predictions", "score_sides", "demographics", "registry_models"]


@query(ALERT_SQL + " SELECT * FROM alert", ALERT_FRAMES)
def drift_alert(t: Tables) -> DataFrame:
    return dr.drift_alert(b.registry_models(t), _live_metrics(t), "m_0")


@query(ALERT_SQL + """ SELECT champion_id, challenger_id, CASE WHEN degraded THEN 'promote' ELSE 'none' END AS decision,
  CASE WHEN degraded THEN challenger_id ELSE champion_id END AS active_id,
  CASE WHEN degraded THEN 'Automated Hot-Swap completed: ' || champion_id || ' -> ' || challenger_id END
    AS audit_action FROM alert""", ALERT_FRAMES)
def failover(t: Tables) -> DataFrame:
    return dr.failover(dr.drift_alert(b.registry_models(t), _live_metrics(t), "m_0", "automatic"), "automatic")


@query(ALERT_SQL + """ SELECT champion_id, challenger_id, CASE WHEN degraded THEN 'flag' ELSE 'none' END AS decision,
  champion_id AS active_id,
  CASE WHEN degraded THEN 'Failover proposed: ' || champion_id || ' -> ' || challenger_id END AS audit_action
FROM alert""", ALERT_FRAMES)
def failover_manual(t: Tables) -> DataFrame:
    return dr.failover(dr.drift_alert(b.registry_models(t), _live_metrics(t), "m_0"))
