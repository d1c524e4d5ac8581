"""Scoring, training, bulk-file and streaming queries."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensity_spark.functions.session import scratch_path, shared_dir
from propensity_spark.operators import models as md
from propensity_spark.operators import scoring as sc
from propensity_spark.operators.customer360 import FEATURES
from propensity_spark.operators.metrics import score_summary as summary
from propensity_spark.plans import bindings as b
from propensity_spark.plans.customer_queries import TELEMETRY
from propensity_spark.plans.metric_queries import SCORE, in_bin_sql, edges_sql
from propensity_spark.plans.registry import query
from propensity_spark.sources import model_store, readers
from propensity_spark.sources.readers import Tables
from propensity_spark.streaming import jobs

# ---- stored coefficients

WEIGHTS = {"credit_score": 0.004, "annual_income": 0.0000005, "average_utilization": -1.25, "monthly_spend": 0.00002,
           "fixed_deposit_balance": 0.000001}
INTERCEPT = -2.5
TOTAL_SQL = f"({INTERCEPT}::DOUBLE" + "".join(
    f" + coalesce({f}, 0) * {w!r}::DOUBLE" for f, w in WEIGHTS.items()) + ")"
LOGIT_SQL = f"(1.0 / (1.0 + exp(-{TOTAL_SQL})))"


@query(f"""SELECT customer_id, round({LOGIT_SQL}, 6) AS score, CAST({LOGIT_SQL} >= 0.55 AS INT) AS predicted_label,
  round(least(greatest({TOTAL_SQL}, 0.0), 1.0), 6) AS linear_score FROM profile""", ["profile"])
def linear_score(t: Tables) -> DataFrame:
    out = sc.linear_score(b.profile(t), WEIGHTS, INTERCEPT)
    both = sc.linear_score(out.drop("predicted_label"), WEIGHTS, INTERCEPT, "identity", "linear_score")
    return both.select("customer_id", F.round("score", 6).alias("score"),
                       (F.col("score") >= 0.55).cast("int").alias("predicted_label"),
                       F.round("linear_score", 6).alias("linear_score"))


TERMS_SQL = "[" + ", ".join(f"coalesce({f}, 0) * {w!r}::DOUBLE" for f, w in WEIGHTS.items()) + "]"


def _top_sql(n: int, by: str) -> str:
    return f"round(list_reverse_sort(list_transform({TERMS_SQL}, lambda x: {{'by': {by}, 'term': x}}))[{n}].term, 6) + 0.0"


@query("SELECT customer_id, " + ", ".join(
    [f"{_top_sql(i, 'abs(x)')} AS explanation_coeff_{i}" for i in (1, 2, 3)]
    + [f"{_top_sql(i, 'x')} AS signed_{i}" for i in (1, 2, 3)]) + " FROM profile", ["profile"])
def contributions(t: Tables) -> DataFrame:
    df = b.profile(t).select("customer_id", *WEIGHTS)
    names = [f"explanation_coeff_{i}" for i in (1, 2, 3)]
    out = sc.contributions(df, WEIGHTS).withColumnsRenamed({n: f"abs_{n}" for n in names})
    out = sc.contributions(out, WEIGHTS, signed=True)
    return out.select("customer_id", *[(F.round(f"abs_{n}", 6) + 0.0).alias(n) for n in names],
                      *[(F.round(n, 6) + 0.0).alias(f"signed_{i}") for i, n in enumerate(names, 1)])


def _batch(t: Tables) -> DataFrame:
    return sc.batch_population(b.demographics(t), b.details(t), 250)


COHORT_SQL = "(SELECT * FROM profile ORDER BY md5(customer_id || '|42'), customer_id LIMIT 250)"


@query(f"""SELECT substr(sha256(customer_id || '|lin_reg_custom|run-1'), 1, 12) AS prediction_id, customer_id,
  'lin_reg_custom' AS model_id, 'credit_card' AS target_product_type, round({LOGIT_SQL}, 4) AS propensity_score,
  CAST({LOGIT_SQL} >= 0.55 AS INT) AS predicted_label,
  {', '.join(f"{_top_sql(i, 'abs(x)')} AS explanation_coeff_{i}" for i in (1, 2, 3))},
  -1 AS is_conversion_successful FROM {COHORT_SQL}""", ["profile"])
def batch_score(t: Tables) -> DataFrame:
    out = sc.batch_score(_batch(t), 250, "lin_reg_custom", "credit_card", WEIGHTS, INTERCEPT, "run-1")
    return readers.normalise(out).withColumns(
        {f"explanation_coeff_{i}": F.col(f"explanation_coeff_{i}") + 0.0 for i in (1, 2, 3)})


@query(f"""SELECT count(*) AS scored_count, round(CAST(sum(CAST(round({LOGIT_SQL}, 4) AS DECIMAL(5,4))) AS DOUBLE)
  / count(*), 4) AS average_propensity_score FROM {COHORT_SQL}""", ["profile"])
def batch_summary(t: Tables) -> DataFrame:
    scored = sc.batch_score(_batch(t), 250, "lin_reg_custom", "credit_card", WEIGHTS, INTERCEPT, "run-1")
    return summary(scored, "propensity_score")


# ---- Spark ML

INPUTS = FEATURES
#: Parameters given by the caller; all other training queries run the declared defaults.
OVERRIDES = {"logistic_regression": {"max_iter": "50", "C": 0.5}, "random_forest": {"n_estimators": 10, "max_depth": 5},
             "pytorch_mlp": {"max_iter": 10, "unknown": 1}}
_RUNS: dict[str, tuple[tuple, object]] = {}


def _once(name: str, rows: DataFrame, make: Callable[[], object]):
    """What make() made last under this name, if it was in this session and of the same rows; else made anew."""
    key = (rows.sparkSession.sparkContext.applicationId, model_store.content_digest(rows))
    if name not in _RUNS or _RUNS[name][0] != key:
        _RUNS[name] = (key, make())
    return _RUNS[name][1]


def _kept(result: md.Training) -> md.Training:
    """The scoreboard and scored rows as stored tables; nothing stays cached."""
    out = replace(result, scoreboard=readers.stored(result.scoreboard, "scoreboard"),
                  scored=readers.stored(result.scored, "scored"), cached=[])
    result.release()
    return out


def _train_studio(profile: DataFrame, algorithms: list[str], params: dict | None = None) -> md.Training:
    return _kept(md.train_studio(
        profile, "defaulter", algorithms, INPUTS,
        {"credit_limit": "median", "monthly_spend": "mean", "fixed_deposit_balance": "zero"}, 0.7,
        tags={"auto_cure_max_dpd": 5}, group="segment", privileged="BUILDING", unprivileged="AUTOMOBILE", params=params))


def _studio(t: Tables) -> md.Training:
    """All six algorithms with their defaults; queries over the same rows share the run."""
    profile = readers.stored(b.profile(t), "profile")
    return _once("studio", profile, lambda: _train_studio(profile, list(md.ALGORITHMS)))


def _campaign(t: Tables) -> tuple[md.Training, DataFrame]:
    """All six algorithms on the whole population of a campaign, and the best model's leads."""
    profile = readers.stored(b.profile(t), "profile")

    def make() -> tuple[md.Training, DataFrame]:
        result, leads = md.train_campaign(profile, "loans", list(md.ALGORITHMS), INPUTS)
        leads = readers.stored(leads, "leads")
        return _kept(result), leads

    return _once("campaign", profile, make)


def _serving(t: Tables) -> tuple[model_store.Serving, DataFrame]:
    """Champion and shadows of all six algorithms as loaded from a folder, and the rows they were fitted on.

    The folder is named after the content of those rows: fitted and saved if it does not hold all of them yet. A fit
    that fails is an error, since scores without that model would look like the scores of all.
    """
    rows = readers.stored(md.campaign_labels(b.profile(t), "defaulter"), "labelled")
    folder = os.path.join(shared_dir(t.spark), f"models-{model_store.content_digest(rows)}")
    wanted = [(f"{a.short}_custom", name, None) for name, a in md.ALGORITHMS.items()]
    if model_store.saved_ids(t.spark, folder) != [w[0] for w in wanted]:
        models = md.train_whole(rows, wanted, INPUTS, "label")
        model_store.save_models(t.spark, model_store.Serving(models, "xgb_custom"), folder)
    return model_store.load_models(t.spark, folder), rows


@query()
def studio_scoreboard(t: Tables) -> DataFrame:
    return _studio(t).scoreboard.drop("latency_ms")


@query()
def studio_overrides(t: Tables) -> DataFrame:
    profile = readers.stored(b.profile(t), "profile")
    return _train_studio(profile, list(OVERRIDES), OVERRIDES).scoreboard.drop("latency_ms")


@query("""SELECT v.model_id, 'Ready' AS status, test.n AS n_scored, test.late AS n_positive, test.n AS n_in_range,
  test.n AS n_labelled_by_threshold
FROM (VALUES ('lin_reg_studio'), ('log_reg_studio'), ('xgb_studio'), ('cat_studio'), ('rf_studio'), ('mlp_studio'))
  v(model_id), (SELECT count(*) AS n, count(*) FILTER (WHERE late_payment_flag) AS late FROM profile
  WHERE CAST('0x' || substr(md5(customer_id || '|42'), 1, 8) AS BIGINT) % 10000 >= 7000) test""", ["profile"])
def studio_checks(t: Tables) -> DataFrame:
    """What SQL can say of the studio's run: every model is fitted, and scores and labels every test row."""
    trained = _studio(t)
    fits = F.col("score").between(0, 1)
    by_threshold = F.col("predicted_label") == (F.col("score") >= 0.55).cast("int")
    rows = trained.scored.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n_scored"), F.count_if(F.col("label") == 1).alias("n_positive"),
        F.count_if(fits).alias("n_in_range"), F.count_if(by_threshold).alias("n_labelled_by_threshold"))
    return trained.scoreboard.select("model_id", "status").join(rows, "model_id")


@query()
def studio_curves(t: Tables) -> DataFrame:
    result = _studio(t)
    curves = [result.curves(k).withColumn("kind", F.lit(k)) for k in ("roc", "pr")]
    risk = result.risk().select("model_id", F.lit(0).alias("idx"), F.col("predicted_rate").alias("x"),
                                F.col("actual_rate").alias("y"), F.concat(F.lit("risk "), "bin").alias("kind"))
    return curves[0].unionByName(curves[1]).unionByName(risk)


@query()
def campaign_leads(t: Tables) -> DataFrame:
    return _campaign(t)[1].select("customer_id", "annual_income", "credit_score",
                                  F.round("score", 4).alias("propensity_score"))


MODEL_IDS = ", ".join(f"('{a.short}_custom')" for a in md.ALGORITHMS.values())


@query(f"""SELECT v.model_id, 'Ready' AS status, n AS n_scored, n AS n_in_range, least(n, 100) AS n_leads,
  least(n, 100) AS n_best_first FROM (VALUES {MODEL_IDS}) v(model_id), (SELECT count(*) AS n FROM profile)""", ["profile"])
def campaign_checks(t: Tables) -> DataFrame:
    """What SQL can say of the campaign's run: every model scores everyone, and no one left out beats a lead."""
    result, leads = _campaign(t)
    fits = F.col("score").between(0, 1)
    rows = result.scored.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_scored"), F.count_if(fits).alias("n_in_range"))
    best = result.best().model_id
    top = result.scored.where(F.col("model_id") == best).orderBy(F.desc("score")).limit(100)
    limit = top.agg(F.min("score")).first()[0]
    found = leads.agg(F.count(F.lit(1)), F.count_if(F.col("score") >= limit)).first()
    return result.scoreboard.select("model_id", "status").join(rows, "model_id").withColumns(
        {"n_leads": F.lit(found[0]), "n_best_first": F.lit(found[1])})


@query()
def shadow_scores(t: Tables) -> DataFrame:
    serving, rows = _serving(t)
    return serving.score(rows, ["customer_id"])


ROLES = ", ".join(f"('{a.short}_custom', '{'champion' if name == 'xgboost' else 'shadow'}')"
                  for name, a in md.ALGORITHMS.items())


@query(f"""SELECT m.model_id, m.role, n AS n_scored, n AS n_in_range, n AS n_labelled_by_threshold
FROM (VALUES {ROLES}) m(model_id, role), (SELECT count(*) AS n FROM profile)""", ["profile"])
def shadow_checks(t: Tables) -> DataFrame:
    """What SQL can say of the shadow scores: every model of its role scores and labels everyone."""
    by_threshold = F.col("predicted_label") == (F.col("score") >= 0.55).cast("int")
    return shadow_scores(t).groupBy("model_id", "role").agg(
        F.count(F.lit(1)).alias("n_scored"), F.count_if(F.col("score").between(0, 1)).alias("n_in_range"),
        F.count_if(by_threshold).alias("n_labelled_by_threshold"))


@query()
def model_explanations(t: Tables) -> DataFrame:
    serving, rows = _serving(t)
    model = next(m for m in serving.models if m.algorithm == "random_forest")
    return model.explain(rows).select("customer_id", *[f"explanation_coeff_{i}" for i in (1, 2, 3)])


@query("""SELECT round(regr_slope(CAST(annual_income >= 500000 AS DOUBLE), credit_score), 8) AS slope,
  round(regr_intercept(CAST(annual_income >= 500000 AS DOUBLE), credit_score), 6) AS intercept FROM demographics""",
       ["demographics"])
def fitted_line(t: Tables) -> DataFrame:
    """A linear model with one input is the least-squares line."""
    people = b.demographics(t).withColumn("label", (F.col("annual_income") >= 500000).cast("int"))
    line = md.train(people, "linear_regression", ["credit_score"], "label").fitted.stages[-1]
    return t.spark.createDataFrame([(round(float(line.coefficients[0]), 8), round(float(line.intercept), 6))],
                                   "slope double, intercept double")


REGISTERED = [a.title for a in md.ALGORITHMS.values()] + ["XGBoost", "Prophet"]


@query("""SELECT DISTINCT 'm_' || (p_size % 8) AS model_id, CASE WHEN p_size % 8 < 6 THEN 5 ELSE 0 END AS n_metrics,
  p_size % 8 = 6 AS failed FROM part""")
def registered_training(t: Tables) -> DataFrame:
    """A model of each algorithm, one with a parameter that is no number, one of an unknown algorithm; all features.

    The outcome is a late payment; parameters that the registry holds are those of small models.
    """
    key = F.col("k")
    empty = F.create_map().cast("map<string,double>")
    params = F.create_map(*[F.lit(x) for x in ("max_depth", "4", "depth", "4", "n_estimators", "20", "iterations", "20",
                                               "max_iter", "50")])
    bad = F.create_map(F.lit("max_depth"), F.lit("deep"))
    registry = t["part"].select((F.col("p_size") % 8).alias("k")).distinct().select(
        F.concat(F.lit("m_"), key.cast("string")).alias("model_id"), key.alias("seq"),
        F.get(F.array(*[F.lit(x) for x in REGISTERED]), key).alias("algorithm_type"), F.lit("ML").alias("model_category"),
        F.when(key == 6, bad).otherwise(params).alias("hyperparameters"), empty.alias("baselines"),
        empty.alias("live_metrics"))
    people = readers.stored(md.campaign_labels(b.profile(t), "defaulter"), "labelled")
    _, out = md.train_registered(registry, people, INPUTS, "label")
    return out.select("model_id", F.size("baselines").alias("n_metrics"), F.col("error").isNotNull().alias("failed"))


# ---- files

@query("""SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_nationkey % 5 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS c_nationkey,
  CAST(c_acctbal > 0 AS INT) AS positive FROM customer""")
def tsv_round_trip(t: Tables) -> DataFrame:
    rows = t["customer"].select(
        "c_custkey", F.concat("c_name", F.lit("\t")).alias("c_name"), "c_acctbal",
        F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey")).alias("c_nationkey"),
        (F.col("c_acctbal") > 0).alias("positive"))
    path = scratch_path(t.spark, "tsv")
    readers.save_tsv(rows, path)
    back = readers.load_tsv(t.spark, path,
                            "c_custkey bigint, c_name string, c_acctbal double, c_nationkey int, positive boolean")
    return back.withColumns({"c_name": F.rtrim("c_name"), "positive": F.col("positive").cast("int"),
                             "c_nationkey": F.col("c_nationkey").cast("double")})


@query("""SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n, round(CAST(sum(s) AS DOUBLE), 4) AS total
FROM (SELECT timestamp AS ts, propensity_score AS s FROM predictions) GROUP BY day""", ["predictions"])
def appended_log(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "predictions")
    readers.append_log(b.predictions(t), path)
    log = t.spark.read.parquet(path)
    return log.groupBy(F.col("day").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("propensity_score").cast("double").alias("total"))


# ---- streams over the event files

def _log_stream(t: Tables) -> DataFrame:
    return b.request_log(jobs.file_stream(t.spark, t.folder, "events"))


@query("""SELECT log_id, endpoint, CASE WHEN json_exists(payload_summary, '$.k') THEN '{"k":"********"}'
  ELSE payload_summary END AS payload_summary FROM request_log""", ["request_log"])
def stream_masked_log(t: Tables) -> DataFrame:
    return jobs.run_masked_log(_log_stream(t), ["k"], "masked").select("log_id", "endpoint", "payload_summary")


@query(f"""SELECT strftime(date_trunc('day', timestamp), '%Y-%m-%d') AS window_start, endpoint, {TELEMETRY}
FROM request_log GROUP BY ALL""", ["request_log"])
def stream_telemetry(t: Tables) -> DataFrame:
    out = jobs.telemetry_of_counters(jobs.run_batches(_log_stream(t), "telemetry", jobs.telemetry_counters))
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


STREAM_PSI_SQL = f""", s AS (SELECT date_trunc('day', timestamp) AS step, CAST({SCORE} AS DOUBLE) AS s, timestamp FROM predictions),
e AS (SELECT bin, count(*) FILTER (WHERE {in_bin_sql('s', 10)}) / count(*) AS e FROM {edges_sql(10)}, s
  WHERE timestamp < TIMESTAMP '2024-01-16' GROUP BY bin),
a AS (SELECT step, bin, count(*) FILTER (WHERE {in_bin_sql('s', 10)}) / count(*) AS a, count(*) AS n FROM {edges_sql(10)}, s
  GROUP BY step, bin),
j AS (SELECT step, n, CASE WHEN e = 0 THEN 0.0001 ELSE e END AS e, CASE WHEN a = 0 THEN 0.0001 ELSE a END AS a
  FROM a JOIN e USING (bin)),
k AS (SELECT step, n, e / sum(e) OVER (PARTITION BY step) AS e, a / sum(a) OVER (PARTITION BY step) AS a FROM j)
SELECT strftime(step, '%Y-%m-%d') AS window_start, max(n) AS n, round(sum((a - e) * ln(a / e)), 4) AS psi FROM k GROUP BY step"""


@query(STREAM_PSI_SQL, ["predictions"])
def stream_psi(t: Tables) -> DataFrame:
    early = b.predictions(t).filter(F.col("timestamp") < F.lit("2024-01-16").cast("timestamp_ntz"))
    baseline = jobs.score_baseline(early, SCORE)
    live = b.predictions({"events": jobs.file_stream(t.spark, t.folder, "events")})
    counters = jobs.run_batches(live, "psi", lambda rows: jobs.psi_counters(rows, SCORE, "timestamp"))
    return jobs.psi_of_counters(counters, baseline).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query(f"""SELECT log_id, customer_id, round({LOGIT_SQL}, 6) AS score, CAST({LOGIT_SQL} >= 0.55 AS INT) AS predicted_label
FROM (SELECT event_id AS log_id, user_id AS customer_id FROM events) LEFT JOIN profile USING (customer_id)""",
       ["profile"])
def stream_scores(t: Tables) -> DataFrame:
    events = jobs.file_stream(t.spark, t.folder, "events")
    requests = events.select(F.col("event_id").alias("log_id"), F.col("user_id").alias("customer_id"))
    out = jobs.scored_requests(requests, readers.stored(b.profile(t), "profile"), WEIGHTS, INTERCEPT)
    out = out.select("log_id", "customer_id", F.round("score", 6).alias("score"), "predicted_label")
    return jobs.run_append(out, "scores")


@query(f"""SELECT event_id AS log_id, m.model_id, m.role, TRUE AS as_in_batch, TRUE AS in_range
FROM events, (VALUES {ROLES}) m(model_id, role)""")
def stream_champion(t: Tables) -> DataFrame:
    """Live requests scored by the loaded champion and its shadows; the batch scores of the same rows are equal."""
    serving, rows = _serving(t)
    profile = rows.drop("label")

    def requests(events: DataFrame) -> DataFrame:
        return events.select(F.col("event_id").alias("log_id"), F.col("user_id").alias("customer_id"))

    keep = ["log_id", "customer_id"]
    live = jobs.run_append(jobs.served_requests(
        requests(jobs.file_stream(t.spark, t.folder, "events")), profile, serving, keep), "served")
    batch = jobs.served_requests(requests(t["events"]), profile, serving, ["log_id"], wide="batch")
    # A request is joined once with the scores of all models, not once for each of them.
    own = F.get(F.filter("batch", lambda x: x["model_id"] == F.col("model_id")), F.lit(0))
    same = F.coalesce(F.struct("score", "predicted_label") == F.struct(own["score"], own["predicted_label"]), F.lit(False))
    return live.join(batch, "log_id", "left").select(
        "log_id", "model_id", "role", same.alias("as_in_batch"), F.col("score").between(0, 1).alias("in_range"))
