"""Registry, acceptance, audit and traffic queries. Registry rows are derived from part, rules from supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensity_spark.functions.session import scratch_path
from propensity_spark.operators import governance as gv
from propensity_spark.plans import bindings as b
from propensity_spark.plans.registry import query
from propensity_spark.sources.merge_table import BUCKET, MergeTable
from propensity_spark.sources.readers import Tables, flatten_list, split_list
from propensity_spark.sources.registry_file import Registry
from propensity_spark.sources.snapshots import Conflict

RANKS_SQL = """SELECT model_id, status,
  row_number() OVER (ORDER BY coalesce(roc_auc, 0.70) DESC, seq) AS roc_auc_rank,
  row_number() OVER (ORDER BY coalesce(pr_auc, 0.70) DESC, seq) AS pr_auc_rank FROM registry_models"""


@query(RANKS_SQL, ["registry_models"])
def model_ranks(t: Tables) -> DataFrame:
    return gv.model_ranks(b.registry_models(t)).select("model_id", "status", "roc_auc_rank", "pr_auc_rank")


@query(f"SELECT model_id, roc_auc_rank, CAST(model_id = 'm_0' AS INT) AS is_champion FROM ({RANKS_SQL})",
       ["registry_models"])
def model_list(t: Tables) -> DataFrame:
    out = gv.model_list(b.registry_models(t), "m_0")
    return out.select("model_id", "roc_auc_rank", F.col("is_champion").cast("int"))


ACCEPTANCE_SQL = """SELECT model_id, 'ML Model' AS type, algorithm_type AS checked,
  'ROC-AUC >= 0.70 & Latency <= 50ms' AS assertion_check,
  printf('AUC: %.4f, Latency: %.1fms', coalesce(roc_auc, 0.80), coalesce(latency, 15.0)) AS metric_value,
  CASE WHEN coalesce(roc_auc, 0.80) >= 0.70 AND coalesce(latency, 15.0) <= 50.0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM registry_models
UNION ALL SELECT model_id, 'Rule-Based Model', model_name, 'Valid Logic & Gini >= 0.40',
  printf('Conditions: %d, Gini: %.4f', n_conditions, coalesce(gini, 0.50)),
  CASE WHEN n_conditions > 0 AND coalesce(gini, 0.50) >= 0.40 THEN 'PASS' ELSE 'FAIL' END FROM registry_rules"""


@query(ACCEPTANCE_SQL, ["registry_models", "registry_rules"])
def acceptance(t: Tables) -> DataFrame:
    return gv.acceptance(b.registry_models(t), b.registry_rules(t))


@query(f"SELECT * FROM ({ACCEPTANCE_SQL}) WHERE model_id = 'rule_7'", ["registry_models", "registry_rules"])
def acceptance_of_one(t: Tables) -> DataFrame:
    return gv.acceptance(b.registry_models(t), b.registry_rules(t), "rule_7")


@query(f"""SELECT count(*) AS total_tested, count(*) FILTER (WHERE status = 'PASS') AS passed,
  count(*) FILTER (WHERE status = 'FAIL') AS failed,
  round(count(*) FILTER (WHERE status = 'PASS') / count(*), 4) AS pass_rate FROM ({ACCEPTANCE_SQL})""",
       ["registry_models", "registry_rules"])
def acceptance_summary(t: Tables) -> DataFrame:
    return gv.acceptance_summary(acceptance(t))


# ---- upserts

def _manifest(t: Tables) -> DataFrame:
    """One entry per line; a model comes many times, and its newest line counts. Half of the models are new."""
    order = F.col("l_orderkey") * 1000000 + F.col("l_suppkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity")
    return t["lineitem"].select(
        F.concat(F.lit("m_"), (F.col("l_partkey") * 2).cast("string")).alias("model_id"),
        F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("version"),
        F.when(F.col("l_partkey") % 2 == 0, "Rule").otherwise("ML").alias("model_category"),
        order.cast("bigint").alias("seq"))


MANIFEST_SQL = """, manifest AS (SELECT 'm_' || l_partkey * 2 AS model_id, 'v' || l_linenumber AS version,
  CASE WHEN l_partkey % 2 = 0 THEN 'Rule' ELSE 'ML' END AS model_category,
  CAST(l_orderkey * 1000000 + l_suppkey * 1000 + l_linenumber * 100 + l_quantity AS BIGINT) AS seq
  FROM lineitem)
"""


@query(MANIFEST_SQL + """, newest AS (SELECT model_id, arg_max(version, seq) AS version,
  arg_max(model_category, seq) AS model_category, max(seq) AS seq FROM manifest GROUP BY model_id)
SELECT model_id, version, model_category, seq FROM newest
UNION ALL SELECT model_id, version, model_category, seq FROM registry_models
WHERE model_id NOT IN (SELECT model_id FROM newest)""", ["registry_models"])
def manifest_upsert(t: Tables) -> DataFrame:
    current = b.registry_models(t).select("model_id", "version", "model_category", "seq")
    return gv.upsert(current, _manifest(t), "model_id", "seq")


@query(MANIFEST_SQL + """SELECT count(DISTINCT model_id) FILTER (WHERE model_category <> 'Rule') AS imported_ml,
  count(DISTINCT model_id) FILTER (WHERE model_category = 'Rule') AS imported_rules FROM manifest""",
       ["registry_models"])
def manifest_counts(t: Tables) -> DataFrame:
    return gv.upsert_counts(_manifest(t), "model_id")


@query("""SELECT o_custkey AS customer_id, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus,
  min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events) GROUP BY o_custkey""")
def insert_absent(t: Tables) -> DataFrame:
    incoming = t["orders"].select(F.col("o_custkey").alias("customer_id"), "o_orderstatus", "o_orderkey")
    # The order column is kept in the row as well.
    incoming = incoming.withColumn("place", F.col("o_orderkey"))
    current = t["events"].select(F.col("user_id").alias("customer_id"))
    return gv.insert_absent(current, incoming, "customer_id", "place").drop("place")


@query("""SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'rule_' ELSE 'lin_' END || s_suppkey AS model_id,
  CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 THEN 'Rule' ELSE 'ML' END AS model_category, 'challenger' AS status,
  CASE WHEN s_suppkey % 4 <> 0 THEN floor(s_acctbal) / 10000.0 ELSE 0.80 END AS roc_auc,
  CASE WHEN s_suppkey % 4 = 0 THEN floor(s_acctbal) / 10000.0 ELSE 0.75 END AS pr_auc, 15.0 AS latency FROM supplier""")
def approve_models(t: Tables) -> DataFrame:
    key, figure = F.col("s_suppkey"), F.floor("s_acctbal") / 10000.0
    none = F.lit(None).cast("double")
    studio = t["supplier"].select(
        F.concat(F.when(key % 3 == 0, "rule_").otherwise("lin_"), key.cast("string")).alias("model_id"),
        F.when(key % 5 == 0, "Rule Strategy A").otherwise("Linear Regression").alias("algorithm_type"),
        F.when(key % 4 != 0, figure).alias("auc"), F.when(key % 4 == 0, figure).alias("pr_auc"),
        none.alias("ks"), none.alias("fairness"), none.alias("latency_ms"))
    out = gv.approve(studio, "2026-01-01 00:00:00")
    return out.select("model_id", "model_category", "status", gv.metric("baselines", "roc_auc").alias("roc_auc"),
                      gv.metric("baselines", "pr_auc").alias("pr_auc"),
                      gv.metric("live_metrics", "latency").alias("latency"))


# ---- champion, audit, traffic

@query("""SELECT model_id, CASE WHEN model_id = 'm_9' THEN 'champion' WHEN status = 'champion' THEN 'challenger'
  ELSE status END AS status FROM registry_models""", ["registry_models"])
def promote(t: Tables) -> DataFrame:
    return gv.promote(b.registry_models(t), "m_9").select("model_id", "status")


PREVIOUS_SQL = """SELECT 'm_' || old_no AS model_id FROM audit_trail
WHERE event_type IN ('purchase', 'signup') AND new_no = 7 AND 'm_' || old_no IN (SELECT model_id FROM registry_models)
ORDER BY seq DESC LIMIT 1"""


@query(PREVIOUS_SQL, ["audit_trail", "registry_models"])
def previous_champion(t: Tables) -> DataFrame:
    return gv.previous_champion(b.registry_models(t), b.audit_trail(t), "m_7")


@query(f"""SELECT model_id, CASE WHEN model_id = (SELECT model_id FROM ({PREVIOUS_SQL})) THEN 'champion'
  WHEN status = 'champion' THEN 'challenger' ELSE status END AS status FROM registry_models""",
       ["audit_trail", "registry_models"])
def rollback(t: Tables) -> DataFrame:
    return gv.rollback(b.registry_models(t), b.audit_trail(t), "m_7", "m_1", "m_2").select("model_id", "status")


AUDIT_COLUMNS = "seq, timestamp, triggered_by, action, evidence, approved_by"


@query(f"""SELECT {AUDIT_COLUMNS} FROM audit_trail UNION ALL
SELECT max(seq) + 1, '2026-01-01 00:00:00', 'lead', 'Manual check', 'none', 'lead' FROM audit_trail""", ["audit_trail"])
def audit_append(t: Tables) -> DataFrame:
    return gv.audit_entry(b.audit_trail(t), "lead", "Manual check", "none", "2026-01-01 00:00:00", "lead")


@query(f"SELECT * FROM (SELECT {AUDIT_COLUMNS} FROM audit_trail ORDER BY seq DESC LIMIT 15) ORDER BY seq",
       ["audit_trail"])
def audit_tail(t: Tables) -> DataFrame:
    return gv.audit_tail(b.audit_trail(t))


@query("""SELECT event_id, CASE WHEN CAST('0x' || substr(md5(event_id || '|42'), 1, 8) AS BIGINT) % 10000 < 7000
  THEN 'm_0' ELSE 'm_9' END AS model_id FROM events""")
def assign_traffic(t: Tables) -> DataFrame:
    return gv.assign_traffic(t["events"].select("event_id"), "event_id", "m_0", "m_9", 0.7).drop("shadow_model_id")


@query("""SELECT event_id, mode, CASE WHEN mode = 'ab_split'
  AND CAST('0x' || substr(md5(event_id || '|42'), 1, 8) AS BIGINT) % 10000 >= 7000 THEN 'm_9' ELSE 'm_0' END AS model_id,
  CASE WHEN mode = 'shadow' THEN 'm_9' END AS shadow_model_id
FROM events, (VALUES ('ab_split'), ('single'), ('shadow')) v(mode)""")
def assign_traffic_modes(t: Tables) -> DataFrame:
    requests, out = t["events"].select("event_id"), None
    for mode in ("ab_split", "single", "shadow"):
        rows = gv.assign_traffic(requests, "event_id", "m_0", "m_9", 0.7, mode).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""SELECT 'model' AS part, model_id AS entry, CAST(roc_auc_rank AS VARCHAR) AS value FROM ({RANKS_SQL})
UNION ALL SELECT 'champion', 'm_0', NULL UNION ALL SELECT 'setting', 'failover_mode', 'manual'
UNION ALL SELECT 'setting', 'drift_threshold_psi', '0.25'
UNION ALL SELECT 'setting', 'performance_threshold_auc', '0.75'
UNION ALL SELECT 'audit', CAST(seq AS VARCHAR), action FROM (SELECT * FROM audit_trail ORDER BY seq DESC LIMIT 15)""",
       ["registry_models", "audit_trail"])
def registry_listing(t: Tables) -> DataFrame:
    settings = {"failover_mode": "manual", "drift_threshold_psi": "0.25", "performance_threshold_auc": "0.75"}
    return gv.registry_listing(b.registry_models(t), b.audit_trail(t), "m_0", settings)


@query("""SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ', ') AS states,
  count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY o_custkey""")
def list_columns(t: Tables) -> DataFrame:
    """A list column to text and back."""
    lists = t["orders"].groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderstatus")).alias("states"))
    text = flatten_list(lists, "states")
    sizes = split_list(text, "states").select(F.col("o_custkey").alias("key"), F.size("states").cast("bigint").alias("n"))
    return text.join(sizes, text.o_custkey == sizes.key).drop("key")


# ---- stored tables that several writers change

@query("""WITH brands AS (SELECT p_brand AS model_id, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS seq,
  round(avg(p_retailprice), 2) AS price FROM part GROUP BY p_brand)
SELECT model_id, CASE WHEN seq = (SELECT max(seq) FROM brands) THEN 'champion' ELSE 'challenger' END AS status,
  CASE WHEN seq = (SELECT min(seq) FROM brands) THEN 'champion' ELSE 'challenger' END AS first_status,
  price, 2 AS n_audit, TRUE AS refused FROM brands""")
def registry_commits(t: Tables) -> DataFrame:
    """Two writers who read the same registry: the one who commits second is refused, reads again, and both changes
    are in; the first document can still be read."""
    seq = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("bigint")
    brands = t["part"].groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 2).alias("price"))
    models = brands.select(F.col("p_brand").alias("model_id"), seq.alias("seq"),
                           F.create_map(F.lit("price"), "price").alias("baselines"))
    ends = models.agg(F.min("seq").alias("low"), F.max_by("model_id", "seq").alias("last")).first()
    models = models.withColumn("status", F.when(F.col("seq") == ends["low"], "champion").otherwise("challenger"))
    rules = t.spark.createDataFrame([], "seq bigint, model_id string")
    audit = t.spark.createDataFrame([], "seq bigint, timestamp string, triggered_by string, action string, "
                                        "evidence string, approved_by string")
    registry = Registry(t.spark, scratch_path(t.spark, "registry"))
    first = registry.commit({"models": models, "rule_models": rules, "audit": audit}, None)

    def promote(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        entry = gv.audit_entry(frames["audit"], "a", f"Hot-Swap completed: first -> {ends['last']}", "", "2024-01-01")
        return frames | {"models": gv.promote(frames["models"], ends["last"]), "audit": entry}

    def note(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return frames | {"audit": gv.audit_entry(frames["audit"], "b", "Reviewed", "", "2024-01-01")}

    read = registry.at(first)
    registry.update(promote)
    try:
        registry.commit(note(read), first)
        refused = False
    except Conflict:
        refused = True
        registry.update(note)
    now, before = registry.at(registry.newest()), registry.at(first)["models"]
    return now["models"].join(before.select("model_id", F.col("status").alias("first_status")), "model_id").select(
        "model_id", "status", "first_status", F.round(F.col("baselines")["price"], 2).alias("price"),
        F.lit(now["audit"].count()).alias("n_audit"), F.lit(refused).alias("refused"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 100 = 7 THEN 0.0 ELSE c_acctbal END AS c_acctbal, TRUE AS only_touched,
  TRUE AS once FROM customer
UNION ALL SELECT -c_custkey - 1, 0.0, TRUE, TRUE FROM customer WHERE c_custkey % 100 = 7""")
def merge_into_stored(t: Tables) -> DataFrame:
    """An upsert of one id in a hundred, and of as many new ones, into a stored table, made twice: the buckets it does
    not touch keep their files, and the second time changes nothing."""
    rows = t["customer"].select("c_custkey", "c_acctbal")
    table = MergeTable(t.spark, scratch_path(t.spark, "customers"), "c_custkey", rows.schema, buckets=256)
    loaded = table.merge(rows, "load", "c_acctbal")
    some = rows.where("c_custkey % 100 = 7").withColumn("c_acctbal", F.lit(0.0))
    some = some.unionByName(some.withColumn("c_custkey", -F.col("c_custkey") - 1))
    merged = table.merge(some, "correction", "c_acctbal")
    again = table.merge(some, "correction", "c_acctbal")
    before, after = (table.state(n)["buckets"] for n in (loaded, merged))
    touched = {str(r[0]) for r in some.select(F.pmod(F.xxhash64("c_custkey"), F.lit(256)).alias(BUCKET)).distinct().collect()}
    only = all((before.get(b) == folder) == (b not in touched) for b, folder in after.items())
    return table.read().select("c_custkey", "c_acctbal", F.lit(only).alias("only_touched"),
                               F.lit(again is None and table.state() == table.state(merged)).alias("once"))
