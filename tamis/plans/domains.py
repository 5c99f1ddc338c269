"""Queries that map source records of several domains, and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.functions import claims
from tamis.plans.registry import query
from tamis.sources import mappings

TRANSACTIONS = """WITH base AS (SELECT o_orderkey AS id, o_custkey, o_totalprice / 20 AS amount, CASE o_orderstatus WHEN 'F' THEN 'wire_transfer' WHEN 'O' THEN 'cash_deposit' ELSE 'card_purchase' END AS transaction_type, n_name AS country, o_orderpriority AS merchant, o_orderpriority = '5-LOW' AS is_recurring,
  count(*) OVER (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate) RANGE BETWEEN 31536000000000 PRECEDING AND CURRENT ROW) AS velocity_1h,
  row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1 AS is_first_time_merchant, row_number() OVER (PARTITION BY n_name, o_orderstatus ORDER BY o_orderdate, o_orderkey) = 1 AS is_first_time_country
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
typed AS (SELECT *, transaction_type = 'cash_deposit' AND amount >= 8000 AND amount < 10000 AS sub FROM base)
"""
FINANCE_SQL = (
    TRANSACTIONS
    + """SELECT id, CASE WHEN transaction_type = 'wire_transfer' AND is_first_time_country THEN 'wire_international_first' WHEN transaction_type = 'wire_transfer' THEN 'wire_transfer' WHEN sub THEN 'cash_deposit_sub_10k' WHEN velocity_1h >= 5 THEN 'rapid_transactions' WHEN is_recurring THEN 'recurring_charge' WHEN amount > 5000 THEN 'large_transaction' ELSE transaction_type || '_standard' END AS signal_type,
CASE WHEN is_first_time_country OR velocity_1h >= 5 OR amount > 10000 THEN 'high' WHEN velocity_1h >= 3 OR amount > 5000 OR (is_first_time_merchant AND (amount > 500 OR velocity_1h >= 2)) OR sub THEN 'medium' ELSE 'info' END AS severity FROM typed"""
)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions of accounts. Customers and nations are joined first, so that orders are joined once."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    people = read("customer").select("c_custkey", "c_nationkey").join(read("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = read("orders").join(people, F.col("o_custkey") == F.col("c_custkey")).withColumn("us", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    account = Window.partitionBy("o_custkey")
    new_merchant = F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")) == 1
    # countries are few and their transactions many: the first of each is a grouped minimum, not a window
    countries = rows.groupBy("n_name", "o_orderstatus").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("_first"))
    rows = rows.join(countries, ["n_name", "o_orderstatus"])
    status = F.col("o_orderstatus")
    kind = F.when(status == "F", "wire_transfer").when(status == "O", "cash_deposit").otherwise("card_purchase")
    return rows.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_totalprice") / 20).alias("amount"),
        kind.alias("transaction_type"),
        F.col("n_name").alias("country"),
        F.col("o_orderpriority").alias("merchant"),
        (F.col("o_orderpriority") == "5-LOW").alias("is_recurring"),
        F.count("*").over(account.orderBy("us").rangeBetween(-31_536_000_000_000, 0)).alias("velocity_1h"),
        new_merchant.alias("is_first_time_merchant"),
        (F.col("_first")["o_orderkey"] == F.col("o_orderkey")).alias("is_first_time_country"),
    )


@query("finance_mapping", FINANCE_SQL)
def finance_mapping(spark, sf_dir):
    return mappings.finance(transactions(spark, sf_dir)).select("id", "signal_type", "severity")


@query(
    "finance_messages",
    TRANSACTIONS
    + """, f AS (SELECT *, array_to_string(list_filter([CASE WHEN is_first_time_merchant THEN 'first-time merchant' END, CASE WHEN is_first_time_country THEN 'first-time country' END, CASE WHEN is_recurring THEN 'recurring' END, CASE WHEN velocity_1h >= 3 THEN 'velocity=' || velocity_1h || '/hr' END], lambda x: x IS NOT NULL), ', ') AS flags FROM typed)
    SELECT id, '$' || format('{:,.2f}', amount) || ' at ' || merchant || ' (' || transaction_type || ') in ' || country || CASE WHEN flags <> '' THEN ' [' || flags || ']' ELSE '' END AS message FROM f""",
)
def finance_messages(spark, sf_dir):
    return transactions(spark, sf_dir).select("id", mappings.finance_message().alias("message"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with columns that vary enough to reach every rule of a mapping."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "user_id", "value", F.expr("CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)").alias("k"))


RECORDS = "WITH r AS (SELECT event_id, event_type AS et, user_id, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)"


def _pick(key: str, *values: str) -> str:
    """The same choice by a number in both dialects."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else chr(39) + v + chr(39)}" for i, v in enumerate(values)) + " END"


_K8S = {"type": _pick("k", "pod", "event", "node", "pod", "volume"), "reason": _pick("user_id", "CrashLoopBackOff", "BackOff", "Unhealthy", ""), "phase": _pick("event_id", "Pending", "Running", "Failed", ""), "restarts": "CAST(value / 10 AS INT)", "ready": _pick("user_id", "True", "True", "False"), "memory_pressure": _pick("event_id", "False", "True", "False", "False", "False"), "disk_pressure": _pick("k", "False", "True")}
_HEALTH = {"event_type": _pick("k", "vital_signs", "lab_result", "medication"), "severity_flag": _pick("user_id", "critical", "compliance", "operational", "normal")}
_CLAIM = {"event_type": _pick("k", "claim_filed", "claim_filed", "policy_change", "licensing_gap", "sla_breach"), "amount": "value * 100", "description": _pick("event_id", "Staged collision", "ordinary repair", "Soft tissue claim", "storm damage")}
_RETAIL = {"event_type": _pick("k", "pos_sale", "pos_return"), "amount": "value", "label": _pick("user_id", "shrinkage", "", "operational", "compliance", "", "")}
_TELECOM = {"event_type": _pick("k", "outage", "alarm", "kpi"), "severity_level": _pick("user_id", "critical", "major", "customer", "normal", "compliance", "normal"), "affected_subscribers": "CAST(value * 100 AS INT)", "metric_value": "value", "threshold": "CAST(k AS DOUBLE)"}

_JOBS = {"kind": _pick("k", "job", "task", "activity"), "status": _pick("user_id", "error", "canceled", "warning", "runner_on_skipped", "delete", "update", ""), "failed": "event_id % 5 = 0", "name": _pick("event_id", "[Team A] prod deploy", "crit backup", "nightly", "[ops] sync"), "object1": _pick("k", "credential", "job template", "inventory")}
_APPS = {"health_status": _pick("k", "Degraded", "Healthy", "Progressing", "Healthy"), "sync_status": _pick("user_id", "Synced", "OutOfSync", "Synced"), "op_phase": _pick("event_id", "Failed", "Succeeded", "Succeeded", "Succeeded")}
_POOLS = {"available": "k % 4", "min_available": "CAST(user_id % 3 AS INT)"}
_JOBS_SQL = """SELECT event_id, CASE WHEN kind = 'job' AND status <> '' THEN 'job_' || status WHEN kind = 'job' THEN 'job_unknown' WHEN kind = 'task' THEN 'task_' || status ELSE lower(replace('config_' || status || '_' || object1, ' ', '_')) END AS signal_type,
CASE WHEN kind = 'job' AND failed AND (contains(lower(name), 'prod') OR contains(lower(name), 'crit')) THEN 'critical' WHEN kind = 'job' AND (failed OR status = 'error') THEN 'high' WHEN kind = 'job' AND status = 'canceled' THEN 'medium' WHEN kind = 'task' AND failed THEN 'high' WHEN kind = 'task' AND status = 'warning' THEN 'medium' WHEN kind = 'task' AND status = 'runner_on_skipped' THEN 'low' WHEN kind = 'activity' AND status = 'delete' AND object1 IN ('credential', 'inventory', 'project') THEN 'high' WHEN kind = 'activity' AND status = 'update' AND object1 IN ('credential', 'inventory') THEN 'medium' ELSE 'info' END AS severity FROM m"""
_APPS_SQL = "SELECT event_id, CASE WHEN health_status = 'Degraded' THEN 'app_degraded' WHEN sync_status = 'OutOfSync' THEN 'app_outofsync' WHEN op_phase = 'Failed' THEN 'sync_failed' WHEN health_status = 'Healthy' THEN 'app_synced' ELSE 'app_' || lower(health_status) END AS signal_type, CASE WHEN health_status = 'Degraded' THEN 'high' WHEN sync_status = 'OutOfSync' THEN 'medium' WHEN op_phase = 'Failed' THEN 'high' WHEN health_status = 'Healthy' THEN 'info' ELSE 'low' END AS severity FROM m"
_POOLS_SQL = "SELECT event_id, CASE WHEN min_available > 0 AND available = 0 THEN 'pool_exhausted' WHEN min_available > 0 AND available <= 1 THEN 'pool_low' ELSE 'pool_healthy' END AS signal_type, CASE WHEN min_available > 0 AND available = 0 THEN 'critical' WHEN min_available > 0 AND available <= 1 THEN 'high' ELSE 'info' END AS severity FROM m"
_K8S_SQL = """SELECT event_id, CASE WHEN type = 'pod' AND (reason = 'CrashLoopBackOff' OR restarts > 5) THEN 'pod_crashloop' WHEN type = 'pod' AND phase = 'Pending' THEN 'pod_pending' WHEN type = 'pod' AND phase <> '' THEN 'pod_' || lower(phase) WHEN type = 'pod' THEN 'pod_unknown' WHEN type = 'event' AND reason <> '' THEN 'event_' || lower(reason) WHEN type = 'event' THEN 'event_unknown' WHEN type = 'node' AND ready <> 'True' THEN 'node_notready' WHEN type = 'node' AND memory_pressure = 'True' THEN 'node_memory_pressure' WHEN type = 'node' AND disk_pressure = 'True' THEN 'node_disk_pressure' WHEN type = 'node' THEN 'node_healthy' ELSE type || '_unknown' END AS signal_type,
CASE WHEN type = 'event' THEN 'medium' WHEN type = 'pod' AND restarts > 10 THEN 'high' WHEN type = 'pod' AND restarts > 3 THEN 'medium' WHEN type = 'pod' AND phase = 'Pending' THEN 'low' WHEN type = 'node' AND ready <> 'True' THEN 'critical' WHEN type = 'node' AND memory_pressure = 'True' THEN 'high' ELSE 'info' END AS severity FROM m"""
_HEALTH_SQL = "SELECT event_id, CASE severity_flag WHEN 'critical' THEN 'critical_' WHEN 'compliance' THEN 'compliance_' WHEN 'operational' THEN 'ops_' ELSE '' END || event_type AS signal_type, CASE severity_flag WHEN 'critical' THEN 'critical' WHEN 'compliance' THEN 'high' WHEN 'operational' THEN 'medium' ELSE 'info' END AS severity FROM m"
_CLAIM_SQL = f"SELECT event_id, CASE WHEN event_type = 'claim_filed' AND amount > 25000 THEN 'large_claim' ELSE event_type END AS signal_type, CASE WHEN event_type = 'licensing_gap' THEN 'high' WHEN event_type = 'sla_breach' THEN 'medium' WHEN event_type = 'claim_filed' AND amount > 25000 THEN 'medium' WHEN event_type = 'claim_filed' AND regexp_matches(lower(description), '{mappings.CLAIM_WORDS}') THEN 'high' WHEN event_type = 'claim_filed' AND amount > 10000 THEN 'medium' ELSE 'info' END AS severity FROM m"
_RETAIL_SQL = "SELECT event_id, CASE WHEN event_type = 'pos_return' AND amount > 100 THEN 'high_value_return' ELSE event_type END AS signal_type, CASE WHEN label IN ('shrinkage', 'compliance') THEN 'high' WHEN label = 'operational' THEN 'medium' WHEN event_type = 'pos_return' AND amount > 200 THEN 'medium' ELSE 'info' END AS severity FROM m"
_TELECOM_SQL = "SELECT event_id, CASE WHEN event_type = 'outage' AND affected_subscribers > 10000 THEN 'major_outage' WHEN event_type = 'outage' THEN 'minor_outage' ELSE event_type END AS signal_type, CASE WHEN severity_level = 'critical' OR affected_subscribers > 10000 THEN 'critical' WHEN severity_level IN ('major', 'compliance') THEN 'high' WHEN severity_level = 'customer' THEN 'medium' WHEN threshold > 0 AND metric_value > threshold * 0.8 THEN 'low' ELSE 'info' END AS severity FROM m"


def _mapped(mapping, columns: dict[str, str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _records(spark, sf_dir).selectExpr("event_id", *(f"{sql.replace('event_type', 'et')} AS {name}" for name, sql in columns.items()))
        return mapping(rows).select("event_id", "signal_type", "severity")

    return run


for _name, _mapping, _columns, _sql in (("k8s_mapping", mappings.kubernetes, _K8S, _K8S_SQL), ("healthcare_mapping", mappings.healthcare, _HEALTH, _HEALTH_SQL), ("insurance_mapping", mappings.insurance, _CLAIM, _CLAIM_SQL), ("retail_mapping", mappings.retail, _RETAIL, _RETAIL_SQL), ("telecom_mapping", mappings.telecom, _TELECOM, _TELECOM_SQL), ("automation_mapping", mappings.automation, _JOBS, _JOBS_SQL), ("deployment_mapping", mappings.deployments, _APPS, _APPS_SQL), ("pool_mapping", mappings.pools, _POOLS, _POOLS_SQL)):
    # integers from doubles: both dialects must cut, not round
    _cut = {n: s.replace("CAST(value / 10 AS INT)", "CAST(floor(value / 10) AS INT)").replace("CAST(value * 100 AS INT)", "CAST(floor(value * 100) AS INT)") for n, s in _columns.items()}
    query(_name, f"{RECORDS}, m AS (SELECT event_id, " + ", ".join(f"{s} AS {n}" for n, s in _cut.items()) + f" FROM r) {_sql}")(_mapped(_mapping, _cut))

LINES = rf"""WITH lines AS (SELECT doc_id, CAST(u.i - 1 AS INT) AS pos, trim(l[u.i]) AS claim, source FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents) d, unnest(range(1, len(l) + 1)) AS u(i)),
c AS (SELECT * FROM lines WHERE length(claim) >= 20 AND NOT regexp_matches(claim, '{claims.SECRET}'))"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")


@query("claim_split", f"{LINES} SELECT doc_id, pos, substr(sha256(regexp_replace(lower(trim(claim)), '\\s+', ' ', 'g')), 1, 16) AS exact_hash FROM c")
def claim_split(spark, sf_dir):
    return claims.split(_docs(spark, sf_dir)).select("doc_id", "pos", claims.exact_hash(F.col("claim")).alias("exact_hash"))


_SQL_KIND = f"CASE WHEN regexp_matches(claim, '{claims.PREFERENCE.replace(chr(39), chr(39) * 2)}') THEN 'preference' WHEN regexp_matches(claim, '{claims.DECISION}') THEN 'decision' WHEN regexp_matches(claim, '{claims.CAVEAT}') THEN 'caveat' WHEN regexp_matches(claim, '{claims.FIGURE}') THEN 'fact' WHEN regexp_matches(claim, '{claims.RULE.replace(chr(39), chr(39) * 2)}') THEN 'rule' ELSE 'fact' END"


@query("claim_types", f"{LINES} SELECT kind, CASE kind WHEN 'rule' THEN 'critical' WHEN 'preference' THEN 'high' WHEN 'decision' THEN 'high' WHEN 'fact' THEN 'medium' WHEN 'caveat' THEN 'low' END AS severity, count(*) AS n FROM (SELECT {_SQL_KIND} AS kind FROM c) GROUP BY ALL")
def claim_types(spark, sf_dir):
    rows = claims.split(_docs(spark, sf_dir)).select(claims.kind(F.col("claim")).alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("n")).withColumn("severity", claims.severity(F.col("kind")))


@query("claim_near_duplicates", "WITH w AS (SELECT doc_id, source, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), t AS (SELECT doc_id, source, CASE WHEN len(w) >= 3 THEN array_to_string(list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda k: array_to_string(list_sort(w[k:k+2]), ' ')))), ',') ELSE regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') END AS s FROM w), h AS (SELECT source, substr(sha256(s), 1, 16) AS near_hash FROM t) SELECT near_hash, count(DISTINCT source) AS sources, count(*) AS n FROM h GROUP BY 1 HAVING count(DISTINCT source) >= 2")
def claim_near_duplicates(spark, sf_dir):
    """Texts alike but for the order of neighbours that stand in two sources or more."""
    rows = claims.near_hashed(_docs(spark, sf_dir))
    return rows.groupBy("near_hash").agg(F.count_distinct("source").alias("sources"), F.count("*").alias("n")).where("sources >= 2")


TOPICS = {"agreement": r"(?i)\b(licen[sc]ed?|license|rights reserved|copyright)\b", "figures": r"\d{3,}", "markup": r"[|#*$%&]{2,}", "time": r"(?i)\b(today|tomorrow|year|time)\b", "access": r"(?i)\b(token|password|key)\b"}


@query("institutional_topics", f"WITH t AS (SELECT source, unnest([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in sorted(TOPICS.items())) + "]) AS topic FROM documents) SELECT topic, count(DISTINCT source) AS sources, count(*) AS n FROM t WHERE topic IS NOT NULL GROUP BY topic HAVING count(DISTINCT source) >= 3")
def institutional_topics(spark, sf_dir):
    """Topics that three sources or more write about."""
    rows = _docs(spark, sf_dir).select("source", F.explode(claims.topics(F.col("text"), TOPICS)).alias("topic"))
    return rows.groupBy("topic").agg(F.count_distinct("source").alias("sources"), F.count("*").alias("n")).where("sources >= 3")


@query("workload_claims", "WITH d AS (SELECT role, count(*) AS n FROM conversations GROUP BY role), t AS (SELECT sum(n) AS total FROM d) SELECT role, n, CAST(n * 100 // total AS BIGINT) AS pct FROM d, t WHERE n * 100 >= total * 5")
def workload_claims(spark, sf_dir):
    """Shares of at least five percent, floored."""
    counts = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("role").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).where("n * 100 >= total * 5").select("role", "n", F.expr("n * 100 div total").alias("pct"))
