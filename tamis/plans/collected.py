"""Queries that map records of work systems, storage, sandboxes, workstations and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.plans.domains import RECORDS, _pick, _records
from tamis.plans.registry import query
from tamis.sources import readers, work
from tamis.sources.collectors import Collected
from tamis.sources.adapters import SIGNALS_SQL, event_signals


def _with(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    rows = _records(spark, sf_dir)
    return rows.selectExpr("event_id", *(f"{sql.replace('VARCHAR', 'STRING')} AS {name}" for name, sql in columns.items()))


def _records_sql(columns: dict[str, str]) -> str:
    return f"{RECORDS}, m AS (SELECT event_id, " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + " FROM r)"


def _cases(*pairs: tuple[str, str]) -> str:
    """One CASE for each output column: pairs of a test and values of signal_type, severity, topic, message, in SQL."""
    out = []
    for k, name in enumerate(("signal_type", "severity", "topic", "message")):
        out.append("CASE " + " ".join(f"WHEN {test} THEN {values[k]}" for test, values in pairs) + f" END AS {name}")
    return ", ".join(out)


# ---------------------------------------------------------------- issues

_ISSUE = {
    "key": "'PRJ-' || CAST(event_id AS VARCHAR)",
    "summary": _pick("k", "slow page", "wrong total", "add export"),
    "status": _pick("k", "Open", "Reopened", "In Progress", "Done", "reopen", "Open", "Closed"),
    "priority": _pick("user_id", "Blocker", "Critical", "Major", "Minor", "Trivial", "Someday"),
    "issue_type": _pick("event_id", "Bug", "Story", "Task"),
    "label": _pick("event_id", "runbook", "ui", "api", "docs-needed", "ui", "ops", "ui"),
    "comment_count": "CAST(floor(value / 10) AS INT)",
    "seen": "event_id % 4 = 0",
}
_SAID = ("is this the right form?", "fixed", "why does it fail on restart?", "see above")
_ISSUES_SQL = (
    _records_sql(_ISSUE)
    + """, state AS (SELECT event_id, """
    + _cases(
        ("lower(status) IN ('reopened', 'reopen')", ("'incident_repeat'", "CASE WHEN priority IN ('Critical', 'Blocker') THEN 'high' ELSE 'medium' END", "'incident_repeat'", "key || ' reopened: ' || summary")),
        ("comment_count > 15", ("'decision_revisited'", "'medium'", "'decision_churn'", "key || ' has ' || comment_count || ' comments — possible decision churn: ' || summary")),
        ("label IN ('documentation', 'docs-needed', 'knowledge-gap', 'runbook')", ("'documentation_gap'", "'medium'", "'documentation'", "key || ' flagged for documentation: ' || summary")),
        ("issue_type = 'Bug' AND priority IN ('Critical', 'Blocker')", ("'hotfix_pattern'", "'high'", "'hotfix'", "key || ' critical bug: ' || summary")),
        ("NOT seen", ("'issue_' || replace(lower(status), ' ', '_')", "CASE priority WHEN 'Blocker' THEN 'critical' WHEN 'Critical' THEN 'high' WHEN 'Major' THEN 'medium' WHEN 'Minor' THEN 'low' ELSE 'info' END", "lower(issue_type)", "key || ' [' || status || '] ' || summary")),
    )
    + f""" FROM m),
said AS (SELECT event_id, key, u.i AS i, ({list(_SAID)!r})[u.i] AS body, CAST(event_id % 5 AS INT) AS n FROM m, unnest([1, 2, 3, 4]) AS u(i))
SELECT event_id, signal_type, severity, topic, message FROM state WHERE signal_type IS NOT NULL
UNION ALL SELECT event_id, 'onboarding_question', 'low', 'onboarding', 'Ann asks on ' || key || ': ' || body FROM said WHERE i <= n AND i > n - 3 AND contains(body, '?')"""
)


@query("issue_signals", _ISSUES_SQL)
def issue_signals(spark, sf_dir):
    rows = _with(spark, sf_dir, _ISSUE).withColumn("labels", F.array("label"))
    plain = [F.lit(x) for x in _SAID]
    rich = F.format_string('{"content": [{"content": [{"type": "text", "text": "%s"}, {"type": "mention"}]}]}', F.lit(_SAID[2]))
    plain[2] = rich
    comments = F.array(*(F.struct(F.lit("Ann").alias("author"), body.alias("body")) for body in plain))
    rows = rows.withColumn("comments", F.slice(comments, F.lit(1), (F.col("event_id") % 5).cast("int")))
    return work.issues(rows).select("event_id", "signal_type", "severity", "topic", "message")


# ---------------------------------------------------------------- commits, pull requests, pages

_COMMIT = {
    "repo": _pick("user_id", "org/app", "org/lib"),
    "author": _pick("k", "ann", "bob", "cho"),
    "message": _pick("event_id", "Revert the cache", "Update README", "Refactor parser", "urgent fix", "Bump version"),
    "files_changed": "CAST(floor(value / 2) AS INT)",
}
_COMMITS_SQL = (
    _records_sql(_COMMIT)
    + " SELECT event_id, "
    + _cases(
        ("regexp_matches(lower(message), 'hotfix|revert|emergency|urgent')", ("'hotfix_pattern'", "'high'", "'hotfix'", "author || ' hotfix in ' || repo || ': ' || message")),
        ("regexp_matches(lower(message), 'doc|readme|changelog|runbook')", ("'documentation_update'", "'low'", "'documentation'", "author || ' docs update in ' || repo || ': ' || message")),
        ("files_changed > 50", ("'large_commit'", "'medium'", "'code_change'", "author || ' large commit (' || files_changed || ' files) in ' || repo || ': ' || message")),
        ("true", ("'regular_commit'", "'info'", "'code_change'", "author || ' commit in ' || repo || ': ' || message")),
    )
    + " FROM m"
)


@query("commit_signals", _COMMITS_SQL)
def commit_signals(spark, sf_dir):
    rows = _with(spark, sf_dir, _COMMIT).withColumn("message", F.concat("message", F.lit("\n\nmore about it")))
    return work.commits(rows).select("event_id", "signal_type", "severity", "topic", "message")


_PULL = {
    "ref": "'org/app#' || CAST(event_id AS VARCHAR)",
    "author": _pick("k", "ann", "bob", "cho"),
    "title": _pick("event_id", "Split module", "Add cache"),
    "state": _pick("k", "open", "closed", "closed"),
    "merged": "k % 3 = 1",
    "review_comments": "CAST(floor(value / 10) AS INT)",
    "comments": "CAST(user_id % 7 AS INT)",
}
_PULLS_SQL = (
    _records_sql(_PULL)
    + " SELECT event_id, "
    + _cases(
        ("review_comments + comments > 20", ("'decision_revisited'", "'medium'", "'decision_churn'", "'PR ' || ref || ' has ' || (review_comments + comments) || ' comments — possible design churn: ' || title")),
        ("review_comments > 10", ("'code_review_repeat'", "'medium'", "'code_review'", "'PR ' || ref || ' heavy review (' || review_comments || ' review comments): ' || title")),
        ("merged", ("'pr_merged'", "'info'", "'code_change'", "author || ' merged ' || ref || ': ' || title")),
        ("state = 'closed'", ("'pr_abandoned'", "'low'", "'code_change'", "author || ' closed ' || ref || ' without merge: ' || title")),
        ("true", ("'pr_open'", "'info'", "'code_change'", "author || ' opened ' || ref || ': ' || title")),
    )
    + " FROM m"
)


@query("pull_request_signals", _PULLS_SQL)
def pull_request_signals(spark, sf_dir):
    return work.pull_requests(_with(spark, sf_dir, _PULL)).select("event_id", "signal_type", "severity", "topic", "message")


_PAGE = {
    "page_id": "CAST(event_id AS VARCHAR)",
    "title": _pick("event_id", "Restore Runbook", "Postmortem of May", "New hire week", "Architecture of search", "Lunch menu", "SOP for keys"),
    "space": _pick("user_id", "OPS", "DEV"),
    "author": _pick("k", "ann", "bob"),
    "version": "1 + CAST(floor(value / 12) AS INT)",
}
_PAGES_SQL = (
    _records_sql(_PAGE)
    + " SELECT event_id, "
    + _cases(
        ("version > 20", ("'runbook_decay'", "'medium'", "'runbook'", "'''' || title || ''' in ' || space || ' has ' || version || ' versions — frequent revision suggests instability'")),
        ("regexp_matches(lower(title), 'runbook|playbook|sop|procedure|troubleshoot') AND version = 1", ("'documentation_gap'", "'medium'", "'documentation'", "'Runbook ''' || title || ''' in ' || space || ' created but never updated (v1)'")),
        ("regexp_matches(lower(title), 'runbook|playbook|sop|procedure|troubleshoot')", ("'runbook_update'", "'low'", "'runbook'", "author || ' updated runbook ''' || title || ''' in ' || space || ' (v' || version || ')'")),
        ("regexp_matches(lower(title), 'postmortem|post-mortem|incident|rca|root cause')", ("'incident_learning'", "'medium'", "'incident_learning'", "'Incident doc ''' || title || ''' in ' || space || ' by ' || author")),
        ("regexp_matches(lower(title), 'onboarding|getting started|new hire|setup guide')", ("'onboarding_doc'", "'low'", "'onboarding'", "'Onboarding doc ''' || title || ''' in ' || space || ' updated by ' || author || ' (v' || version || ')'")),
        ("regexp_matches(lower(title), 'architecture|design|adr|decision') AND version > 5", ("'decision_revisited'", "'medium'", "'architecture'", "'Architecture doc ''' || title || ''' revised ' || version || ' times — possible design churn'")),
        ("regexp_matches(lower(title), 'architecture|design|adr|decision')", ("'architecture_update'", "'low'", "'architecture'", "author || ' updated architecture doc ''' || title || ''' in ' || space")),
        ("true", ("'page_updated'", "'info'", "'documentation'", "author || ' updated ''' || title || ''' in ' || space || ' (v' || version || ')'")),
    )
    + " FROM m"
)


@query("wiki_page_signals", _PAGES_SQL)
def wiki_page_signals(spark, sf_dir):
    return work.wiki_pages(_with(spark, sf_dir, _PAGE)).select("event_id", "signal_type", "severity", "topic", "message")


# ---------------------------------------------------------------- storage

_STORE = {
    "kind": _pick("event_id", "CephCluster", "CephBlockPool", "CephFilesystem", "StorageCluster", "Pod", "PersistentVolumeClaim", "PersistentVolume"),
    "name": "'s' || CAST(event_id AS VARCHAR)",
    "health": _pick("k", "HEALTH_OK", "HEALTH_WARN", "HEALTH_ERR"),
    "phase": _pick("user_id", "Running", "Error", "Failed", "Progressing", "Pending", "Lost", "Ready", "Running"),
    "degraded": "k % 4 = 1",
    "restarts": "CAST(user_id % 9 AS INT)",
    "waiting": _pick("k", "CrashLoopBackOff", "ContainerCreating", "", "", ""),
}
_OF = "kind = '{}' AND ({})"
_STORAGE_RULES = [
    ("CephCluster", "health = 'HEALTH_ERR'", "ceph_health_err", "critical"), ("CephCluster", "health = 'HEALTH_WARN'", "ceph_health_warn", "medium"), ("CephCluster", "true", "ceph_health_ok", "info"),
    ("CephBlockPool", "phase IN ('Failure', 'Failed')", "blockpool_failure", "critical"), ("CephBlockPool", "phase = 'Progressing'", "blockpool_progressing", "medium"), ("CephFilesystem", "phase IN ('Failure', 'Failed')", "cephfs_failure", "critical"),
    ("StorageCluster", "phase = 'Error'", "storagecluster_error", "critical"), ("Pod", "waiting = 'CrashLoopBackOff'", "osd_crashloop", "critical"), ("Pod", "phase <> 'Running'", "osd_not_running", "critical"), ("Pod", "restarts + 1 > 3", "osd_high_restarts", "high"),
    ("PersistentVolumeClaim", "phase = 'Pending'", "pvc_pending", "medium"), ("PersistentVolumeClaim", "phase = 'Lost'", "pvc_lost", "critical"), ("PersistentVolume", "phase = 'Failed'", "pv_failed", "critical"),
]
_STORAGE_SQL = (
    _records_sql(_STORE)
    + ", s AS (SELECT event_id, CASE "
    + " ".join(f"WHEN {_OF.format(kind, test)} THEN '{what}'" for kind, test, what, _ in _STORAGE_RULES)
    + " END AS signal_type, CASE "
    + " ".join(f"WHEN {_OF.format(kind, test)} THEN '{level}'" for kind, test, _, level in _STORAGE_RULES)
    + """ END AS severity FROM m) SELECT * FROM s WHERE signal_type IS NOT NULL
UNION ALL SELECT event_id, 'ceph_phase_error', 'critical' FROM m WHERE kind = 'CephCluster' AND phase = 'Error'
UNION ALL SELECT event_id, 'storagecluster_degraded', 'high' FROM m WHERE kind = 'StorageCluster' AND degraded"""
)


@query("storage_signals", _STORAGE_SQL)
def storage_signals(spark, sf_dir):
    rows = _with(spark, sf_dir, _STORE)
    state = F.struct(F.lit("Degraded").alias("type"), F.when(F.col("degraded"), "True").otherwise("False").alias("status"))
    pods = F.array(F.struct("restarts", "waiting"), F.struct(F.lit(1).alias("restarts"), F.lit(None).cast("string").alias("waiting")))
    rows = rows.withColumns({"conditions": F.array(state), "containers": pods})
    return work.storage(rows).select("event_id", "signal_type", "severity")


# ---------------------------------------------------------------- gauges

_GAUGES_SQL = f"""{RECORDS}, g AS (SELECT 'c' || (event_id % 500) AS cluster, max(k % 6)::BIGINT AS free FROM r WHERE event_id % 3 = 0 GROUP BY 1),
most AS (SELECT 'c' || (event_id % 500) AS cluster, max(k % 9)::BIGINT AS most FROM r WHERE event_id % 5 = 0 GROUP BY 1),
one AS (SELECT CAST(floor(value) AS BIGINT) AS v, event_id % 2 = 0 AS queue FROM r)
SELECT CASE WHEN queue THEN 'sandbox_queue_depth' ELSE 'sandbox_db_connections' END AS signal_type, CASE WHEN queue AND v > 50 THEN 'critical' WHEN queue AND v > 20 THEN 'high' WHEN queue THEN 'medium' WHEN v > 50 THEN 'high' WHEN v > 30 THEN 'medium' ELSE 'info' END AS severity,
CASE WHEN queue THEN 'Sandbox queue: ' || v || ' placements queued' ELSE 'Sandbox DB: ' || v || ' active connections' END AS message FROM one WHERE NOT queue OR v > 0
UNION ALL SELECT CASE WHEN free = 0 THEN 'sandbox_ratelimit_exhausted' ELSE 'sandbox_ratelimit_low' END, CASE WHEN free = 0 THEN 'critical' ELSE 'high' END,
CASE WHEN free = 0 THEN 'Ratelimit exhausted on ' ELSE 'Ratelimit low on ' END || cluster || ': ' || free || '/' || most || ' slots' FROM g LEFT JOIN most USING (cluster) WHERE most > 0 AND free <= 2"""


@query("sandbox_gauges", _GAUGES_SQL)
def sandbox_gauges(spark, sf_dir):
    """Free slots beside the most slots of each cluster."""
    rows = _records(spark, sf_dir)
    cluster = F.concat(F.lit("c"), (F.col("event_id") % 500).cast("string")).alias("cluster")
    gauge = lambda name, test, value: rows.where(test).groupBy(cluster).agg(F.max(value).cast("double").alias("value")).select(F.lit(name).alias("name"), "cluster", "value")
    single = rows.select(F.when(F.col("event_id") % 2 == 0, "sandbox_queued_placements_total").otherwise("sandbox_pg_connections_active").alias("name"), F.lit("").alias("cluster"), F.floor("value").cast("double").alias("value"))
    metrics = single.unionByName(gauge("sandbox_ratelimit_available_slots", "event_id % 3 = 0", F.col("k") % 6)).unionByName(gauge("sandbox_ratelimit_max", "event_id % 5 = 0", F.col("k") % 9))
    return work.sandbox_gauges(metrics).select("signal_type", "severity", "message")


_DESK = {
    "what": _pick("event_id", "switches", "load", "memory", "connections", "process"),
    "name": _pick("k", "editor", "browser"),
    "value": "floor(value)",
    "of": "CASE event_id % 5 WHEN 1 THEN 80 ELSE 160 END",
}
_DESK_SQL = (
    _records_sql(_DESK)
    + """, p AS (SELECT *, CAST(round(value / "of" * 100) AS BIGINT) AS share, CAST(value AS BIGINT) AS v FROM m), s AS (SELECT event_id, """
    + _cases(
        ("what = 'switches' AND v > 20", ("'high_context_switching'", "'medium'", "'focus'", "v || ' app switches in 5 minutes'")),
        ("what = 'load'", ("'system_load'", "CASE WHEN share > 90 THEN 'high' WHEN share > 70 THEN 'medium' ELSE 'info' END", "'system'", """'System load: ' || share || '% of ' || "of" || ' cores'""")),
        ("what = 'memory'", ("'memory_usage'", "CASE WHEN share > 90 THEN 'high' WHEN share > 80 THEN 'medium' ELSE 'info' END", "'system'", "'Memory: ' || share || '% used'")),
        ("what = 'connections'", ("'network_connections'", "CASE WHEN v > 100 THEN 'medium' ELSE 'info' END", "'network'", "v || ' established connections'")),
        ("what = 'process' AND v > 50", ("'high_cpu_process'", "'medium'", "'system'", "name || ' using ' || v || '% CPU'")),
    )
    + " FROM p) SELECT * FROM s WHERE signal_type IS NOT NULL"
).replace(" AS of", ' AS "of"')


@query("workstation_signals", _DESK_SQL)
def workstation_signals(spark, sf_dir):
    return work.workstation(_with(spark, sf_dir, _DESK)).select("event_id", "signal_type", "severity", "topic", "message")


_SAMPLE = {"metric": _pick("event_id", *(x[0] for x in work.HEALTH_QUERIES)), "value": _pick("user_id", "0", "1", "0.86", "0.95", "12", "0.05")}
_HEALTH_SQL = (
    _records_sql(_SAMPLE)
    + ", q AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{m}', '{t}', {x}::DOUBLE, '{s}', '{v}')" for m, t, x, s, v in work.HEALTH_QUERIES)
    + ") AS q(metric, test, threshold, signal_type, severity)) SELECT event_id, signal_type, severity FROM m JOIN q USING (metric) WHERE CASE test WHEN '>' THEN value::DOUBLE > threshold ELSE value::DOUBLE = threshold END"
)


@query("metric_health", _HEALTH_SQL)
def metric_health(spark, sf_dir):
    rows = _with(spark, sf_dir, _SAMPLE).withColumn("value", F.col("value").cast("double"))
    return work.metric_health(rows).select("event_id", "signal_type", "severity")


# ---------------------------------------------------------------- automation, alerts, other forms

_TASKS_SQL = """WITH e AS (SELECT event_id AS id, CASE user_id % 4 WHEN 0 THEN 'playbook_on_start' WHEN 1 THEN 'runner_on_ok' WHEN 2 THEN 'runner_on_failed' ELSE 'runner_on_start' END AS event, user_id % 40 AS job_id FROM events),
j AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey <= 30)
SELECT e.id, event, job_id, coalesce(name, '') AS job_name FROM (SELECT * FROM e WHERE id > 100 AND event NOT IN ('playbook_on_start', 'playbook_on_play_start', 'playbook_on_task_start', 'runner_on_start', 'playbook_on_include') ORDER BY id LIMIT 2000) e LEFT JOIN j ON job_id = j.id"""


@query("task_events", _TASKS_SQL)
def task_events(spark, sf_dir):
    """A page of events past a high-water mark, with their jobs; the page is the feature."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS id", "CASE user_id % 4 WHEN 0 THEN 'playbook_on_start' WHEN 1 THEN 'runner_on_ok' WHEN 2 THEN 'runner_on_failed' ELSE 'runner_on_start' END AS event", "user_id % 40 AS job_id")
    jobs = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey <= 30").selectExpr("c_custkey AS id", "c_name AS name")
    return work.task_events(events, jobs, 100).select("id", "event", "job_id", "job_name")


@query("activity_stream", "SELECT event_id AS id, CASE user_id % 3 WHEN 0 THEN 'o_auth2_access_token' WHEN 1 THEN 'credential' END AS object1 FROM events WHERE event_id > 50 AND user_id % 3 <> 0 ORDER BY id LIMIT 500")
def activity_stream(spark, sf_dir):
    stream = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS id", "CASE user_id % 3 WHEN 0 THEN 'o_auth2_access_token' WHEN 1 THEN 'credential' END AS object1")
    return work.activity(stream, 50)


@query("new_alerts", "SELECT DISTINCT user_id AS fingerprint FROM events WHERE event_id % 2 = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 0)")
def new_alerts(spark, sf_dir):
    """Alerts that the poll before didn't have."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id % 2 = 0 AS earlier", "user_id AS fingerprint")
    return readers.new_rows(rows.where("not earlier"), rows.where("earlier"), "fingerprint").select("fingerprint").distinct()


_FED = {"signal_type": "p_type", "source": "p_brand", "namespace": "p_size", "message": "p_name"}


@query("fed_records", "SELECT p_partkey, p_type AS signal_type, '' AS severity, p_brand AS source, CAST(p_size AS VARCHAR) AS namespace, '' AS cluster, p_name AS message FROM part")
def fed_records(spark, sf_dir):
    rows = work.fed(spark.read.parquet(f"{sf_dir}/part.parquet"), _FED)
    return rows.select("p_partkey", "signal_type", "severity", "source", "namespace", "cluster", "message")


@query("prompt_texts", f"WITH {SIGNALS_SQL} SELECT signal_id, concat_ws(chr(10), 'Type: ' || signal_type, 'Severity: ' || severity, 'Source: ' || source, 'Namespace: ' || namespace, 'message: ' || message, 'label: ' || nullif(label, '')) AS prompt FROM signals")
def prompt_texts(spark, sf_dir):
    return event_signals(spark, sf_dir).select("signal_id", work.prompt_text(("message", "label")).alias("prompt"))


@query("collected_events", "SELECT event_id, event_type, user_id, value FROM events WHERE event_id >= 2000 AND value < 120")
def collected_events(spark, sf_dir):
    """Events through a collector, in parts of 20,000 records, with what is asked for pushed to it."""
    spark.dataSource.register(Collected)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = spark.read.format("collected").option("collector", "tamis.sources.collectors:Files").option("path", f"{sf_dir}/events.parquet").option("columns", "event_id,event_type,user_id,value").option("rows", 20_000)
    return source.load().where("event_id >= 2000 AND value < 120")
