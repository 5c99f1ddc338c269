"""Records of work systems, storage, sandboxes, workstations and metrics as signals.

Each mapping takes a DataFrame of records, as they land in JSON files, and returns signals: the record's own columns and
signal_type, severity, message, topic. A record may give none, one or several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.sources.mappings import _cases

# Severities by an issue's priority, and words in labels, commits and titles that decide on a type.
PRIORITY_SEVERITY = {"Blocker": "critical", "Critical": "high", "Major": "medium", "Minor": "low", "Trivial": "info"}
DOC_LABELS = ("documentation", "docs-needed", "knowledge-gap", "runbook")
HOTFIX_WORDS = "hotfix|revert|emergency|urgent"
DOC_WORDS = "doc|readme|changelog|runbook"
RUNBOOK_TITLES = "runbook|playbook|sop|procedure|troubleshoot"
INCIDENT_TITLES = "postmortem|post-mortem|incident|rca|root cause"
ONBOARDING_TITLES = "onboarding|getting started|new hire|setup guide"
DESIGN_TITLES = "architecture|design|adr|decision"
# Metric queries whose results are signals: metric, comparison, threshold, type, severity.
HEALTH_QUERIES = (
    ("pod_restarts", ">", 10.0, "metric_pod_high_restarts", "medium"),
    ("oom_kills", ">", 0.0, "metric_container_oom", "high"),
    ("cpu_saturation", ">", 0.8, "metric_node_cpu_saturated", "medium"),
    ("pvc_filling", ">", 0.85, "metric_pvc_nearly_full", "medium"),
    ("node_memory", ">", 0.9, "metric_node_memory_exhausted", "critical"),
    ("api_latency", ">", 1.0, "metric_api_server_slow", "medium"),
    ("etcd_latency", ">", 0.1, "metric_etcd_slow_commits", "medium"),
    ("pending_pods", ">", 0.0, "metric_pod_stuck_pending", "medium"),
    ("node_disk_pressure", "=", 1.0, "metric_node_disk_pressure", "critical"),
    ("node_memory_pressure", "=", 1.0, "metric_node_memory_pressure", "high"),
    ("node_not_ready", "=", 0.0, "metric_node_notready", "critical"),
)
# Events of automation jobs, and objects of its activity stream, that say nothing.
SKIPPED_EVENTS = (
    "playbook_on_start", "playbook_on_play_start", "playbook_on_task_start", "runner_on_start", "playbook_on_include",
)
SKIPPED_OBJECTS = ("o_auth2_access_token",)


def _signal(kind: Column | str, severity: Column | str, topic: Column | str, message: Column) -> Column:
    plain = lambda x: x if isinstance(x, Column) else F.lit(x)
    names = ("signal_type", "severity", "topic", "message")
    return F.struct(*(plain(c).alias(n) for n, c in zip(names, (kind, severity, topic, message), strict=True)))


def _text(*parts: Column | str) -> Column:
    """Parts in one text; a null part is empty. Strings are literal."""
    return F.concat(*(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))


def _first(*cases: tuple[Column, Column]) -> Column:
    """The first signal whose test holds, else null."""
    found = F
    for test, signal in cases:
        found = found.when(F.coalesce(test, F.lit(False)), signal)
    return found


def _exploded(rows: DataFrame, signals: Column) -> DataFrame:
    return rows.withColumn("_s", F.explode(signals)).select(*(F.col(f"`{c}`") for c in rows.columns), "_s.*")


# ---------------------------------------------------------------- work systems


def document_text(body: Column) -> Column:
    """Plain text of a comment's body: a JSON document's text nodes joined by spaces, or the text itself."""
    shape = "struct<content:array<struct<content:array<struct<type:string,text:string>>>>>"
    nodes = F.flatten(F.transform(F.from_json(body, shape)["content"], lambda n: F.coalesce(n["content"], F.array())))
    texts = F.transform(F.filter(nodes, lambda x: x["type"] == "text"), lambda x: F.coalesce(x["text"], F.lit("")))
    return F.when(F.startswith(F.ltrim(body), F.lit("{")), F.coalesce(F.array_join(texts, " "), F.lit(""))).otherwise(body)


def issues(rows: DataFrame) -> DataFrame:
    """Of issues (key, summary, status, priority, issue_type, labels, comment_count, comments, seen): what their state
    says, and the questions among the last three comments (author, body)."""
    c, priority, status = F.col, F.coalesce("priority", F.lit("")), F.coalesce("status", F.lit(""))
    grave, kind = priority.isin("Critical", "Blocker"), F.lower(F.coalesce("issue_type", F.lit("")))
    by_priority = _cases(*((priority == p, s) for p, s in PRIORITY_SEVERITY.items()))
    state = F.concat(F.lit("issue_"), F.replace(F.lower(status), F.lit(" "), F.lit("_")))
    main = _first(
        (F.lower(status).isin("reopened", "reopen"), _signal("incident_repeat", F.when(grave, "high").otherwise("medium"), "incident_repeat", _text(c("key"), " reopened: ", c("summary")))),
        (c("comment_count") > 15, _signal("decision_revisited", "medium", "decision_churn", _text(c("key"), " has ", c("comment_count"), " comments — possible decision churn: ", c("summary")))),
        (F.arrays_overlap("labels", F.array(*map(F.lit, DOC_LABELS))), _signal("documentation_gap", "medium", "documentation", _text(c("key"), " flagged for documentation: ", c("summary")))),
        ((kind == "bug") & grave, _signal("hotfix_pattern", "high", "hotfix", _text(c("key"), " critical bug: ", c("summary")))),
        (~F.coalesce("seen", F.lit(False)), _signal(state, by_priority, kind, _text(c("key"), " [", status, "] ", c("summary")))),
    )
    said = F.coalesce("comments", F.array())
    last = F.slice(said, F.greatest(F.lit(1), F.size(said) - 2), F.lit(3))
    body = lambda x: F.substring(F.coalesce(document_text(x["body"]), F.lit("")), 1, 200)
    asks = F.filter(last, lambda x: F.contains(body(x), F.lit("?")) & (F.length(body(x)) < 150))
    asked = F.transform(asks, lambda x: _signal("onboarding_question", "low", "onboarding", _text(F.coalesce(x["author"], F.lit("?")), " asks on ", c("key"), ": ", body(x))))
    return _exploded(rows, F.concat(F.array_compact(F.array(main)), asked))


def commits(rows: DataFrame) -> DataFrame:
    """Of commits (sha, repo, author, message, files_changed); the message's first line counts."""
    c, line = F.col, F.substring(F.element_at(F.split(F.coalesce("message", F.lit("")), "\n"), 1), 1, 200)
    low, about = F.lower(line), lambda what: _text(c("author"), what, c("repo"), ": ", line)
    signal = _first(
        (low.rlike(HOTFIX_WORDS), _signal("hotfix_pattern", "high", "hotfix", about(" hotfix in "))),
        (low.rlike(DOC_WORDS), _signal("documentation_update", "low", "documentation", about(" docs update in "))),
        (c("files_changed") > 50, _signal("large_commit", "medium", "code_change", _text(c("author"), " large commit (", c("files_changed"), " files) in ", c("repo"), ": ", line))),
        (F.lit(True), _signal("regular_commit", "info", "code_change", about(" commit in "))),
    )
    return rows.select(*(F.col(f"`{x}`") for x in rows.columns if x != "message"), signal.alias("_s")).select("*", "_s.*").drop("_s")


def pull_requests(rows: DataFrame) -> DataFrame:
    """Of pull requests (ref, author, title, state, merged, review_comments, comments)."""
    c, all_comments = F.col, F.coalesce("review_comments", F.lit(0)) + F.coalesce("comments", F.lit(0))
    title = F.substring(F.coalesce("title", F.lit("")), 1, 200)
    signal = _first(
        (all_comments > 20, _signal("decision_revisited", "medium", "decision_churn", _text("PR ", c("ref"), " has ", all_comments, " comments — possible design churn: ", title))),
        (c("review_comments") > 10, _signal("code_review_repeat", "medium", "code_review", _text("PR ", c("ref"), " heavy review (", c("review_comments"), " review comments): ", title))),
        (c("merged"), _signal("pr_merged", "info", "code_change", _text(c("author"), " merged ", c("ref"), ": ", title))),
        (c("state") == "closed", _signal("pr_abandoned", "low", "code_change", _text(c("author"), " closed ", c("ref"), " without merge: ", title))),
        (F.lit(True), _signal("pr_open", "info", "code_change", _text(c("author"), " opened ", c("ref"), ": ", title))),
    )
    return _exploded(rows, F.array(signal))


def wiki_pages(rows: DataFrame) -> DataFrame:
    """Of pages of a wiki (page_id, title, space, author, version), each once."""
    c, low, version = F.col, F.lower(F.coalesce("title", F.lit(""))), F.coalesce("version", F.lit(1))
    runbook = low.rlike(RUNBOOK_TITLES)
    named = lambda what, end="": _text(c("author"), what, c("title"), "' in ", c("space"), end)
    numbered = lambda what: _text(c("author"), what, c("title"), "' in ", c("space"), " (v", version, ")")
    signal = _first(
        (version > 20, _signal("runbook_decay", "medium", "runbook", _text("'", c("title"), "' in ", c("space"), " has ", version, " versions — frequent revision suggests instability"))),
        (runbook & (version == 1), _signal("documentation_gap", "medium", "documentation", _text("Runbook '", c("title"), "' in ", c("space"), " created but never updated (v1)"))),
        (runbook, _signal("runbook_update", "low", "runbook", numbered(" updated runbook '"))),
        (low.rlike(INCIDENT_TITLES), _signal("incident_learning", "medium", "incident_learning", _text("Incident doc '", c("title"), "' in ", c("space"), " by ", c("author")))),
        (low.rlike(ONBOARDING_TITLES), _signal("onboarding_doc", "low", "onboarding", _text("Onboarding doc '", c("title"), "' in ", c("space"), " updated by ", c("author"), " (v", version, ")"))),
        (low.rlike(DESIGN_TITLES) & (version > 5), _signal("decision_revisited", "medium", "architecture", _text("Architecture doc '", c("title"), "' revised ", version, " times — possible design churn"))),
        (low.rlike(DESIGN_TITLES), _signal("architecture_update", "low", "architecture", named(" updated architecture doc '"))),
        (F.lit(True), _signal("page_updated", "info", "documentation", numbered(" updated '"))),
    )
    return _exploded(rows.dropDuplicates(["page_id"]), F.array(signal))


# ---------------------------------------------------------------- storage


def storage(rows: DataFrame) -> DataFrame:
    """Of storage objects (kind, name, health, phase, conditions, containers): what is wrong with them, and healthy clusters.

    conditions: array of (type, status); containers: array of (restarts, waiting), of storage daemons' pods.
    """
    c, phase, health = F.col, F.coalesce("phase", F.lit("")), F.coalesce("health", F.lit(""))
    of = lambda kind: c("kind") == kind
    failed, name = phase.isin("Failure", "Failed"), c("name")
    restarts = F.aggregate(F.coalesce("containers", F.array()), F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x["restarts"], F.lit(0)).cast("long"))
    loops = F.exists(F.coalesce("containers", F.array()), lambda x: F.coalesce(x["waiting"] == "CrashLoopBackOff", F.lit(False)))
    degraded = F.exists(F.coalesce("conditions", F.array()), lambda x: F.coalesce((x["type"] == "Degraded") & (x["status"] == "True"), F.lit(False)))
    made = lambda kind, severity, *message: _signal(kind, severity, "storage", _text(*message))
    state = _first(
        (of("CephCluster") & (health == "HEALTH_ERR"), made("ceph_health_err", "critical", "CephCluster ", name, " HEALTH_ERR")),
        (of("CephCluster") & (health == "HEALTH_WARN"), made("ceph_health_warn", "medium", "CephCluster ", name, " HEALTH_WARN")),
        (of("CephCluster"), made("ceph_health_ok", "info", "CephCluster ", name, " healthy (phase=", phase, ")")),
        (of("CephBlockPool") & failed, made("blockpool_failure", "critical", "CephBlockPool ", name, " phase=", phase)),
        (of("CephBlockPool") & (phase == "Progressing"), made("blockpool_progressing", "medium", "CephBlockPool ", name, " progressing")),
        (of("CephFilesystem") & failed, made("cephfs_failure", "critical", "CephFilesystem ", name, " phase=", phase)),
        (of("StorageCluster") & (phase == "Error"), made("storagecluster_error", "critical", "StorageCluster ", name, " phase=Error")),
        (of("Pod") & loops, made("osd_crashloop", "critical", "OSD ", name, " CrashLoopBackOff (restarts=", restarts, ")")),
        (of("Pod") & (phase != "Running"), made("osd_not_running", "critical", "OSD ", name, " phase=", phase)),
        (of("Pod") & (restarts > 3), made("osd_high_restarts", "high", "OSD ", name, " restarts=", restarts)),
        (of("PersistentVolumeClaim") & (phase == "Pending"), made("pvc_pending", "medium", "PVC ", name, " pending")),
        (of("PersistentVolumeClaim") & (phase == "Lost"), made("pvc_lost", "critical", "PVC ", name, " LOST")),
        (of("PersistentVolume") & (phase == "Failed"), made("pv_failed", "critical", "PV ", name, " phase=Failed")),
    )
    error = F.when(of("CephCluster") & (phase == "Error"), made("ceph_phase_error", "critical", "CephCluster ", name, " phase=Error"))
    worse = F.when(of("StorageCluster") & degraded, made("storagecluster_degraded", "high", "StorageCluster ", name, " degraded"))
    return _exploded(rows, F.array_compact(F.array(state, error, worse)))


# ---------------------------------------------------------------- gauges


def sandbox_gauges(metrics: DataFrame) -> DataFrame:
    """Of metrics (name, cluster, value): connections and queue by their levels, and clusters whose free slots run out,
    which needs a cluster's slots and its most slots side by side."""
    c, value = F.col, F.col("value").cast("long")
    single = metrics.where(c("name").isin("sandbox_pg_connections_active", "sandbox_queued_placements_total"))
    queue = c("name") == "sandbox_queued_placements_total"
    signal = _first(
        (queue & (value > 0), _signal("sandbox_queue_depth", _cases((value > 50, "critical"), (value > 20, "high"), otherwise="medium"), "sandbox", _text("Sandbox queue: ", value, " placements queued"))),
        (~queue, _signal("sandbox_db_connections", _cases((value > 50, "high"), (value > 30, "medium")), "sandbox", _text("Sandbox DB: ", value, " active connections"))),
    )
    levels = single.select(c("cluster"), F.explode(F.array_compact(F.array(signal))).alias("s")).select("cluster", "s.*")
    most = metrics.where(c("name") == "sandbox_ratelimit_max").groupBy("cluster").agg(F.max(value).alias("most"))
    free = metrics.where((c("name") == "sandbox_ratelimit_available_slots") & (F.coalesce("cluster", F.lit("")) != ""))
    both = free.select("cluster", value.alias("free")).join(most, "cluster", "left").where("most > 0 and free <= 2")
    slots = _text(c("cluster"), ": ", c("free"), "/", c("most"), " slots")
    none = c("free") == 0
    short = _signal(_cases((none, "sandbox_ratelimit_exhausted"), otherwise="sandbox_ratelimit_low"), _cases((none, "critical"), otherwise="high"), "sandbox", F.concat(F.when(none, "Ratelimit exhausted on ").otherwise("Ratelimit low on "), slots))
    return levels.unionByName(both.select("cluster", short.alias("s")).select("cluster", "s.*"))


def workstation(rows: DataFrame) -> DataFrame:
    """Of readings of a workstation (what, name, value, of): switches in five minutes, load of its cores, memory in use,
    connections, processes; what isn't high enough to matter as such is info or no signal."""
    c, v = F.col, F.col("value")
    share = F.round(v / F.col("of") * 100).cast("long")
    over = lambda x, high, medium: _cases((x > high, "high"), (x > medium, "medium"))
    signal = _first(
        ((c("what") == "switches") & (v > 20), _signal("high_context_switching", "medium", "focus", _text(v.cast("long"), " app switches in 5 minutes"))),
        (c("what") == "load", _signal("system_load", over(share, 90, 70), "system", _text("System load: ", share, "% of ", c("of"), " cores"))),
        (c("what") == "memory", _signal("memory_usage", over(share, 90, 80), "system", _text("Memory: ", share, "% used"))),
        (c("what") == "connections", _signal("network_connections", _cases((v > 100, "medium")), "network", _text(v.cast("long"), " established connections"))),
        ((c("what") == "process") & (v > 50), _signal("high_cpu_process", "medium", "system", _text(c("name"), " using ", v.cast("long"), "% CPU"))),
    )
    return _exploded(rows, F.array_compact(F.array(signal)))


def metric_health(samples: DataFrame) -> DataFrame:
    """Of samples (metric, value), those that a health query is about and whose value is beyond its threshold."""
    rules = samples.sparkSession.createDataFrame(HEALTH_QUERIES, "metric string, test string, threshold double, signal_type string, severity string")
    beyond = F.when(F.col("test") == ">", F.col("value") > F.col("threshold")).otherwise(F.col("value") == F.col("threshold"))
    return samples.join(rules, "metric").where(beyond).drop("test", "threshold")


# ---------------------------------------------------------------- automation


def task_events(events: DataFrame, jobs: DataFrame, after: int = -1, most: int = 2_000) -> DataFrame:
    """The next `most` events past a high-water mark, by id, with their job's name; events that say nothing are left out.
    An event without a job, or whose job isn't known, has an empty name."""
    told = events.where((F.col("id") > after) & ~F.col("event").isin(*SKIPPED_EVENTS)).orderBy("id").limit(most)
    names = jobs.select(F.col("id").alias("job_id"), F.col("name").alias("job_name"))
    return told.join(names, "job_id", "left").withColumn("job_name", F.coalesce("job_name", F.lit("")))


def activity(stream: DataFrame, after: int = -1, most: int = 500) -> DataFrame:
    """The next `most` entries of an activity stream past a high-water mark, without those about tokens."""
    told = stream.where((F.col("id") > after) & ~F.coalesce(F.col("object1").isin(*SKIPPED_OBJECTS), F.lit(False)))
    return told.orderBy("id").limit(most)


# ---------------------------------------------------------------- other forms


def fed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Records of any domain as flat signals; names: the column for each of signal_type, severity, source, namespace,
    cluster and message, missing ones empty."""
    wanted = ("signal_type", "severity", "source", "namespace", "cluster", "message")
    pick = lambda n: F.coalesce(F.col(names[n]).cast("string"), F.lit("")) if n in names else F.lit("")
    return rows.select("*", *(pick(n).alias(f"_{n}") for n in wanted)).drop(*wanted).withColumnsRenamed({f"_{n}": n for n in wanted})


def prompt_text(fields: tuple[str, ...] = ("message",)) -> Column:
    """What a model is asked about a signal: a line for each thing that is known of it."""
    heads = {"signal_type": "Type", "severity": "Severity", "source": "Source", "namespace": "Namespace"}
    known = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    lines = [F.concat(F.lit(f"{head}: "), known(c)) for c, head in heads.items()]
    return F.concat_ws("\n", *lines, *(F.concat(F.lit(f"{c}: "), known(c)) for c in fields))
