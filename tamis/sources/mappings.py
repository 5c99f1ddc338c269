"""Type and severity of source records of several domains, as columns.

Each mapping takes a DataFrame of records and returns it with signal_type and severity. Missing columns count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cases(*pairs: tuple[Column, str | Column], otherwise: str | Column = "info") -> Column:
    found = F
    for test, value in pairs:
        found = found.when(F.coalesce(test, F.lit(False)), value if isinstance(value, Column) else F.lit(value))
    return found.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def _map(rows: DataFrame, kind: Column, severity: Column) -> DataFrame:
    return rows.withColumn("signal_type", kind).withColumn("severity", severity)


def finance(rows: DataFrame) -> DataFrame:
    kind, amount, velocity = F.col("transaction_type"), F.col("amount"), F.col("velocity_1h")
    abroad, new, wire = F.col("is_first_time_country"), F.col("is_first_time_merchant"), F.col("transaction_type") == "wire_transfer"
    structured = (kind == "cash_deposit") & (amount >= 8000) & (amount < 10000)
    types = _cases((wire & abroad, "wire_international_first"), (wire, "wire_transfer"), (structured, "cash_deposit_sub_10k"), (velocity >= 5, "rapid_transactions"), (F.col("is_recurring"), "recurring_charge"), (amount > 5000, "large_transaction"), otherwise=F.concat(kind, F.lit("_standard")))
    severity = _cases((abroad | (velocity >= 5) | (amount > 10000), "high"), ((velocity >= 3) | (amount > 5000) | (new & ((amount > 500) | (velocity >= 2))) | structured, "medium"))
    return _map(rows, types, severity)


def finance_message() -> Column:
    """What a transaction was, with its flags in brackets."""
    flags = F.array_compact(F.array(F.when(F.col("is_first_time_merchant"), F.lit("first-time merchant")), F.when(F.col("is_first_time_country"), F.lit("first-time country")), F.when(F.col("is_recurring"), F.lit("recurring")), F.when(F.col("velocity_1h") >= 3, F.concat(F.lit("velocity="), F.col("velocity_1h").cast("string"), F.lit("/hr")))))
    text = F.concat(F.lit("$"), F.format_number("amount", 2), F.lit(" at "), F.col("merchant"), F.lit(" ("), F.col("transaction_type"), F.lit(") in "), F.col("country"))
    return F.when(F.size(flags) > 0, F.concat(text, F.lit(" ["), F.array_join(flags, ", "), F.lit("]"))).otherwise(text)


def kubernetes(rows: DataFrame) -> DataFrame:
    what, reason, phase, restarts = F.col("type"), F.col("reason"), F.col("phase"), F.coalesce("restarts", F.lit(0))
    pod, node, event = what == "pod", what == "node", what == "event"
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    types = _cases(
        (pod & ((reason == "CrashLoopBackOff") | (restarts > 5)), "pod_crashloop"), (pod & (phase == "Pending"), "pod_pending"), (pod & some(phase), F.concat(F.lit("pod_"), F.lower(phase))), (pod, "pod_unknown"),
        (event & some(reason), F.concat(F.lit("event_"), F.lower(reason))), (event, "event_unknown"),
        (node & (F.coalesce("ready", F.lit("")) != "True"), "node_notready"), (node & (F.col("memory_pressure") == "True"), "node_memory_pressure"), (node & (F.col("disk_pressure") == "True"), "node_disk_pressure"), (node, "node_healthy"),
        otherwise=F.concat(what, F.lit("_unknown")),
    )
    severity = _cases((event, "medium"), (pod & (restarts > 10), "high"), (pod & (restarts > 3), "medium"), (pod & (phase == "Pending"), "low"), (node & (F.coalesce("ready", F.lit("")) != "True"), "critical"), (node & (F.col("memory_pressure") == "True"), "high"))
    return _map(rows, types, severity)


def healthcare(rows: DataFrame) -> DataFrame:
    kind, flag = F.col("event_type"), F.col("severity_flag")
    types = _cases((flag == "critical", F.concat(F.lit("critical_"), kind)), (flag == "compliance", F.concat(F.lit("compliance_"), kind)), (flag == "operational", F.concat(F.lit("ops_"), kind)), otherwise=kind)
    return _map(rows, types, _cases((flag == "critical", "critical"), (flag == "compliance", "high"), (flag == "operational", "medium")))


# What makes a filed claim suspicious, and kinds of events that matter as such.
CLAIM_WORDS = "staged|inflated|phantom|identity|duplicate|mismatch|po box|npi|impossible|pre-existing|attorney|aftermarket|oem|soft tissue|upcoded|bundled|ssn|vin|classified|manufacturing|clerical"
INSURANCE_HIGH = ("licensing_gap", "reserve_deficiency", "regulatory_filing", "market_conduct", "solvency_warning")
INSURANCE_MEDIUM = ("sla_breach", "adjuster_overload", "reinsurance_trigger", "system_outage", "backlog_alert")


def insurance(rows: DataFrame) -> DataFrame:
    kind, amount = F.col("event_type"), F.col("amount")
    filed = kind == "claim_filed"
    severity = _cases((kind.isin(*INSURANCE_HIGH), "high"), (kind.isin(*INSURANCE_MEDIUM), "medium"), (filed & (amount > 25000), "medium"), (filed & F.lower("description").rlike(CLAIM_WORDS), "high"), (filed & (amount > 10000), "medium"))
    return _map(rows, _cases((filed & (amount > 25000), "large_claim"), otherwise=kind), severity)


def retail(rows: DataFrame) -> DataFrame:
    """The label is an input here; where it is ground truth, severities say what it says."""
    kind, amount, label = F.col("event_type"), F.col("amount"), F.col("label")
    severity = _cases((label.isin("shrinkage", "compliance"), "high"), (label == "operational", "medium"), ((kind == "pos_return") & (amount > 200), "medium"))
    return _map(rows, _cases(((kind == "pos_return") & (amount > 100), "high_value_return"), otherwise=kind), severity)


def telecom(rows: DataFrame) -> DataFrame:
    kind, level, people = F.col("event_type"), F.col("severity_level"), F.col("affected_subscribers")
    types = _cases(((kind == "outage") & (people > 10000), "major_outage"), (kind == "outage", "minor_outage"), otherwise=kind)
    severity = _cases(((level == "critical") | (people > 10000), "critical"), (level.isin("major", "compliance"), "high"), (level == "customer", "medium"), ((F.col("threshold") > 0) & (F.col("metric_value") > F.col("threshold") * 0.8), "low"))
    return _map(rows, types, severity)


def automation(rows: DataFrame) -> DataFrame:
    """Jobs (kind job), their tasks and changes to the configuration, with the namespace that a name has in brackets."""
    kind, failed = F.col("kind"), F.coalesce("failed", F.lit(False))
    job, task, change = kind == "job", kind == "task", kind == "activity"
    name, status = F.lower(F.coalesce("name", F.lit(""))), F.coalesce("status", F.lit(""))
    types = _cases((job & (status != ""), F.concat(F.lit("job_"), status)), (job, "job_unknown"), (task, F.concat(F.lit("task_"), status)), otherwise=F.lower(F.regexp_replace(F.concat(F.lit("config_"), status, F.lit("_"), F.coalesce("object1", F.lit(""))), " ", "_")))
    severity = _cases(
        (job & failed & (F.contains(name, F.lit("prod")) | F.contains(name, F.lit("crit"))), "critical"), (job & (failed | (status == "error")), "high"), (job & (status == "canceled"), "medium"),
        (task & failed, "high"), (task & (status == "warning"), "medium"), (task & (status == "runner_on_skipped"), "low"),
        (change & (status == "delete") & F.col("object1").isin("credential", "inventory", "project"), "high"), (change & (status == "update") & F.col("object1").isin("credential", "inventory"), "medium"),
    )
    bracket = F.regexp_extract("name", r"^\[([^\]]+)\]", 1)
    space = F.when(change, "config").when(bracket != "", F.regexp_replace(F.lower(bracket), " ", "-")).otherwise("general")
    return _map(rows, types, severity).withColumn("namespace", space)


def alerts(rows: DataFrame) -> DataFrame:
    """Alerts by the severity that they bring."""
    level = F.col("severity")
    return rows.withColumn("severity", _cases((level == "critical", "critical"), (level == "warning", "medium"), (level == "info", "low")))


def deployments(rows: DataFrame) -> DataFrame:
    """Applications by health, sync and the last operation, the gravest first."""
    health, sync = F.coalesce("health_status", F.lit("")), F.coalesce("sync_status", F.lit(""))
    broken, drifted, failed, fine = health == "Degraded", sync == "OutOfSync", F.col("op_phase") == "Failed", (health == "Healthy") & (sync == "Synced")
    types = _cases((broken, "app_degraded"), (drifted, "app_outofsync"), (failed, "sync_failed"), (fine, "app_synced"), otherwise=F.concat(F.lit("app_"), F.lower(health)))
    return _map(rows, types, _cases((broken, "high"), (drifted, "medium"), (failed, "high"), (fine, "info"), otherwise="low"))


def pools(rows: DataFrame) -> DataFrame:
    """Pools by what they have available against what they should have."""
    wanted, there = F.col("min_available") > 0, F.col("available")
    return _map(rows, _cases((wanted & (there == 0), "pool_exhausted"), (wanted & (there <= 1), "pool_low"), otherwise="pool_healthy"), _cases((wanted & (there == 0), "critical"), (wanted & (there <= 1), "high")))


def claims(rows: DataFrame) -> DataFrame:
    """Claims whose state isn't the desired one; others make no signal."""
    now, want = F.coalesce("current_state", F.lit("")), F.coalesce("desired_state", F.lit(""))
    off = rows.where((now != "") & (want != "") & (now != want))
    return _map(off, F.concat(F.lit("claim_"), F.replace(now, F.lit("-"), F.lit("_"))), _cases(((want == "started") & now.isin("provision-failed", "stop-error"), "high"), otherwise="medium"))
