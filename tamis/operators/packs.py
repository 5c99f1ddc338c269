"""What the engine knows of each domain: causes and effects, how fast memories of a type fade, what a signal is about."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Causes and effects by domain, and rates an hour at which memories of a type fade.
KUBERNETES_CAUSES = (
    ("node_disk_pressure", "event_provisioningfailed"), ("node_disk_pressure", "event_volumefaileddelete"),
    ("node_memory_pressure", "event_unhealthy"), ("node_memory_pressure", "pod_crashloop"),
    ("event_claimmisbound", "event_volumefaileddelete"), ("event_claimmisbound", "event_failedattachvolume"),
    ("event_failedscheduling", "pod_pending"), ("node_notready", "event_failedscheduling"), ("node_notready", "pod_pending"),
    ("event_backofflimitexceeded", "pod_crashloop"), ("metric_node_disk_pressure", "event_provisioningfailed"),
    ("metric_node_disk_pressure", "event_volumefaileddelete"), ("metric_node_memory_pressure", "event_unhealthy"),
    ("metric_node_memory_exhausted", "event_unhealthy"), ("metric_node_notready", "event_failedscheduling"),
    ("metric_node_cpu_saturated", "metric_api_server_slow"), ("metric_etcd_slow_commits", "metric_api_server_slow"),
    ("pool_exhausted", "anarchy_subject_failed"), ("pool_low", "anarchy_subject_failed"), ("sync_failed", "app_degraded"),
    ("ceph_health_err", "blockpool_failure"), ("ceph_health_err", "cephfs_failure"), ("ceph_health_err", "pvc_pending"),
    ("ceph_health_err", "pvc_lost"), ("ceph_health_warn", "pvc_pending"), ("blockpool_failure", "pvc_pending"),
    ("blockpool_failure", "event_failedattachvolume"), ("osd_crashloop", "ceph_health_err"),
    ("osd_not_running", "ceph_health_err"), ("metric_osd_down", "ceph_health_err"), ("metric_osd_down", "pvc_pending"),
    ("metric_ceph_pool_near_full", "ceph_health_warn"), ("metric_osd_near_full", "ceph_health_warn"),
    ("storagecluster_error", "ceph_health_err"), ("pvc_lost", "event_volumefaileddelete"),
    ("pv_failed", "event_failedattachvolume"),
)
KUBERNETES_DECAY = {
    "event_deprecatedannotation": 0.05, "event_ipaddresswrongreference": 0.03, "node_healthy": 0.1, "node_notready": 0.001,
    "pod_crashloop": 0.005, "event_claimmisbound": 0.005, "ceph_health_ok": 0.1, "blockpool_healthy": 0.1,
    "cephfs_healthy": 0.1, "ceph_health_err": 0.001, "osd_crashloop": 0.001, "pvc_lost": 0.002,
}
AUTOMATION_CAUSES = (
    ("config_update_credential", "job_failed"), ("config_update_inventory", "job_failed"),
    ("config_delete_credential", "job_failed"), ("config_delete_inventory", "job_failed"),
    ("task_runner_on_failed", "job_failed"), ("task_runner_on_unreachable", "job_failed"), ("job_failed", "job_error"),
)
AUTOMATION_DECAY = {
    "task_runner_on_skipped": 0.1, "task_verbose": 0.1, "task_runner_on_ok": 0.1, "job_successful": 0.08,
    "config_update_credential": 0.001, "config_delete_credential": 0.001, "config_update_inventory": 0.005,
    "job_failed": 0.005, "task_runner_on_failed": 0.005,
}
KNOWLEDGE_CAUSES = (
    ("expertise_departure", "knowledge_gap"), ("expertise_departure", "escalation_repeat"),
    ("expertise_concentration", "expertise_departure"), ("documentation_gap", "onboarding_delay"),
    ("documentation_gap", "escalation_repeat"), ("runbook_decay", "incident_repeat"),
    ("incident_repeat", "process_workaround"), ("process_workaround", "runbook_decay"),
    ("decision_revisited", "architecture_drift"), ("meeting_recurring_topic", "decision_revisited"),
    ("code_review_repeat", "documentation_gap"), ("hotfix_pattern", "incident_repeat"),
    ("onboarding_question", "documentation_gap"),
)
KNOWLEDGE_DECAY = {
    "meeting_summary": 0.05, "status_update": 0.1, "regular_commit": 0.08, "sprint_review": 0.05,
    "expertise_departure": 0.001, "knowledge_gap": 0.002, "incident_repeat": 0.003, "decision_revisited": 0.005,
    "expertise_concentration": 0.002, "documentation_gap": 0.003, "process_workaround": 0.005,
}
WORKSTATION_CAUSES = (
    ("high_context_switching", "git_large_uncommitted"), ("high_cpu_process", "system_load"), ("high_file_churn", "git_commits"),
)
WORKSTATION_DECAY = {
    "app_focus_end": 0.1, "system_load": 0.08, "memory_usage": 0.08, "network_connections": 0.1,
    "high_context_switching": 0.01, "git_commits": 0.02, "git_large_uncommitted": 0.005, "high_file_churn": 0.02,
    "high_cpu_process": 0.03,
}


def _some(name: str) -> Column:
    return F.nullif(F.col(name).cast("string"), F.lit(""))


def _label(name: str) -> Column:
    return F.nullif(F.try_element_at("labels", F.lit(name)), F.lit(""))


def default_entity() -> Column:
    """cluster:namespace:source, of what there is; null where there is none."""
    return F.nullif(F.concat_ws(":", *map(_some, ("cluster", "namespace", "source"))), F.lit(""))


def kubernetes_entity() -> Column:
    at = F.concat(F.lit(":"), _some("cluster"))
    node = F.concat(F.lit("node:"), _some("source"), F.coalesce(at, F.lit("")))
    return F.coalesce(node, F.concat(F.lit("ns:"), _some("namespace"), at))


def automation_entity() -> Column:
    """By what the label source says that the signal comes from; content has job_id."""
    job = F.concat(F.lit("job:"), F.coalesce("namespace", F.lit("")), F.lit(":"), _some("source"))
    run, changed = F.concat(F.lit("job-run:"), _some("job_id")), F.concat(F.lit("config:"), F.coalesce("namespace", F.lit("")))
    what = _label("source")
    return F.when(what == "job", job).when(what == "task", run).when(what == "activity", changed)


def knowledge_entity() -> Column:
    person = F.concat(F.lit("person:"), _label("person"))
    return F.coalesce(F.concat(person, F.lit("@"), _label("team")), F.concat(F.lit("topic:"), _label("topic")), person)


def workstation_entity() -> Column:
    """By the label category; content has app and repo."""
    what = _label("category")
    app, repo = F.concat(F.lit("app:"), _some("app")), F.concat(F.lit("repo:"), _some("repo"))
    system = F.concat(F.lit("system:"), F.coalesce(_some("source"), F.lit("local")))
    return F.when(what == "focus", app).when(what == "code", repo).when(what == "system", system)


@dataclass(frozen=True)
class Pack:
    causes: tuple[tuple[str, str], ...]
    decay: dict[str, float]
    entity: Callable[[], Column]


PACKS = {
    "kubernetes": Pack(KUBERNETES_CAUSES, KUBERNETES_DECAY, kubernetes_entity),
    "automation": Pack(AUTOMATION_CAUSES, AUTOMATION_DECAY, automation_entity),
    "knowledge": Pack(KNOWLEDGE_CAUSES, KNOWLEDGE_DECAY, knowledge_entity),
    "workstation": Pack(WORKSTATION_CAUSES, WORKSTATION_DECAY, workstation_entity),
}


def register(domain: str, causes: tuple, decay: dict[str, float], entity: Callable[[], Column] = default_entity) -> None:
    """Adds a domain, or replaces one."""
    PACKS[domain] = Pack(tuple(causes), dict(decay), entity)


def causes(spark: SparkSession, *domains: str) -> DataFrame:
    """domain, cause, effect of the named domains (none named: of all)."""
    rows = [(d, *pair) for d in domains or PACKS for pair in PACKS[d].causes]
    return spark.createDataFrame(rows, "domain string, cause string, effect string")


def decay_rates(spark: SparkSession, domain: str) -> DataFrame:
    return spark.createDataFrame(list(PACKS[domain].decay.items()), "signal_type string, rate double")


def entities(signals: DataFrame, domain: str | None = None) -> Column:
    """What signals are about by a domain's way of naming, or the default one for domains that aren't known."""
    return PACKS[domain].entity() if domain in PACKS else default_entity()
