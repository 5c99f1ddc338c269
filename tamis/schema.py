"""Names, orders and patterns that the operators share."""

from __future__ import annotations

SEVERITIES = ("info", "low", "medium", "high", "critical")
OUTCOMES = ("keep", "drop", "suppress", "dedupe", "escalate", "classify")

# Strength of a new memory by severity; labels that pass duplicates and gates; types that resolve themselves.
SEVERITY_WEIGHTS = {"info": 0.1, "low": 0.2, "medium": 0.4, "high": 0.7, "critical": 1.0}
BYPASS_LABELS = ("compliance", "fraud", "sanctions")
TRANSIENT_TYPES = ("pod_restart", "container_backoff", "probe_failure", "dns_timeout")
LOCATION_FIELDS = ("location", "span_id", "circuit_id", "node", "host", "region", "zone", "rack", "site", "service", "instance")
ENTITY_KEYS = ("patient_id", "account_id", "device_id", "node", "host", "circuit_id", "instance_id", "instance")
SUPPRESSIBLE = ("info", "low")

# Patterns over an event's text, the first that matches classifies it.
NEVER_SUPPRESS = r"(?i)(fatal|critical|oomkill|segfault|panic|breach|unauthorized|data.?loss|corruption)"
ESCALATE = r"(?i)(oomkill|segfault|panic|fatal|critical|security|breach|unauthorized|injection|data.?loss|corruption|integrity)"
PATTERNS = (
    ("oom", r"(?i)(oomkill|out.of.memory|memory.limit)", "memory_exhaustion"),
    ("disk", r"(?i)(disk.full|no.space|filesystem.full|disk.pressure)", "disk_pressure"),
    ("cpu", r"(?i)(cpu.throttl|cpu.pressure|cpu.limit)", "cpu_pressure"),
    ("network", r"(?i)(connection.refused|timeout|unreachable|dns.fail)", "network_failure"),
    ("crash", r"(?i)(crashloop|segfault|panic|core.dump)", "application_crash"),
    ("auth", r"(?i)(unauthorized|forbidden|403|401|auth.fail)", "auth_failure"),
    ("scaling", r"(?i)(hpa.max|replica.limit|insufficient.cpu|pending.pod)", "scaling_limit"),
)
TREND_FIELDS = r"(?i)(heart_rate|bp_|spo2|temp|respiratory|pulse|cpu_|memory_|disk_|latency|error_|fail_|velocity_|restart|queue_|saturation|utilization|packet_loss|jitter|signal_strength|consecutive_|load_|iops|throughput|response_time)"
TREND_IGNORED = ("message", "raw", "description", "name", "type", "reading_number", "sequence", "burst_id", "total")
THRESHOLDS = (("cpu", "cpu_percent", "cpu_usage"), ("memory", "memory_percent", "memory_usage"), ("disk", "disk_percent", "disk_usage"))

# Causes and effects among Kubernetes event types that the test tables hold, and what a tier asks for.
CAUSES = (("node_notready", "pod_crashloop"), ("pod_crashloop", "event_unhealthy"), ("event_unhealthy", "probe_failure"), ("node_memory_pressure", "pod_crashloop"), ("probe_failure", "heartbeat"))
TIERS = ("draft", "candidate", "nano", "micro", "macro")
TIER_REQUIREMENTS = (
    # tier, samples, accuracy, false positives, false negatives, human review
    ("candidate", 50, 0.60, 0.30, 0.20, False),
    ("nano", 200, 0.75, 0.15, 0.0, False),
    ("micro", 500, 0.85, 0.10, 0.0, True),
    ("macro", 1000, 0.85, 0.05, 0.0, True),
)
