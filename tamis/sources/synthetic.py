"""Records of several domains, made from a seed: the same rows on every run, whatever the partitions.

A row's choice in a column is taken from a digest of seed, row and column, so rows need no state and no order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a domain: choices, each as likely as often as it is named, or (low, high) of a number.
DOMAINS: dict[str, dict[str, tuple]] = {
    "finance": {
        "account_id": (1, 5000), "amount": (1.0, 12000.0), "transaction_type": ("card_purchase",) * 6 + ("cash_deposit", "wire_transfer"),
        "country": ("US",) * 8 + ("DE", "BR"), "velocity_1h": (0, 6), "is_recurring": (False,) * 4 + (True,), "label": ("normal",) * 19 + ("fraud",),
    },
    "healthcare": {
        "patient_id": (1, 2000), "event_type": ("vital_signs", "lab_result", "medication"), "department": ("ER", "ICU", "WARD"),
        "severity_flag": ("normal",) * 12 + ("operational", "compliance", "critical"),
    },
    "insurance": {
        "policy_id": (1, 3000), "event_type": ("claim_filed",) * 3 + ("policy_change", "sla_breach"), "amount": (50.0, 40000.0),
        "state": ("CA", "NY", "TX"), "label": ("normal",) * 14 + ("fraud",),
    },
    "retail": {
        "store_id": (1, 300), "event_type": ("pos_sale",) * 7 + ("pos_return",), "amount": (1.0, 400.0), "quantity": (1, 9),
        "label": ("normal",) * 17 + ("shrinkage", "operational", "compliance"),
    },
    "telecom": {
        "network_element": (1, 900), "event_type": ("kpi",) * 6 + ("alarm", "outage"), "severity_level": ("normal",) * 9 + ("major", "critical"),
        "metric_value": (0.0, 100.0), "threshold": (50, 99), "affected_subscribers": (0, 20000),
    },
    "knowledge": {
        "person": (1, 200), "team": ("core", "edge", "data"), "topic": ("runbook", "onboarding", "architecture"),
        "signal_type": ("status_update",) * 5 + ("decision_revisited", "documentation_gap", "incident_repeat"),
    },
    "memory": {
        "project": (1, 60), "memory_type": ("feedback", "project", "reference", "user"),
        "text": ("never deploy on Friday", "the user prefers tables", "we switched to parquet", "TODO measure", "p95 is 2.5 s"),
    },
}


def drawn(seed: int, name: str, choices: tuple) -> Column:
    """A choice for the row `id`, or a number from low to high: whole for whole bounds (high included), else with cents."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), F.col("id").cast("string")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    if len(choices) == 2 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in choices):
        low, high = choices
        if isinstance(low, int):
            return (F.lit(low) + draw % (high - low + 1)).cast("long")
        return F.round(F.lit(low) + (draw / F.lit(float(1 << 32))) * (high - low), 2)
    return F.element_at(F.array(*map(F.lit, choices)), (draw % len(choices) + 1).cast("int"))


def records(ids: DataFrame, domain: str, seed: int = 42) -> DataFrame:
    """A record of the domain for each row of ids (id)."""
    return ids.select("id", *(drawn(seed, n, c).alias(n) for n, c in DOMAINS[domain].items()))
