"""The cascade: agents decide in order over one annotated DataFrame, without a pass or a join for each.

Before an agent, `removed` and `escalated` say what earlier ones did. An escalation protects from removal by later agents
only; suppress, dedupe and drop remove, classify removes info signals; info signals that are left and not escalated go at
the end, without a decision.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.operators.agents import Agent, built_in

log = logging.getLogger(__name__)
REMOVING = ("suppress", "dedupe", "drop")


def annotate(signals: DataFrame, agents: list[Agent] | None = None) -> DataFrame:
    """signals with a decision struct d_<agent> each, and removed, escalated, survives.

    An agent that can't be planned is left out (what it would have decided fails open) and logged. One that fails on a row
    as the plan runs fails the job: custom agents should use try_ forms where a value may not fit.
    """
    df, ready = signals, []
    for agent in agents if agents is not None else built_in():
        if agent.prepare is not None:
            df = agent.prepare(df)
    for agent in sorted(agents if agents is not None else built_in(), key=lambda a: a.stage):
        if agent.stateless:  # before any window: above one it is a column, not an expression that flags repeat
            try:
                planned = df.withColumn(f"raw_{agent.name}", agent.decide(df, F.lit(True)))
                planned.schema  # noqa: B018  plans it
                df = planned
            except Exception:
                log.exception("agent %s left out", agent.name)
                continue
        ready.append(agent)
    df = df.withColumn("removed", F.lit(False)).withColumn("escalated", F.lit(False))
    for agent in ready:
        name = f"d_{agent.name}"
        try:
            active = ~F.col("removed")
            planned = df.withColumn(name, F.when(active, F.col(f"raw_{agent.name}")) if agent.stateless else agent.decide(df, active))
            planned.schema  # noqa: B018  plans it
        except Exception:
            log.exception("agent %s left out", agent.name)
            continue
        # from what the agent says regardless of flags: each flag then names the ones before it once
        outcome = F.col(f"raw_{agent.name}" if agent.stateless else name)["outcome"]
        goes = F.coalesce(outcome.isin(*REMOVING) | ((outcome == "classify") & (F.col("severity") == "info")), F.lit(False)) & ~F.col("escalated")
        rises = F.coalesce(outcome == "escalate", F.lit(False)) & active
        df = planned.withColumns({f"removed_{name}": goes & active, "removed": F.col("removed") | goes, "escalated": F.col("escalated") | rises})
    df = df.drop(*(f"raw_{a.name}" for a in ready), *(c for c in df.columns if c.startswith("_")))
    return df.withColumn("survives", ~F.col("removed") & ((F.col("severity") != "info") | F.col("escalated")))


def decision_columns(annotated: DataFrame) -> list[str]:
    return [c for c in annotated.columns if c.startswith("d_")]


def decisions(annotated: DataFrame) -> DataFrame:
    """A row for each decision: signal_id, agent_pos, agent_name, outcome, classification, confidence."""
    made = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("agent_pos"), F.lit(c[2:]).alias("agent_name"), F.col(c)["outcome"].alias("outcome"), F.col(c)["classification"].alias("classification"), F.col(c)["confidence"].alias("confidence"))) for k, c in enumerate(decision_columns(annotated)))))
    return annotated.select("signal_id", "signal_type", "namespace", "ts", F.explode(made).alias("d")).select("signal_id", "signal_type", "namespace", "ts", "d.*")


def summary(annotated: DataFrame) -> DataFrame:
    """One row: total, suppressed, deduped, dropped, escalated, classified, remaining, compression_ratio. A drop counts even
    where an escalation protects the signal, as do info signals that go at the end."""
    cols = decision_columns(annotated)

    def count(test):
        return sum((F.count_if(test(c)) for c in cols), F.lit(0))

    effective = lambda kind: lambda c: (F.col(c)["outcome"] == kind) & F.col(f"removed_{c}")
    any_of = lambda kind: lambda c: F.col(c)["outcome"] == kind
    tail = F.count_if(~F.col("removed") & ~F.col("survives"))
    remaining = F.count_if(F.col("survives"))
    return annotated.agg(
        F.count("*").alias("total"), count(effective("suppress")).alias("suppressed"), count(effective("dedupe")).alias("deduped"), (count(any_of("drop")) + tail).alias("dropped"),
        count(any_of("escalate")).alias("escalated"), count(any_of("classify")).alias("classified"), remaining.alias("remaining"),
        F.when(F.count("*") > 0, (F.count("*") - remaining) / F.count("*")).otherwise(0.0).alias("compression_ratio"),
    )


def survivors(annotated: DataFrame) -> DataFrame:
    """What is left for inference, with the class that the first classifying agent gave."""
    first = F.coalesce(*(F.nullif(F.col(c)["classification"], F.lit("")) for c in decision_columns(annotated)))
    return annotated.where("survives").withColumn("classification", F.coalesce(first, F.lit("")))
