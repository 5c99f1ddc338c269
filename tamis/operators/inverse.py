"""What is suppressed says what is normal: archive, expectations, baseline and its comparison, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.operators.places import lowest

SUPPRESSING = ("suppress", "dedupe", "drop")


def archive(decisions: DataFrame) -> DataFrame:
    """Suppressions by type and agent: count, first and last time, strength (1 from 100 on)."""
    rows = decisions.where(F.col("outcome").isin(*SUPPRESSING))
    made = rows.groupBy("signal_type", "agent_name").agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min_by("outcome", "signal_id").alias("outcome"))
    return made.withColumn("strength", F.least(F.lit(1.0), F.col("count") / 100.0))


def archive_with_evidence(decisions: DataFrame, evidence: Column, capacity: int) -> DataFrame:
    """archive with the evidence of each pattern's first decision (200 characters), and of more than `capacity` patterns the
    strongest ones, ties by type and agent."""
    rows = decisions.where(F.col("outcome").isin(*SUPPRESSING)).withColumn("_said", F.substring(evidence, 1, 200))
    said = rows.groupBy("signal_type", "agent_name").agg(F.min_by("_said", "signal_id").alias("evidence_sample"))
    whole = archive(decisions).join(said, ["signal_type", "agent_name"])
    return lowest(whole.withColumn("_weak", -F.col("strength")), capacity, "_weak", "signal_type", "agent_name").drop("_weak")


def expectations(patterns: DataFrame, least: int = 10, hours: float = 1.0) -> DataFrame:
    """Intervals at which types that make up over a hundredth of suppressions should be seen."""
    types = patterns.groupBy("signal_type").agg(F.sum("count").alias("count"))
    total = patterns.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    rows = types.crossJoin(F.broadcast(total)).where((F.col("count") >= least) & (F.col("count") / F.col("total") > 0.01))
    interval = F.greatest(F.lit(0.1), F.lit(hours) / (F.col("count") / F.greatest(F.lit(1.0), F.col("total") / 100)))
    return rows.select("signal_type", F.round(interval, 2).alias("interval_hours"))


def baseline(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("signal_type").agg(F.sum("count").alias("frequency"), F.array_join(F.array_sort(F.collect_set("agent_name")), ",").alias("agents"), F.max("strength").alias("strength"), F.min("first_seen").alias("first_seen"))


def compare(normal: DataFrame, signals: DataFrame, least: int = 10) -> DataFrame:
    """Types that are new against a baseline, and those that it expects more than `least` times and that aren't there."""
    now = signals.groupBy("signal_type").agg(F.count("*").alias("now"))
    both = normal.select("signal_type", "frequency").join(now, "signal_type", "full")
    reason = F.when(F.col("frequency").isNull(), "unexpected").when(F.col("now").isNull() & (F.col("frequency") > least), "missing")
    return both.withColumn("reason", reason).where("reason is not null").select("signal_type", F.coalesce("now", "frequency").alias("count"), "reason")


def health(memories: DataFrame, gaps: Column, rules: Column, absences: Column) -> DataFrame:
    """Score from 100 down by causal gaps, absences, weak memories and uneven strengths; one row."""
    stats = memories.agg(F.count("*").alias("memories"), F.avg("strength").alias("mean"), F.stddev_pop("strength").alias("spread"))
    score = F.lit(100.0) - F.least(F.lit(30.0), gaps / F.greatest(F.lit(1), rules) * 30.0) - F.least(F.lit(20.0), absences * 5.0)
    score = score - F.when(F.col("memories") > 0, F.least(F.lit(20.0), F.greatest(F.lit(0.0), 0.3 - F.col("mean")) * 66.7)).otherwise(10.0) - F.least(F.lit(20.0), F.coalesce("spread", F.lit(0.0)) * 20.0)
    made = stats.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 1))
    return made.select("memories", "score", F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 75, "good").when(F.col("score") >= 50, "fair").otherwise("poor").alias("grade"))
