"""Finding candidate rules by aggregation over what passed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _total(signals: DataFrame) -> DataFrame:
    """One row: how many signals there are."""
    return signals.agg(F.count("*").alias("total_signals"))


def repeat_floods(signals: DataFrame, least: int = 10) -> DataFrame:
    """Types with instances (type, source, namespace) that repeat at least `least` times: count over those instances and
    share of all signals. Two levels of grouping, both with partial sums before a shuffle."""
    instances = signals.groupBy("signal_type", "source", "namespace").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    types = instances.groupBy("signal_type").agg(F.sum("n").alias("count"))
    return types.crossJoin(F.broadcast(_total(signals))).withColumn("frequency", F.col("count") / F.col("total_signals"))


def dominant_types(signals: DataFrame, share: float = 0.05, most: int = 10) -> DataFrame:
    """The `most` most frequent types that have at least `share` of all signals; ties by first seen."""
    types = signals.groupBy("signal_type").agg(F.count("*").alias("count"), F.min("seq").alias("first_seq")).orderBy(F.desc("count"), "first_seq").limit(most)
    return types.crossJoin(F.broadcast(_total(signals))).withColumn("frequency", F.col("count") / F.col("total_signals")).where(F.col("frequency") >= share).drop("first_seq")


def mono_severity(signals: DataFrame, share: float = 0.80, least: int = 20) -> DataFrame:
    """Types of which one severity has more than `share`."""
    per = signals.groupBy("signal_type", "severity").agg(F.count("*").alias("count"))
    whole = F.sum("count").over(Window.partitionBy("signal_type"))
    return per.withColumn("type_total", whole).where(F.col("type_total") >= least).withColumn("frequency", F.col("count") / F.col("type_total")).where(F.col("frequency") > share)


def samples(signals: DataFrame, n: int = 3) -> DataFrame:
    """The first n signals of each type, in order; Spark drops what can't be among them before it shuffles."""
    ranked = signals.withColumn("pos", F.row_number().over(Window.partitionBy("signal_type").orderBy("signal_id")) - 1)
    return ranked.where(F.col("pos") < n).select("signal_type", "pos", "signal_id")


def draft_agents(signals: DataFrame) -> DataFrame:
    """A draft rule for each repeat flood and dominant type."""
    floods = repeat_floods(signals).select("signal_type", "count", "frequency", F.lit("repeat_flood").alias("pattern_type"), F.concat(F.lit("suppress_"), "signal_type", F.lit("_repeat")).alias("name"), F.concat("signal_type", F.lit("_repeat_noise")).alias("classification"))
    types = dominant_types(signals).select("signal_type", "count", "frequency", F.lit("dominant_type").alias("pattern_type"), F.concat(F.lit("classify_"), "signal_type").alias("name"), F.concat("signal_type", F.lit("_classified")).alias("classification"))
    return floods.unionByName(types).withColumn("tier", F.lit("draft")).withColumn("frequency", F.round("frequency", 6))
