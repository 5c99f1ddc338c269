"""What memories say together: sessions in time, types that come together, causes, absences, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators.tables import written
from tamis.sources.adapters import severity_rank


def sessions(rows: DataFrame, gap_us: int, slice_us: int = 86_400_000_000, time: str = "us", tie: str = "seq") -> DataFrame:
    """rows with session: a new one begins where the time since the row before exceeds gap_us.

    There is no key, so a plain window would put all rows into one task. Rows are sliced by time instead: gaps are found
    within a slice, and what a slice needs of those before it (their last time and their number of gaps) is a row a slice.
    """
    sliced = rows.withColumn("_slice", F.floor(F.col(time) / slice_us))
    bounds = sliced.groupBy("_slice").agg(F.max(time).alias("_last"))
    bounds = bounds.select("_slice", F.lag("_last").over(Window.orderBy("_slice")).alias("_before"))
    w = Window.partitionBy("_slice").orderBy(time, tie)
    found = sliced.join(bounds, "_slice").withColumn("_new", F.coalesce(F.col(time) - F.coalesce(F.lag(time).over(w), F.col("_before")) > gap_us, F.lit(False)).cast("long"))
    found = found.withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    offsets = found.groupBy("_slice").agg(F.sum("_new").alias("_gaps"))
    offsets = offsets.select("_slice", F.coalesce(F.sum("_gaps").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    return found.join(offsets, "_slice").withColumn("session", F.col("_n") + F.col("_offset")).drop("_slice", "_before", "_new", "_n", "_offset")


def session_table(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("session").agg(F.count("*").alias("members"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count_distinct("signal_type").alias("types"))


def pair_counts(clustered: DataFrame) -> DataFrame:
    """(a, b) of types with a < b: sessions that hold both, and in how many a (or b) comes first; ties count for a. A session
    has a row per type, so the self-join is small whatever the session's size."""
    first = clustered.groupBy("session", "signal_type").agg(F.min("us").alias("first_us"))
    a = first.select("session", F.col("signal_type").alias("a"), F.col("first_us").alias("ta"))
    b = first.select("session", F.col("signal_type").alias("b"), F.col("first_us").alias("tb"))
    return a.join(b, "session").where("a < b").groupBy("a", "b").agg(F.count("*").alias("together"), F.count_if(F.col("ta") <= F.col("tb")).alias("a_first"), F.count_if(F.col("ta") > F.col("tb")).alias("b_first"))


def propose_rules(clustered: DataFrame, edges: DataFrame, least: int = 5, support: float = 0.3) -> DataFrame:
    """Cause and effect for pairs of types that often share a session and have no rule yet (edges: cause, effect)."""
    counts = clustered.select("session", "signal_type").distinct().groupBy("signal_type").agg(F.count("*").alias("n"))
    pairs = pair_counts(clustered).where(F.col("together") >= least)
    pairs = pairs.join(counts.select(F.col("signal_type").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("signal_type").alias("b"), F.col("n").alias("nb")), "b")
    pairs = pairs.withColumn("support", F.col("together") / F.least("na", "nb")).where(F.col("support") >= support)
    known = edges.select(F.least("cause", "effect").alias("a"), F.greatest("cause", "effect").alias("b")).distinct()
    new = pairs.join(known, ["a", "b"], "left_anti")
    forward = F.col("a_first") >= F.col("b_first")
    return new.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("cause"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("effect"), "together", F.round("support", 3).alias("support"), F.round(F.greatest("a_first", "b_first") / F.greatest(F.lit(1), F.col("a_first") + F.col("b_first")), 3).alias("confidence"))


def causal_links(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each memory and effect of its type that has memories too."""
    present = memories.select(F.col("signal_type").alias("effect")).distinct()
    reachable = edges.join(present, "effect", "left_semi")
    return memories.select("memory_id", F.col("signal_type").alias("cause")).join(reachable, "cause")


def closure(edges: DataFrame) -> DataFrame:
    """All (start, reached) over edges (cause, effect). A start is reached from itself only through a cycle.

    What is reached is joined with itself until nothing new comes, so rounds grow with the logarithm of the longest chain;
    each round is written.
    """
    found = written(edges.select(F.col("cause").alias("start"), F.col("effect").alias("reached")).distinct(), "reached")
    n = found.count()
    while True:
        further = found.select(F.col("start").alias("reached"), F.col("reached").alias("next"))
        step = found.join(further, "reached").select("start", F.col("next").alias("reached"))
        found = written(found.unionByName(step).distinct(), "reached")
        before, n = n, found.count()
        if n == before:
            return found


def missing_causes(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """Effects with memories whose cause has none."""
    present = memories.select("signal_type").distinct()
    seen = edges.join(present.select(F.col("signal_type").alias("effect")), "effect", "left_semi")
    return seen.join(present.select(F.col("signal_type").alias("cause")), "cause", "left_anti").select("cause", "effect")


def cross_domain(memories: DataFrame, a: Column, b: Column) -> DataFrame:
    """Things that two ways of naming them both find: key, memories of each way, types."""
    left = memories.where(a.isNotNull()).groupBy(a.alias("entity")).agg(F.count("*").alias("in_a"), F.collect_set("signal_type").alias("ta"))
    right = memories.where(b.isNotNull()).groupBy(b.alias("entity")).agg(F.count("*").alias("in_b"), F.collect_set("signal_type").alias("tb"))
    return left.join(right, "entity").select("entity", "in_a", "in_b", F.array_join(F.array_sort(F.array_union("ta", "tb")), ",").alias("types"))


def severity_trend(signals: DataFrame, by: str = "signal_type", edge: float = 0.3) -> DataFrame:
    """Whether severities rise or fall on average from one signal of a group to the next.

    The mean of consecutive differences is (last - first) / (n - 1), so neither a sort nor a window is needed.
    """
    rank = severity_rank()
    ends = signals.groupBy(by).agg(F.count("*").alias("n"), F.min_by(rank, "seq").alias("first"), F.max_by(rank, "seq").alias("last"))
    mean = F.when(F.col("n") > 1, (F.col("last") - F.col("first")) / (F.col("n") - 1)).otherwise(0.0)
    return ends.select(by, F.round(mean, 6).alias("mean_change"), F.when(mean > edge, "escalating").when(mean < -edge, "deescalating").otherwise("stable").alias("trend"))


def overdue(expectations: DataFrame, signals: DataFrame, now_us: int) -> DataFrame:
    """Expected types (signal_type, interval_hours) not seen within their interval; never seen: null hours_overdue."""
    seen = signals.groupBy("signal_type").agg(F.max("us").alias("last_us"))
    late = (F.lit(now_us) - F.col("last_us")) / 3600e6 - F.col("interval_hours")
    return expectations.join(seen, "signal_type", "left").withColumn("hours_overdue", F.round(late, 2)).where(F.col("last_us").isNull() | (late > 0)).select("signal_type", "interval_hours", "hours_overdue")
