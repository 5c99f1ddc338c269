"""Survivors kept as memories: one row for each different content, whose strength grows, decays and is bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators import pipeline
from tamis.operators.agents import Agent
from tamis.operators.places import lowest
from tamis.schema import SEVERITY_WEIGHTS


def normal_text(text: str | Column) -> Column:
    """Text without what changes from one event to the next: UUIDs, times, generated name suffixes."""
    text = F.col(text) if isinstance(text, str) else text
    text = F.regexp_replace(text, r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>")
    text = F.regexp_replace(text, r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[^\s]*", "<ts>")
    return F.regexp_replace(text, r"(?<=\w)-[a-z0-9]{5,10}(?=\s|$)", "")


# Fields that say where, which make contents different.
PRESERVED = (
    "location", "span_id", "circuit_id", "node", "host", "region", "zone", "rack", "site", "sector", "patient_id",
    "account_id", "circuit", "prefix", "service", "instance",
)


def normal_content(content: Column) -> Column:
    """A map of texts by field, each without what changes from one event to the next, but for PRESERVED."""
    return F.transform_values(content, lambda k, v: F.when(k.isin(*PRESERVED), v).otherwise(normal_text(v)))


def content_hash(normalized: list[str], kept: list[str] = ()) -> Column:
    """sha256 of the type and the content; fields that say where (kept) go in unchanged."""
    parts = [F.concat(F.lit(f"{c}="), normal_text(c) if c in normalized else F.col(c).cast("string")) for c in sorted([*normalized, *kept])]
    return F.sha2(F.concat_ws("|", "signal_type", *parts), 256)


def weight(severity: str = "severity") -> Column:
    found = F
    for name, value in SEVERITY_WEIGHTS.items():
        found = found.when(F.col(severity) == name, F.lit(value))
    return found.otherwise(F.lit(SEVERITY_WEIGHTS["medium"]))


def reinforced(strength: Column, times: Column) -> Column:
    """A tenth of what is missing to 1 is gained each time; in closed form."""
    return 1 - (1 - strength) * F.pow(F.lit(0.9), times)


def form(signals: DataFrame, normalized: list[str], kept: list[str] = ()) -> DataFrame:
    """Memories of signals: the first of each content gives severity and labels, the others make it stronger. One grouped
    aggregation with partial sums, so a content that floods costs a row per task."""
    hashed = signals.withColumn("content_hash", content_hash(normalized, kept))
    first = F.min(F.struct("seq", "us", "severity", "source", "namespace", "cluster", "label", "message", "cpu_percent", "latency_ms"))
    grouped = hashed.groupBy("content_hash", "signal_type").agg(first.alias("first"), F.count("*").alias("occurrences"), F.max("us").alias("modified_us"))
    rows = grouped.select("content_hash", "signal_type", F.col("first.seq").alias("memory_id"), "first.severity", "first.source", "first.namespace", "first.cluster", "first.label", "first.message", "first.cpu_percent", "first.latency_ms", F.col("first.us").alias("formed_us"), "modified_us", "occurrences")
    return rows.withColumn("strength", reinforced(weight(), F.col("occurrences") - 1))


def united(memories: DataFrame) -> DataFrame:
    """One memory of each content: the first one's facts, all occurrences, the strength that these give."""
    whole = ("content_hash", "occurrences", "modified_us", "strength")
    first = F.min_by(F.struct(*(c for c in memories.columns if c not in whole)), "memory_id").alias("f")
    sums = [F.sum("occurrences").alias("occurrences"), F.max("modified_us").alias("modified_us")]
    merged = memories.groupBy("content_hash").agg(first, *sums).select("content_hash", "f.*", "occurrences", "modified_us")
    return merged.withColumn("strength", reinforced(weight(), F.col("occurrences") - 1)).select(*memories.columns)


def decay(memories: DataFrame, rates: DataFrame, hours: Column, default: float = 0.01) -> DataFrame:
    """strength * exp(-rate * hours) with each type's rate (rates: signal_type, rate)."""
    rate = F.coalesce("rate", F.lit(default))
    return memories.join(rates, "signal_type", "left").withColumn("strength", F.greatest(F.col("strength") * F.exp(-rate * hours), F.lit(0.0))).drop("rate")


def evict(memories: DataFrame, capacity: int, fraction: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(kept, evicted): where there are more than `capacity`, the weakest go until a fraction of the capacity is free."""
    n = memories.count()
    if n <= capacity:
        return memories, memories.limit(0)
    keep = max(0, capacity - max(1, int(capacity * fraction)))
    gone = lowest(memories, n - keep, "strength", "memory_id")
    return memories.join(gone.select("memory_id"), "memory_id", "left_anti"), gone


def search(memories: DataFrame, signal_type: str | None = None, labels: dict[str, str] | None = None, least: float = 0.0, limit: int = 100) -> DataFrame:
    found = memories.where(F.col("strength") >= least)
    if signal_type is not None:
        found = found.where(F.col("signal_type") == signal_type)
    for name, value in (labels or {}).items():
        found = found.where(F.col(name) == value)
    return found.orderBy(F.desc("strength"), "memory_id").limit(limit)


def export(memories: DataFrame, since_us: int, least: float = 0.0) -> DataFrame:
    """What changed since a time, for another instance."""
    return memories.where((F.col("strength") >= least) & (F.coalesce("modified_us", "formed_us") >= since_us))


def receive(local: DataFrame, incoming: DataFrame, rejected: DataFrame) -> DataFrame:
    """Memories after an import: content once rejected stays out, known content gets stronger, other content is added.
    rejected: content_hash."""
    wanted = incoming.join(rejected.select("content_hash").distinct(), "content_hash", "left_anti")
    times = wanted.groupBy("content_hash").agg(F.count("*").alias("times"))
    known = local.join(times, "content_hash", "left").withColumn("strength", F.least(F.lit(1.0), reinforced(F.col("strength"), F.coalesce("times", F.lit(0))))).withColumn("origin", F.when(F.col("times").isNotNull(), "reinforced").otherwise("local")).drop("times")
    new = wanted.join(local.select("content_hash"), "content_hash", "left_anti").withColumn("origin", F.lit("imported"))
    return known.unionByName(new, allowMissingColumns=True)


def consolidate(memories: DataFrame, agents: list[Agent], boost: float = 0.05, penalty: float = 0.3, least: float = 0.05) -> DataFrame:
    """Memories run through the cascade again as one batch: what survives gets a boost, what an agent removes a penalty, and
    what falls below `least` is evicted. What goes only as info or classified changes nothing."""
    run = pipeline.annotate(memories.withColumnRenamed("memory_id", "signal_id").withColumn("seq", F.col("signal_id")), agents)
    hit = F.exists(F.array(*(F.coalesce(F.col(c)["outcome"].isin(*pipeline.REMOVING), F.lit(False)) for c in pipeline.decision_columns(run))), lambda x: x)
    change = F.when(F.col("survives"), F.least(F.col("strength") + boost, F.lit(1.0))).when(hit, F.greatest(F.col("strength") - penalty, F.lit(0.0))).otherwise(F.col("strength"))
    status = F.when(F.col("survives"), "survived").when(hit, "suppressed").otherwise("unchanged")
    made = run.select(F.col("signal_id").alias("memory_id"), "signal_type", change.alias("strength"), status.alias("status"))
    return made.withColumn("evicted", F.col("strength") < least)


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key of both."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new"))
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")
