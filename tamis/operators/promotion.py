"""Rules climb and fall by what labelled outcomes say about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.schema import TIER_REQUIREMENTS, TIERS

ACTIVATED = ("nano", "micro", "macro")


def is_noise(answer: str = "answer") -> Column:
    return F.contains(F.col(answer), F.lit("routine_noise")) | F.contains(F.col(answer), F.lit("known_pattern"))


def label_counts(labelled: DataFrame) -> DataFrame:
    """Noise and important answers by type, and by type and namespace (level 'type' or 'context')."""
    counts = labelled.groupingSets([["signal_type"], ["signal_type", "namespace"]], "signal_type", "namespace").agg(F.count_if(is_noise()).alias("noise"), F.count_if(~is_noise()).alias("important"), F.grouping("namespace").alias("g"))
    return counts.select("signal_type", F.when(F.col("g") == 1, "").otherwise(F.col("namespace")).alias("namespace"), F.when(F.col("g") == 1, "type").otherwise("context").alias("level"), "noise", "important")


def promote_types(counts: DataFrame, least: int = 200, share: float = 0.0) -> DataFrame:
    """Types with at least `least` answers of which at most `share` are important: what may be suppressed. 0: live; 0.02:
    what counts when state is restored."""
    total = F.col("noise") + F.col("important")
    rows = counts.where("level = 'type'").withColumn("samples", total).withColumn("important_rate", F.col("important") / total)
    return rows.where((F.col("samples") >= least) & (F.col("important_rate") <= share)).select("signal_type", "samples", "important", "important_rate")


def promote_contexts(counts: DataFrame, active: DataFrame, least: int = 100, share: float = 0.02) -> DataFrame:
    """(type, namespace) pairs that are noise though their type as a whole isn't active."""
    total = F.col("noise") + F.col("important")
    rows = counts.where("level = 'context' and namespace <> ''").join(active, "signal_type", "left_anti").withColumn("samples", total).withColumn("important_rate", F.col("important") / total)
    return rows.where((F.col("samples") >= least) & (F.col("important_rate") <= share)).select("signal_type", "namespace", "samples", "important", "important_rate")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """Metrics of boolean columns flagged and abnormal, by group."""
    f, a = F.coalesce("flagged", F.lit(False)), F.coalesce("abnormal", F.lit(False))
    counts = rows.groupBy(*by).agg(F.count("*").alias("samples"), F.count_if(f & a).alias("tp"), F.count_if(f & ~a).alias("fp"), F.count_if(~f & ~a).alias("tn"), F.count_if(~f & a).alias("fn"))
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    made = counts.withColumns({"accuracy": ratio(tp + tn, F.col("samples")), "false_positive_rate": ratio(fp, fp + tn), "false_negative_rate": ratio(fn, fn + tp), "coverage": ratio(tp + fp, F.col("samples"))})
    return made.withColumn("rubric_status", rubric())


def rubric() -> Column:
    return F.when(F.col("false_negative_rate") > 0.20, "red").when((F.col("accuracy") >= 0.75) & (F.col("false_positive_rate") <= 0.15), "green").when(F.col("accuracy") >= 0.60, "yellow").otherwise("red")


def next_tier(agents: DataFrame, human_gate: bool = False) -> DataFrame:
    """agents (tier, samples, accuracy, rates, human_reviewed, human_approved, deactivated) with new_tier: a step up where
    the next tier's requirements are met, down to draft where an activated rule missed anything."""
    now = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    step = F.col("tier")
    for tier, samples, accuracy, positives, negatives, reviewed in TIER_REQUIREMENTS:
        meets = (F.col("samples") >= samples) & (F.col("accuracy") >= accuracy) & (F.col("false_positive_rate") <= positives) & (F.col("false_negative_rate") <= negatives)
        if reviewed:
            meets = meets & F.coalesce("human_reviewed", F.lit(False))
        to = "pending_approval" if human_gate and tier == "nano" else tier
        step = F.when((now == TIERS.index(tier)) & meets, F.lit(to)).otherwise(step)
    step = F.when((F.col("tier") == "pending_approval") & F.coalesce("human_approved", F.lit(False)), F.lit("nano")).otherwise(step)
    fell = F.col("tier").isin(*ACTIVATED) & (F.col("fn") > 0)
    return agents.withColumn("new_tier", F.when(F.coalesce("deactivated", F.lit(False)), F.col("tier")).when(fell, F.lit("draft")).otherwise(step)).withColumn("deactivated", F.coalesce("deactivated", F.lit(False)) | fell)


def walk_types(counts: DataFrame, least: int = 200, most_important: int = 0) -> DataFrame:
    """Types (counts of level 'type': signal_type, noise, important) as rules that climb from draft as far as their answers
    carry them, nano at most: samples, important, accuracy, rates, rubric_status, tier, activated. A type is activated at
    nano with at least `least` answers of which at most `most_important` are important. Types without answers have no row."""
    total = F.col("noise") + F.col("important")
    rows = counts.where((F.col("level") == "type") & (total > 0))
    rows = rows.select("signal_type", total.alias("samples"), "important", (F.col("noise") / total).alias("accuracy"), (F.col("important") / total).alias("false_positive_rate"))
    enough = (F.col("samples") >= least) & (F.col("important") <= most_important)
    rows = rows.withColumns({"false_negative_rate": F.col("false_positive_rate"), "fn": F.lit(0), "tier": F.lit("draft"), "rubric_status": F.when(enough, "green").otherwise("red")})
    rows = rows.withColumns({c: F.lit(False) for c in ("human_reviewed", "human_approved", "deactivated")})
    for _ in ("candidate", "nano"):
        rows = next_tier(rows).withColumn("tier", F.col("new_tier")).drop("new_tier")
    return rows.withColumn("activated", (F.col("tier") == "nano") & enough).drop("fn", "human_reviewed", "human_approved", "deactivated")


def walk_events(walked: DataFrame) -> DataFrame:
    """What a walk says in the log: a row where a type left draft, and one where it was activated."""
    event = lambda name, status: F.struct(F.lit(name).alias("event"), status.alias("status"))
    said = F.array_compact(F.array(
        F.when(F.col("tier") != "draft", event("promoted", F.col("rubric_status"))),
        F.when(F.col("activated"), event("activated", F.lit("validated"))),
    ))
    return walked.withColumn("e", F.explode(said)).select("signal_type", "e.event", "tier", "e.status", "samples", "important")


def demotions(agents: DataFrame) -> DataFrame:
    """An event for each activated rule (name, tier, samples, accuracy, rates, fn) that missed anything: it falls to draft."""
    fell = agents.where(F.col("tier").isin(*ACTIVATED) & (F.col("fn") > 0) & ~F.coalesce("deactivated", F.lit(False)))
    reason = F.concat(F.col("fn").cast("string"), F.lit(" false negative(s) in validation batch"))
    return fell.select(F.col("name").alias("agent_name"), F.lit("demotion").alias("event_type"), F.col("tier").alias("from_tier"), F.lit("draft").alias("to_tier"), F.col("samples").alias("samples_tested"), "accuracy", "false_positive_rate", "false_negative_rate", F.col("fn").alias("false_negative_count"), reason.alias("reason"))


def rubric_matrix(agents: DataFrame) -> DataFrame:
    counts = agents.agg(F.count("*").alias("total"), F.count_if(F.col("rubric_status") == "green").alias("green"), F.count_if(F.col("rubric_status") == "yellow").alias("yellow"))
    counts = counts.withColumn("red", F.col("total") - F.col("green") - F.col("yellow"))
    overall = F.when(F.col("total") == 0, "red").when(F.col("green") / F.col("total") >= 0.5, "green").when((F.col("green") + F.col("yellow")) / F.col("total") >= 0.3, "yellow").otherwise("red")
    return counts.withColumn("overall", overall)


def evaluate_rules(readings: DataFrame, rules: DataFrame) -> DataFrame:
    """readings (signal_id, field, value as text) against rules (name, field, op, operand as text): flagged. Both as numbers
    if both are, else as text; a missing value is no match. Spark broadcasts rules by their size."""
    a, b = F.expr("try_cast(value as double)"), F.expr("try_cast(operand as double)")
    numbers = a.isNotNull() & b.isNotNull()
    joined = readings.join(rules, "field")
    flagged = F
    for op, test in {"gt": lambda x, y: x > y, "lt": lambda x, y: x < y, "gte": lambda x, y: x >= y, "lte": lambda x, y: x <= y, "eq": lambda x, y: x == y, "ne": lambda x, y: x != y}.items():
        flagged = flagged.when(F.col("op") == op, F.when(numbers, test(a, b)).otherwise(test(F.col("value"), F.col("operand"))))
    flagged = flagged.when(F.col("op") == "contains", F.contains("value", "operand"))
    return joined.withColumn("flagged", F.coalesce(flagged, F.lit(False)))


def abnormal(readings: DataFrame, baseline: DataFrame) -> DataFrame:
    """signal_id and abnormal: whether any reading lies outside its type's range (baseline: signal_type, field, low, high)."""
    value = F.expr("try_cast(value as double)")
    joined = readings.join(baseline, ["signal_type", "field"], "left")
    return joined.groupBy("signal_id").agg(F.coalesce(F.bool_or((value < F.col("low")) | (value > F.col("high"))), F.lit(False)).alias("abnormal"))


def feedback(counts: DataFrame, reports: DataFrame) -> DataFrame:
    """Types that feedback (signal_type, was_suppressed, is_important) takes out of suppression: those with a miss."""
    missed = reports.where("was_suppressed and is_important").groupBy("signal_type").agg(F.count("*").alias("misses"))
    return counts.join(missed, "signal_type", "left").withColumn("misses", F.coalesce("misses", F.lit(0))).withColumn("active", F.col("misses") == 0)
