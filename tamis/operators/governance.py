"""The engine about itself: its events as signals, alarms on its state, reports, ledger records, and cycles of memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators.places import lowest

ACTIVE_TIERS = ("nano", "micro", "macro")


# ---------------------------------------------------------------- its own events


def meta_signals(events: DataFrame) -> DataFrame:
    """events (agent_name, event_type, from_tier, to_tier) of agents' tiers as signals: the fall of an active agent is
    grave, the rise to an active tier isn't nothing."""
    fell, rose = F.col("event_type") == "demotion", F.col("event_type") == "promotion"
    was, now = (F.coalesce(F.col(c).isin(*ACTIVE_TIERS), F.lit(False)) for c in ("from_tier", "to_tier"))
    severity = F.when(fell & was, "high").when(fell | (rose & now), "medium").otherwise("info")
    text = F.concat(
        F.lit("Agent '"), "agent_name", F.lit("' "), "event_type", F.lit(": "), F.coalesce("from_tier", F.lit("")),
        F.lit(" → "), F.coalesce("to_tier", F.lit("")),
    )
    kind = F.concat(F.lit("cascade_"), F.coalesce("event_type", F.lit("unknown")))
    return events.withColumns({"signal_type": kind, "severity": severity, "source": F.col("agent_name"), "namespace": F.lit("cascade-meta"), "message": text})


def meta_alerts(states: DataFrame) -> DataFrame:
    """Alarms on states (memories, capacity, buffered, buffer, busy, threads, processed, evicted): memory or a buffer with
    all its threads busy over 80 %, more than a tenth of memories gone at once."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    alert = lambda test, kind, severity, value: F.when(test, F.struct(F.lit(kind).alias("signal_type"), F.lit(severity).alias("severity"), F.round(value, 3).alias("level")))
    memory, buffer = share("memories", "capacity"), share("buffered", "buffer")
    gone = F.when(F.col("processed") > 0, F.col("evicted") / F.col("processed"))
    found = F.array_compact(
        F.array(
            alert(memory > 0.8, "meta_memory_pressure", "medium", memory),
            alert((buffer > 0.8) & (F.col("busy") >= F.col("threads")), "meta_llm_starvation", "high", buffer),
            alert(gone > 0.1, "meta_consolidation_eviction_spike", "high", gone),
        )
    )
    return states.withColumn("_a", F.explode(found)).select("*", "_a.*").drop("_a")


def inverse_report(suppressed: DataFrame, memories: DataFrame, edges: DataFrame) -> DataFrame:
    """One row over suppressed patterns (signal_type, count) and memories (signal_type): normal types and the most frequent
    of them, causes that are missing for effects with memories, and how the two compare."""
    types = suppressed.groupBy("signal_type").agg(F.sum("count").alias("frequency"))
    ranked = types.orderBy(F.desc("frequency"), "signal_type").limit(10)
    top = ranked.agg(F.array_sort(F.collect_list(F.struct((-F.col("frequency")).alias("f"), "signal_type"))).alias("t"))
    top = top.select(F.array_join(F.transform("t", lambda x: x["signal_type"]), ",").alias("top_normal"))
    present = memories.select("signal_type").distinct()
    effects = edges.join(present.select(F.col("signal_type").alias("effect")), "effect", "left_semi")
    gaps = effects.join(present.select(F.col("signal_type").alias("cause")), "cause", "left_anti")
    one = suppressed.agg(F.count("*").alias("suppression_patterns"))
    for table, name in ((types, "normal_signal_types"), (memories, "memories"), (gaps, "causal_gaps")):
        one = one.join(table.agg(F.count("*").alias(name)))  # one row each
    one = one.join(top)
    ratio = F.round(F.col("memories") / F.greatest(F.lit(1), "suppression_patterns"), 3)
    much = F.col("suppression_patterns") > F.col("memories") * 5
    said = F.when(much, "The system suppresses far more than it remembers").otherwise("Memory and suppression are balanced")
    return one.withColumns({"ratio": ratio, "interpretation": said})


# ---------------------------------------------------------------- ledger


def ledger_records(decisions: DataFrame, signals: DataFrame, *fields: str) -> DataFrame:
    """A record for each decision (signal_id, agent_pos, agent_name, outcome): what its signal says (missing: ''), as JSON
    with keys in order, hashes of the input and of the whole, each record once however often it was sent."""
    about = signals.select("signal_id", *fields)
    joined = decisions.join(about, "signal_id", "left").select(*decisions.columns, *(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields))
    canonical = lambda names: F.to_json(F.struct(*(F.col(n).cast("string").alias(n) for n in sorted(names))))
    made = joined.withColumn("input_hash", F.sha2(canonical(fields), 256))
    made = made.withColumn("record", canonical([*fields, "agent_name", "outcome", "signal_id", "input_hash"]))
    made = made.withColumn("idempotency_key", F.sha2(F.concat_ws(":", "signal_id", "agent_name", "outcome", "input_hash"), 256))
    return made.dropDuplicates(["idempotency_key"])


def failed_verdicts(reports: DataFrame, built_in: tuple[str, ...], after: Column) -> DataFrame:
    """Reports (agent_name, verdict, us) of learned agents that fail, past a high-water mark."""
    return reports.where((F.upper("verdict") == "FAILS") & ~F.col("agent_name").isin(*built_in) & (F.col("us") > after))


# ---------------------------------------------------------------- memory


def reinforce_recalled(memories: DataFrame, recalls: DataFrame) -> DataFrame:
    """memories (memory_id, strength, recall_count) after recalls (memory_id, us): each gives a tenth of what is missing to
    full strength."""
    counts = recalls.groupBy("memory_id").agg(F.count("*").alias("_n"), F.max("us").alias("_us"))
    n = F.coalesce("_n", F.lit(0))
    return memories.join(counts, "memory_id", "left").withColumns({
        "strength": F.when(n > 0, F.least(F.lit(1.0), 1 - (1 - F.col("strength")) * F.pow(F.lit(0.9), n))).otherwise(F.col("strength")),
        "recall_count": F.col("recall_count") + n,
        "last_recalled_us": F.col("_us"),
    }).drop("_n", "_us")


def consolidation_batch(memories: DataFrame, size: int, threshold: float = 0.05) -> DataFrame:
    """Memories that a cycle looks at: all that are nearly gone (below twice the threshold), and of the others those looked
    at longest ago, never first, up to `size` in all. size 0: all."""
    if not size:
        return memories
    urgent = memories.where(F.col("strength") < 2 * threshold)
    rest = memories.where(F.col("strength") >= 2 * threshold).withColumn("_at", F.coalesce("consolidated_us", F.lit(-1)))
    left = max(0, size - urgent.count())
    return urgent.unionByName(lowest(rest, left, "_at", "memory_id").drop("_at"))


def rejected(earlier: DataFrame, evicted: DataFrame, most: int) -> DataFrame:
    """The latest `most` contents (content_hash, seq) that were evicted; one evicted again keeps its place."""
    both = earlier.select("content_hash", "seq").unionByName(evicted.select("content_hash", "seq")).where("content_hash <> ''")
    first = both.groupBy("content_hash").agg(F.min("seq").alias("seq"))
    return lowest(first.withColumn("_o", -F.col("seq")), most, "_o", "content_hash").drop("_o")


def priming_set(windows: DataFrame, most: int = 10) -> DataFrame:
    """Windows of attention (signal_type, seq, hours) that stay open: the last one of each type, of the types that were
    opened last. A type that is opened again keeps the place of its first window."""
    of_type = windows.groupBy("signal_type").agg(F.min("seq").alias("first"), F.max_by("hours", "seq").alias("hours"))
    place = F.row_number().over(Window.orderBy(F.desc("first")))  # a row for each type
    return of_type.withColumn("_r", place).where(F.col("_r") <= most).drop("_r")


def strongest(patterns: DataFrame, capacity: int, strength: str, *order: str) -> DataFrame:
    """What stays of patterns when the weakest go until `capacity` are left."""
    n = patterns.count()
    if n <= capacity:
        return patterns
    ranked = patterns.withColumn("_s", -F.col(strength))
    return lowest(ranked, capacity, "_s", *order).drop("_s")


def rings(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The latest `most` rows of each key; Spark cuts each task's rows to that before it shuffles."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


# ---------------------------------------------------------------- claims about the work


def workload_claims(decisions: DataFrame) -> DataFrame:
    """What decisions (agent, subject_type, severity, outcome, confidence, namespace) say about the work, a row for each
    statement: name, description. Shares are whole percent, cut. No decisions, no statements."""
    pct = lambda n: F.floor(n * 100 / F.col("total")).cast("long")
    total = decisions.agg(F.count("*").alias("total")).where("total > 0")
    text = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    row = lambda name, said: (name.alias("name"), said.alias("description"))

    agents = decisions.groupBy(F.coalesce("agent", F.lit("unknown")).alias("k")).agg(F.count("*").alias("n")).join(total)
    effective = agents.where(pct(F.col("n")) >= 5).select(*row(text("agent-", F.col("k"), "-effectiveness"), text("Agent '", F.col("k"), "' handles ", pct(F.col("n")), "% of decisions")))
    types = decisions.groupBy("subject_type").agg(F.count("*").alias("n"), F.count_distinct("agent").alias("agents"))
    first = types.agg(F.max_by(F.struct("subject_type", "n"), F.struct("n", "subject_type")).alias("t")).join(total)
    dominant = first.where(pct(F.col("t.n")) > 30).select(*row(F.lit("dominant-signal-type"), text("Signal type '", F.col("t.subject_type"), "' dominates at ", pct(F.col("t.n")), "%")))
    multi = types.agg(F.count_if(F.col("agents") > 1).alias("m")).where("m > 0")
    routing = multi.select(*row(F.lit("multi-agent-routing"), text(F.col("m"), " signal types require multiple agents")))
    of = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    grave = decisions.where(F.col("severity").isin("critical", "high")).groupBy("severity")
    grave = grave.agg(of("drop", "suppress").alias("d"), of("keep", "classify", "escalate").alias("k"), of("dedupe").alias("x")).where("d + k + x > 0")
    safety = grave.select(*row(text("safety-", F.col("severity"), "-severity"), text(F.col("severity"), "-severity: ", F.col("d"), " suppressed, ", F.col("k"), " classified, ", F.col("x"), " deduped")))
    c = F.coalesce("confidence", F.lit(0.0))
    bands = decisions.agg(F.count("*").alias("total"), F.count_if(c >= 0.9).alias("h"), F.count_if((c >= 0.5) & (c < 0.9)).alias("m"), F.count_if(c < 0.5).alias("l"), of("dedupe", "suppress", "drop").alias("z")).where("total > 0")
    confidence = bands.select(*row(F.lit("confidence-distribution"), text("Confidence: ", pct(F.col("h")), "% high, ", pct(F.col("m")), "% medium, ", pct(F.col("l")), "% low")))
    compression = bands.select(*row(F.lit("self-tuning-compression"), text("Fleet achieved ", pct(F.col("z")), "% compression with zero human rules")))
    spaces = decisions.groupBy(F.coalesce("namespace", F.lit("")).alias("ns")).agg(F.count("*").alias("n"))
    top = spaces.agg(F.max_by(F.struct("ns", "n"), F.struct("n", "ns")).alias("t")).join(total)
    hotspot = top.where(pct(F.col("t.n")) > 30).select(*row(F.lit("namespace-hotspot"), text("'", F.col("t.ns"), "' namespace generates ", pct(F.col("t.n")), "% of signals")))
    out = effective
    for made in (dominant, routing, safety, confidence, hotspot, compression):
        out = out.unionByName(made)
    return out
