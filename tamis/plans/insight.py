"""Queries over sessions, causes, absences and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators import baselines, intelligence, inverse, pipeline
from tamis.operators.tables import written
from tamis.plans.recollection import MEMORIES, memories
from tamis.plans.registry import query
from tamis.plans.sieve import CASCADE_SQL, DECISIONS_SQL, cascade
from tamis.schema import CAUSES
from tamis.sources.adapters import SIGNALS_SQL, event_signals

GAP = 120_000_000
WITH = f"WITH RECURSIVE {SIGNALS_SQL}"
EDGES = "edges(cause, effect) AS (VALUES " + ", ".join(str(e) for e in CAUSES) + ")"
CLUSTERED = f"{WITH}, flags AS (SELECT *, coalesce(us - lag(us) OVER (ORDER BY us, seq) > {GAP}, false) AS new FROM signals), clustered AS (SELECT *, sum(new::INT) OVER (ORDER BY us, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM flags), firsts AS (SELECT session, signal_type, min(us) AS t FROM clustered GROUP BY ALL), pairs AS (SELECT a.signal_type AS a, b.signal_type AS b, count(*) AS together, count_if(a.t <= b.t)::BIGINT AS a_first, count_if(a.t > b.t)::BIGINT AS b_first FROM firsts a JOIN firsts b ON a.session = b.session AND a.signal_type < b.signal_type GROUP BY ALL)"


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CAUSES), "cause string, effect string")


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intelligence.sessions(event_signals(spark, sf_dir), GAP)


@query("entity_groups", f"{WITH} SELECT concat_ws(':', cluster, namespace, source) AS entity, count(*) AS members, count(DISTINCT signal_type) AS types FROM signals GROUP BY 1 ORDER BY members DESC, entity LIMIT 10")
def entity_groups(spark, sf_dir):
    groups = event_signals(spark, sf_dir).groupBy(F.concat_ws(":", "cluster", "namespace", "source").alias("entity")).agg(F.count("*").alias("members"), F.count_distinct("signal_type").alias("types"))
    return groups.orderBy(F.desc("members"), "entity").limit(10)


@query("time_clusters", f"{CLUSTERED} SELECT session, count(*) AS members, min(us) AS start_us, max(us) AS end_us, count(DISTINCT signal_type) AS types FROM clustered GROUP BY session")
def time_clusters(spark, sf_dir):
    return intelligence.session_table(clustered(spark, sf_dir))


@query("cooccurrence", f"{CLUSTERED} SELECT * FROM pairs")
def cooccurrence(spark, sf_dir):
    return intelligence.pair_counts(clustered(spark, sf_dir))


@query("rule_proposals", f"{CLUSTERED}, {EDGES}, n AS (SELECT signal_type, count(*) AS n FROM firsts GROUP BY 1), scored AS (SELECT p.*, together / least(x.n, y.n) AS support FROM pairs p JOIN n x ON x.signal_type = a JOIN n y ON y.signal_type = b WHERE together >= 5) SELECT CASE WHEN a_first >= b_first THEN a ELSE b END AS cause, CASE WHEN a_first >= b_first THEN b ELSE a END AS effect, together, round(support, 3) AS support, round(greatest(a_first, b_first) / greatest(1, a_first + b_first), 3) AS confidence FROM scored WHERE support >= 0.1 AND NOT EXISTS (SELECT 1 FROM edges WHERE least(cause, effect) = a AND greatest(cause, effect) = b)")
def rule_proposals(spark, sf_dir):
    return intelligence.propose_rules(clustered(spark, sf_dir), edges(spark), support=0.1)


@query("causal_links", f"{MEMORIES}, {EDGES} SELECT memory_id, cause, effect FROM memories JOIN edges ON cause = signal_type WHERE effect IN (SELECT signal_type FROM memories)")
def causal_links(spark, sf_dir):
    return intelligence.causal_links(memories(spark, sf_dir), edges(spark)).select("memory_id", "cause", "effect")


_SEEN = "SELECT DISTINCT signal_type, severity FROM signals"


@query(
    "causal_closure",
    f"{WITH}, {EDGES}, seen AS ({_SEEN}), held AS (SELECT DISTINCT a.signal_type || ':' || a.severity AS cause, b.signal_type || ':' || b.severity AS effect FROM edges e JOIN seen a ON a.signal_type = e.cause JOIN seen b ON b.signal_type = e.effect AND (b.severity = a.severity OR b.severity = 'critical')), reach(start, reached) AS (SELECT cause, effect FROM held UNION SELECT start, effect FROM reach JOIN held ON cause = reached) SELECT * FROM reach",
)
def causal_closure(spark, sf_dir):
    """All that follows, over any number of steps, from causes among the types and severities that the events hold."""
    seen = event_signals(spark, sf_dir).select("signal_type", "severity").distinct()
    name = lambda side: F.concat(F.col(f"{side}.signal_type"), F.lit(":"), F.col(f"{side}.severity"))
    e, a, b = edges(spark).alias("e"), seen.alias("a"), seen.alias("b")
    both = e.join(a, F.col("a.signal_type") == F.col("e.cause")).join(b, (F.col("b.signal_type") == F.col("e.effect")) & ((F.col("b.severity") == F.col("a.severity")) | (F.col("b.severity") == "critical")))
    return intelligence.closure(both.select(name("a").alias("cause"), name("b").alias("effect")).distinct())


@query("missing_causes", f"{MEMORIES}, {EDGES} SELECT cause, effect FROM edges WHERE effect IN (SELECT signal_type FROM memories) AND cause NOT IN (SELECT signal_type FROM memories)")
def missing_causes(spark, sf_dir):
    return intelligence.missing_causes(memories(spark, sf_dir), edges(spark))


@query("cross_domain_links", f"{MEMORIES}, a AS (SELECT namespace AS entity, count(*) AS in_a, list(DISTINCT signal_type) AS t FROM memories WHERE signal_type = 'pod_crashloop' GROUP BY 1), b AS (SELECT 'ns_' || CAST(CAST(cpu_percent AS INT) % 20 AS VARCHAR) AS entity, count(*) AS in_b, list(DISTINCT signal_type) AS t FROM memories WHERE signal_type = 'txn_purchase' GROUP BY 1) SELECT entity, in_a, in_b, array_to_string(list_sort(list_distinct(list_concat(a.t, b.t))), ',') AS types FROM a JOIN b USING (entity)")
def cross_domain_links(spark, sf_dir):
    a = F.when(F.col("signal_type") == "pod_crashloop", F.col("namespace"))
    b = F.when(F.col("signal_type") == "txn_purchase", F.concat(F.lit("ns_"), (F.col("cpu_percent").cast("int") % 20).cast("string")))
    return intelligence.cross_domain(memories(spark, sf_dir), a, b)


RANK = "CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END"


@query("severity_trend", f"{WITH}, d AS (SELECT source, {RANK} - lag({RANK}) OVER (PARTITION BY source ORDER BY seq) AS d FROM signals), m AS (SELECT source, coalesce(avg(d), 0) AS m FROM d GROUP BY 1) SELECT source, round(m, 6) AS mean_change, CASE WHEN m > 0.05 THEN 'escalating' WHEN m < -0.05 THEN 'deescalating' ELSE 'stable' END AS trend FROM m")
def severity_trend(spark, sf_dir):
    return intelligence.severity_trend(event_signals(spark, sf_dir), "source", 0.05)


@query("absence_overdue", f"{WITH}, want(signal_type, interval_hours) AS (VALUES ('heartbeat', 0.5), ('pod_crashloop', 0.25), ('backup_done', 24.0), ('txn_purchase', 1000.0)), seen AS (SELECT signal_type, max(us) AS last FROM signals GROUP BY 1) SELECT signal_type, CAST(interval_hours AS DOUBLE) AS interval_hours, round((epoch_us(TIMESTAMP '2024-01-31') - last) / 3600e6 - interval_hours, 2) AS hours_overdue FROM want LEFT JOIN seen USING (signal_type) WHERE last IS NULL OR (epoch_us(TIMESTAMP '2024-01-31') - last) / 3600e6 > interval_hours")
def absence_overdue(spark, sf_dir):
    want = spark.createDataFrame([("heartbeat", 0.5), ("pod_crashloop", 0.25), ("backup_done", 24.0), ("txn_purchase", 1000.0)], "signal_type string, interval_hours double")
    now = int(spark.sql("SELECT unix_micros(timestamp'2024-01-31')").first()[0])
    return intelligence.overdue(want, event_signals(spark, sf_dir), now)


ARCHIVE = CASCADE_SQL + DECISIONS_SQL + ", archive AS (SELECT signal_type, agent_name, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen, arg_min(outcome, signal_id) AS outcome, least(1.0, count(*) / 100.0)::DOUBLE AS strength FROM decisions WHERE outcome IN ('suppress', 'dedupe', 'drop') GROUP BY ALL)"


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverse.archive(pipeline.decisions(cascade(spark, sf_dir)))


@query("suppression_archive", ARCHIVE + " SELECT signal_type, agent_name, count, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us, outcome, strength FROM archive")
def suppression_archive(spark, sf_dir):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return archived(spark, sf_dir).withColumns({"first_us": us("first_seen"), "last_us": us("last_seen")}).drop("first_seen", "last_seen")


@query("expectations", ARCHIVE + ", t AS (SELECT sum(count) AS total FROM archive) SELECT signal_type, round(greatest(0.1, 1.0 / (sum(count) / greatest(1, any_value(total) / 100))), 2)::DOUBLE AS interval_hours FROM archive, t GROUP BY signal_type HAVING sum(count) >= 10 AND sum(count) / any_value(total) > 0.01")
def expectations(spark, sf_dir):
    return inverse.expectations(archived(spark, sf_dir))


BASELINE = ", normal AS (SELECT signal_type, sum(count)::BIGINT AS frequency, string_agg(DISTINCT agent_name, ',' ORDER BY agent_name) AS agents, max(strength) AS strength FROM archive GROUP BY 1)"


@query("baseline_snapshot", ARCHIVE + BASELINE + " SELECT * FROM normal")
def baseline_snapshot(spark, sf_dir):
    return inverse.baseline(archived(spark, sf_dir)).drop("first_seen")


@query("baseline_compare", ARCHIVE + BASELINE + ", then_ AS (SELECT * FROM normal WHERE signal_type <> 'heartbeat'), now_ AS (SELECT signal_type, count(*) AS now FROM signals WHERE signal_type <> 'probe_failure' GROUP BY 1) SELECT signal_type, coalesce(now, frequency) AS count, CASE WHEN frequency IS NULL THEN 'unexpected' ELSE 'missing' END AS reason FROM then_ FULL JOIN now_ USING (signal_type) WHERE frequency IS NULL OR (now IS NULL AND frequency > 10)")
def baseline_compare(spark, sf_dir):
    """One type that the baseline doesn't know, one that is gone."""
    normal = inverse.baseline(archived(spark, sf_dir)).where("signal_type <> 'heartbeat'")
    return inverse.compare(normal, event_signals(spark, sf_dir).where("signal_type <> 'probe_failure'"))


@query(
    "baseline_weeks",
    f"""{WITH}, e AS (SELECT us // 86400000000 // 7 AS week, signal_type AS kind, source, latency_ms FROM signals) SELECT week, kind, count(*) AS signals, min(latency_ms) AS low, max(latency_ms) AS high, true AS members_within, true AS quantiles_within FROM e GROUP BY week, kind""",
)
def baseline_weeks(spark, sf_dir):
    """Weeks merged from stored days: their counts, and whether members and quantiles are within the sketches' stated error
    of the exact ones."""
    signals = event_signals(spark, sf_dir)
    days = written(baselines.daily(signals, "signal_type", "us", "source", "latency_ms"), "days")
    weeks = written(baselines.estimates(baselines.merged(days, F.floor(F.col("day") / 7).alias("week"))), "weeks")
    rows = signals.select(F.floor(F.col("us") / 86_400_000_000 / 7).alias("week"), F.col("signal_type").alias("kind"), "source", "latency_ms")
    below = [F.struct(F.avg((F.col("latency_ms") < F.col(q)).cast("double")).alias("lo"), F.avg((F.col("latency_ms") <= F.col(q)).cast("double")).alias("hi")).alias(q) for q in ("q50", "q90", "q99")]
    exact = rows.join(weeks.select("week", "kind", "q50", "q90", "q99"), ["week", "kind"]).groupBy("week", "kind").agg(F.count_distinct("source").alias("sources"), *below)
    # half a row's rank more: groups are small
    off = lambda q, at: (F.col(f"x.{q}.lo") <= at + 2 * baselines.RANK_ERROR + 1 / F.col("signals")) & (F.col(f"x.{q}.hi") >= at - 2 * baselines.RANK_ERROR - 1 / F.col("signals"))
    both = weeks.alias("w").join(exact.select("week", "kind", F.struct("sources", "q50", "q90", "q99").alias("x")), ["week", "kind"])
    members = F.abs(F.col("members") - F.col("x.sources")) <= baselines.members_error(F.col("x.sources"))
    return both.select("week", "kind", "signals", "low", "high", members.alias("members_within"), (off("q50", 0.5) & off("q90", 0.9) & off("q99", 0.99)).alias("quantiles_within"))


@query("health_score", MEMORIES + ", s AS (SELECT count(*) AS memories, avg(strength) AS m, stddev_pop(strength) AS d FROM memories), x AS (SELECT memories, round(greatest(0, least(100, 100 - least(30, 2 / 5 * 30.0) - least(20, 1 * 5.0) - least(20, greatest(0, 0.3 - m) * 66.7) - least(20, d * 20.0))), 1)::DOUBLE AS score FROM s) SELECT memories, score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS grade FROM x")
def health_score(spark, sf_dir):
    return inverse.health(memories(spark, sf_dir), F.lit(2), F.lit(5), F.lit(1))


@query("biography_noise", f"{WITH} SELECT signal_type, count_if(contains(answer, 'routine_noise') OR contains(answer, 'known_pattern'))::BIGINT AS noise, count(*) AS total, round(100.0 * count_if(contains(answer, 'routine_noise') OR contains(answer, 'known_pattern')) / count(*), 2)::DOUBLE AS noise_pct FROM signals GROUP BY 1 ORDER BY noise DESC, signal_type LIMIT 15")
def biography_noise(spark, sf_dir):
    from tamis.operators.promotion import is_noise

    made = event_signals(spark, sf_dir).groupBy("signal_type").agg(F.count_if(is_noise()).alias("noise"), F.count("*").alias("total"))
    return made.withColumn("noise_pct", F.round(100.0 * F.col("noise") / F.col("total"), 2)).orderBy(F.desc("noise"), "signal_type").limit(15)


@query("biography_top", MEMORIES + "SELECT memory_id, signal_type, severity, occurrences, round(strength, 6) AS strength FROM memories ORDER BY memories.strength DESC, memory_id LIMIT 20")
def biography_top(spark, sf_dir):
    return memories(spark, sf_dir).orderBy(F.desc("strength"), "memory_id").limit(20).select("memory_id", "signal_type", "severity", "occurrences", F.round("strength", 6).alias("strength"))
