"""Queries over the cascade and its agents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis import schema
from tamis.operators import agents, pipeline
from tamis.operators.places import lowest
from tamis.plans.registry import query
from tamis.sources.adapters import SIGNALS_SQL, event_signals

DAY = 86_400
BYPASS = "label IN ('compliance', 'fraud', 'sanctions')"


def _matches(pattern: str) -> str:
    return f"regexp_matches(content_text, '{pattern}')"


_PATTERN_CASE = "CASE " + " ".join(f"WHEN {_matches(p)} THEN '{kind}'" for _, p, kind in schema.PATTERNS) + " END"
_MOVES = "(({b} < {c} AND {c} < {d}) OR ({b} > {c} AND {c} > {d})) AND CASE WHEN {b} <> 0 THEN abs(({d} - {b}) / {b}) * 100 >= 5 ELSE true END"
_SWINGS = "({b} - {a}) * ({c} - {b}) < 0 AND ({c} - {b}) * ({d} - {c}) < 0"
_LAGS = ", ".join(f"lag({f}, {n}) OVER (PARTITION BY source ORDER BY seq) AS {f}{n}" for f in ("cpu_percent", "latency_ms") for n in (1, 2, 3))


def _each(form: str) -> str:
    return " OR ".join(f"coalesce({form.format(d=f, c=f'{f}1', b=f'{f}2', a=f'{f}3')}, false)" for f in ("cpu_percent", "latency_ms"))


#: The cascade, agent by agent.
CASCADE_SQL = f"""
WITH {SIGNALS_SQL},
texts AS (SELECT *, 'message: ' || message || ', cpu_percent: ' || CAST(cpu_percent AS VARCHAR) AS content_text, concat_ws(':', signal_type, source, namespace, severity, message) AS key, {_LAGS} FROM signals),
a0 AS (SELECT *, ({_each(_MOVES)}) OR ({_each(_SWINGS)}) AS e0 FROM texts),
a1 AS (SELECT *, NOT {BYPASS} AND row_number() OVER (PARTITION BY CASE WHEN {BYPASS} THEN '-' || seq ELSE key END ORDER BY seq) > 1 AS dd FROM a0),
a2 AS (SELECT *, dd AND NOT e0 AS r1 FROM a1),
a3 AS (SELECT *, NOT r1 AND signal_type IN ('pod_restart', 'container_backoff', 'probe_failure', 'dns_timeout') AND severity IN ('info', 'low') AND NOT {_matches(schema.NEVER_SUPPRESS)} AS sup FROM a2),
a4 AS (SELECT *, r1 OR (sup AND NOT e0) AS r2 FROM a3),
a5 AS (SELECT *, NOT r2 AND severity = 'info' AND NOT {BYPASS} AS gated, {_matches(schema.ESCALATE)} AS loud FROM a4),
a6 AS (SELECT *, r2 OR (gated AND NOT loud AND NOT e0) AS r3, e0 OR (gated AND loud) AS e3 FROM a5),
a7 AS (SELECT *, CASE WHEN NOT r3 THEN {_PATTERN_CASE} END AS pc FROM a6),
a8 AS (SELECT *, r3 OR (pc IS NOT NULL AND severity = 'info' AND NOT e3) AS r4 FROM a7),
a9 AS (SELECT *, CASE WHEN NOT r4 THEN CASE WHEN cpu_percent > 95 THEN 'cpu_critical' WHEN cpu_percent > 80 THEN 'cpu_warning' END END AS tc FROM a8),
cascade AS (SELECT *, r4 OR (tc = 'cpu_warning' AND severity = 'info' AND NOT e3) IS TRUE AS r5, e3 OR (tc = 'cpu_critical') IS TRUE AS e5 FROM a9),
done AS (SELECT *, NOT r5 AND (severity <> 'info' OR e5) AS survives FROM cascade)
"""


def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.annotate(event_signals(spark, sf_dir))


@query(
    "pipeline_summary",
    CASCADE_SQL
    + """SELECT count(*) AS total, count_if(sup AND NOT e0)::BIGINT AS suppressed, count_if(dd AND NOT e0)::BIGINT AS deduped, (count_if(gated AND NOT loud) + count_if(NOT r5 AND NOT survives))::BIGINT AS dropped,
    (count_if(e0) + count_if(gated AND loud) + count_if(tc = 'cpu_critical'))::BIGINT AS escalated, (count_if(pc IS NOT NULL) + count_if(tc = 'cpu_warning'))::BIGINT AS classified, count_if(survives)::BIGINT AS remaining,
    CAST(count(*) - count_if(survives) AS DOUBLE) / count(*) AS compression_ratio FROM done""",
)
def pipeline_summary(spark, sf_dir):
    return pipeline.summary(cascade(spark, sf_dir))


@query("pipeline_survivors", CASCADE_SQL + "SELECT signal_id, signal_type, severity, e5 AS escalated, coalesce(pc, tc, '') AS classification FROM done WHERE survives")
def pipeline_survivors(spark, sf_dir):
    return pipeline.survivors(cascade(spark, sf_dir)).select("signal_id", "signal_type", "severity", "escalated", "classification")


DECISIONS_SQL = """, decisions AS (
SELECT signal_id, signal_type, namespace, ts, 0 AS agent_pos, 'trend_detector' AS agent_name, 'escalate' AS outcome, CAST(NULL AS VARCHAR) AS classification, 0.85 AS confidence FROM done WHERE e0
UNION ALL SELECT signal_id, signal_type, namespace, ts, 1, 'deduplicate', 'dedupe', NULL, 1.0 FROM done WHERE dd
UNION ALL SELECT signal_id, signal_type, namespace, ts, 2, 'transient_suppressor', 'suppress', NULL, 1.0 FROM done WHERE sup
UNION ALL SELECT signal_id, signal_type, namespace, ts, 3, 'severity_gate', CASE WHEN loud THEN 'escalate' ELSE 'drop' END, NULL, 1.0 FROM done WHERE gated
UNION ALL SELECT signal_id, signal_type, namespace, ts, 4, 'pattern_classifier', 'classify', pc, 0.85 FROM done WHERE pc IS NOT NULL
UNION ALL SELECT signal_id, signal_type, namespace, ts, 5, 'threshold_classifier', CASE WHEN tc = 'cpu_critical' THEN 'escalate' ELSE 'classify' END, tc, CASE WHEN tc = 'cpu_critical' THEN 0.95 ELSE 0.90 END FROM done WHERE tc IS NOT NULL)
"""


@query("decision_log", CASCADE_SQL + DECISIONS_SQL + "SELECT signal_id, CAST(agent_pos AS INT) AS agent_pos, agent_name, outcome, classification, CAST(confidence AS DOUBLE) AS confidence FROM decisions")
def decision_log(spark, sf_dir):
    return pipeline.decisions(cascade(spark, sf_dir)).drop("signal_type", "namespace", "ts")


@query("ledger_batches", CASCADE_SQL + DECISIONS_SQL + "SELECT signal_id // 500 AS batch_id, count(*) AS decisions, sum(CASE WHEN outcome = 'escalate' THEN 1 ELSE 0 END)::BIGINT AS escalations, sha256(string_agg(concat_ws(':', signal_id, agent_name, outcome), ',' ORDER BY signal_id, agent_pos)) AS idempotency_key FROM decisions GROUP BY 1")
def ledger_batches(spark, sf_dir):
    """Decisions in batches of 500 signals, with a key that tells a batch written twice."""
    made = pipeline.decisions(cascade(spark, sf_dir)).withColumn("batch_id", F.floor(F.col("signal_id") / 500))
    rows = F.array_sort(F.collect_list(F.struct("signal_id", "agent_pos", F.concat_ws(":", "signal_id", "agent_name", "outcome").alias("text"))))
    return made.groupBy("batch_id").agg(F.count("*").alias("decisions"), F.count_if(F.col("outcome") == "escalate").alias("escalations"), F.sha2(F.concat_ws(",", F.transform(rows, lambda x: x["text"])), 256).alias("idempotency_key"))


def _alone(agent: agents.Agent):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        signals = event_signals(spark, sf_dir)
        made = signals.withColumn("d", agent.decide(signals, F.lit(True))).where("d is not null")
        return made.select("signal_id", F.col("d.outcome").alias("outcome"), F.coalesce(F.col("d.classification"), F.lit("")).alias("classification"))

    return run


_BASE = CASCADE_SQL.split("a2 AS (")[0].rstrip().rstrip(",")
_ALONE = {
    "trend_escalate": (agents.trend(("cpu_percent", "latency_ms"), "source"), "SELECT signal_id, 'escalate' AS outcome, '' AS classification FROM a1 WHERE e0"),
    "dedup_batch": (agents.deduplicate(), "SELECT signal_id, 'dedupe' AS outcome, '' AS classification FROM a1 WHERE dd"),
    "transient_suppress": (agents.transient(), f"SELECT signal_id, 'suppress' AS outcome, '' AS classification FROM a1 WHERE signal_type = 'probe_failure' AND severity IN ('info', 'low') AND NOT {_matches(schema.NEVER_SUPPRESS)}"),
    "severity_gate": (agents.severity_gate(), f"SELECT signal_id, CASE WHEN {_matches(schema.ESCALATE)} THEN 'escalate' ELSE 'drop' END AS outcome, '' AS classification FROM a1 WHERE severity = 'info' AND NOT {BYPASS}"),
    "pattern_classify": (agents.pattern_classifier(), f"SELECT signal_id, 'classify' AS outcome, {_PATTERN_CASE} AS classification FROM a1 WHERE {_PATTERN_CASE} IS NOT NULL"),
    "threshold_classify": (agents.threshold_classifier(), "SELECT signal_id, CASE WHEN cpu_percent > 95 THEN 'escalate' ELSE 'classify' END AS outcome, CASE WHEN cpu_percent > 95 THEN 'cpu_critical' ELSE 'cpu_warning' END AS classification FROM a1 WHERE cpu_percent > 80"),
    "priming_windows": (agents.priming(("pod_crashloop",)), "SELECT signal_id, 'escalate' AS outcome, '' AS classification FROM a1 WHERE signal_type = 'pod_crashloop'"),
    "repeat_flood": (
        agents.repeat_flood(("heartbeat", "probe_failure"), 2, DAY),
        f"SELECT signal_id, 'suppress' AS outcome, '' AS classification FROM (SELECT signal_id, count(*) OVER (PARTITION BY signal_type, source, namespace ORDER BY us RANGE BETWEEN {DAY}000000 - 1 PRECEDING AND CURRENT ROW) AS n FROM a1 WHERE signal_type IN ('heartbeat', 'probe_failure') AND severity IN ('info', 'low')) WHERE n > 2",
    ),
}
for _name, (_agent, _sql) in _ALONE.items():
    query(_name, _BASE + " " + _sql)(_alone(_agent))


def _anchored_sql(key: str, where: str) -> str:
    return f"""WITH RECURSIVE {SIGNALS_SQL},
rows_ AS (SELECT signal_id, us, {key} AS key, row_number() OVER (PARTITION BY {key} ORDER BY us, seq) AS n FROM signals WHERE {where}),
walk AS (SELECT signal_id, key, n, us AS anchor, true AS first FROM rows_ WHERE n = 1
  UNION ALL SELECT r.signal_id, r.key, r.n, CASE WHEN r.us - w.anchor >= {DAY}000000 THEN r.us ELSE w.anchor END, r.us - w.anchor >= {DAY}000000 FROM walk w JOIN rows_ r ON r.key = w.key AND r.n = w.n + 1)
SELECT signal_id, first AS anchored FROM walk"""


@query("dedup_anchor_window", _anchored_sql("concat_ws(':', source, signal_type)", "true"))
def dedup_anchor_window(spark, sf_dir):
    """First of each key per day-long window that opens with it."""
    return agents.anchored(event_signals(spark, sf_dir), F.concat_ws(":", "source", "signal_type"), DAY, F.lit(True))


@query("dominant_noise", _anchored_sql("concat_ws(':', signal_type, source)", "signal_type = 'heartbeat' AND severity IN ('info', 'low')"))
def dominant_noise(spark, sf_dir):
    mine = (F.col("signal_type") == "heartbeat") & F.col("severity").isin(*schema.SUPPRESSIBLE)
    return agents.anchored(event_signals(spark, sf_dir), F.concat_ws(":", "signal_type", "source"), DAY, mine)


@query("contextual_noise", _anchored_sql("concat_ws(':', signal_type, namespace, source)", "signal_type = 'event_unhealthy' AND namespace IN ('ns_0', 'ns_1', 'ns_2', 'ns_3') AND severity IN ('info', 'low')"))
def contextual_noise(spark, sf_dir):
    """Of types that are noise in some namespaces only, the first of a source and window passes."""
    contexts = spark.createDataFrame([("event_unhealthy", f"ns_{k}") for k in range(4)], "signal_type string, namespace string")  # learned
    signals = event_signals(spark, sf_dir).join(F.broadcast(contexts), ["signal_type", "namespace"], "left_semi")
    return agents.anchored(signals, F.concat_ws(":", "signal_type", "namespace", "source"), DAY, F.col("severity").isin(*schema.SUPPRESSIBLE))


@query("priming_interval", f"WITH {SIGNALS_SQL}, w AS (SELECT 'pod_crashloop' AS signal_type, TIMESTAMP '2024-01-05' AS opened, 48.0 AS hours UNION ALL SELECT 'probe_failure', TIMESTAMP '2024-01-10', 24.0) SELECT signal_id, round(1 - (us - epoch_us(opened)) / 3600e6 / hours, 6) AS effect FROM signals JOIN w USING (signal_type) WHERE us >= epoch_us(opened) AND us < epoch_us(opened) + hours * 3600e6")
def priming_interval(spark, sf_dir):
    """Attention windows by time: effect falls from 1 to 0 over a window."""
    windows = spark.createDataFrame([("pod_crashloop", "2024-01-05", 48.0), ("probe_failure", "2024-01-10", 24.0)], "signal_type string, opened string, hours double")
    windows = windows.withColumn("opened", F.unix_micros(F.col("opened").cast("timestamp")))
    joined = event_signals(spark, sf_dir).join(F.broadcast(windows), "signal_type").where("us >= opened and us < opened + hours * 3600e6")
    return joined.select("signal_id", F.round(1 - (F.col("us") - F.col("opened")) / 3600e6 / F.col("hours"), 6).alias("effect"))


@query("entity_recent_ring", f"WITH {SIGNALS_SQL} SELECT signal_id FROM signals ORDER BY seq DESC LIMIT 500")
def entity_recent_ring(spark, sf_dir):
    """A ring buffer: the latest 500 signals."""
    return event_signals(spark, sf_dir).orderBy(F.desc("seq")).limit(500).select("signal_id")


@query("shadow_sample", f"WITH {SIGNALS_SQL}, noise AS (SELECT signal_id, sha256('shadow:' || signal_id) AS h FROM signals WHERE signal_type = 'heartbeat') SELECT signal_id FROM (SELECT *, row_number() OVER (ORDER BY h) AS r, greatest(1, count(*) OVER () * 5 // 100) AS n FROM noise) WHERE r <= n")
def shadow_sample(spark, sf_dir):
    """A twentieth of what activated rules suppress, to be looked at again: those with the least hashes, so reruns agree."""
    noise = event_signals(spark, sf_dir).where("signal_type = 'heartbeat'").select("signal_id", F.sha2(F.concat(F.lit("shadow:"), F.col("signal_id")), 256).alias("h"))
    n = max(1, noise.count() * 5 // 100)
    return lowest(noise, n, "h").select("signal_id")


# ---------------------------------------------------------------- trends by entity, duplicates by window

_ENTITY = "CASE user_ % 4 WHEN 0 THEN 'patient_id=' || CAST(user_ // 4 AS VARCHAR) WHEN 1 THEN 'host=h' || CAST(user_ % 30 AS VARCHAR) WHEN 2 THEN 'instance=i' || CAST(user_ % 9 AS VARCHAR) END"
_TRENDS = ("cpu_percent", "latency_ms")


def _over(fields, form: str) -> str:
    return " OR ".join(f"coalesce({form.format(d=f, c=f'{f}1', b=f'{f}2', a=f'{f}3')}, false)" for f in fields)


@query(
    "trend_entities",
    f"""WITH {SIGNALS_SQL}, named AS (SELECT *, {_ENTITY} AS entity FROM (SELECT *, CAST(substr(source, 6) AS BIGINT) AS user_ FROM signals)),
    lagged AS (SELECT signal_id, """
    + ", ".join([*_TRENDS, *(f"CASE WHEN us - lag(us, {n}) OVER w < 7 * {DAY}000000 THEN lag({f}, {n}) OVER w END AS {f}{n}" for f in _TRENDS for n in (1, 2, 3))])
    + f" FROM named WHERE entity IS NOT NULL WINDOW w AS (PARTITION BY entity ORDER BY seq)) SELECT signal_id FROM lagged WHERE ({_over(_TRENDS, _MOVES)}) OR ({_over(_TRENDS, _SWINGS)})",
)
def trend_entities(spark, sf_dir):
    """Trends of whatever a signal's labels, else its content, name, over any measured field, within a week."""
    user = F.substring("source", 6, 20).cast("long")
    signals = event_signals(spark, sf_dir).withColumn("labels", F.when(user % 4 == 0, F.create_map(F.lit("patient_id"), F.floor(user / 4).cast("string"))))
    signals = signals.withColumn("host", F.when(user % 4 == 1, F.concat(F.lit("h"), (user % 30).cast("string"))))
    signals = signals.withColumn("instance", F.when(user % 4 == 2, F.concat(F.lit("i"), (user % 9).cast("string"))))
    made = signals.withColumn("d", agents.trend(seconds=7 * DAY).decide(signals, F.lit(True)))
    return made.where("d is not null").select("signal_id")


@query("dedup_window", _anchored_sql("concat_ws(':', signal_type, source, namespace, severity, message)", f"NOT {BYPASS}") + " WHERE NOT first")
def dedup_window(spark, sf_dir):
    """Duplicates within a day that opens with the first of a key, as the cascade takes them."""
    annotated = pipeline.annotate(event_signals(spark, sf_dir), [agents.deduplicate(DAY)])
    return annotated.where("d_deduplicate is not null").select("signal_id", F.lit(False).alias("anchored"))
