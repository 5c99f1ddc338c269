"""Queries over domains' packs, the engine's own events, ledger, memory cycles, notes and generated records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tamis.functions import claims
from tamis.operators import contents, governance, memory, packs, pipeline
from tamis.operators.stores import Ledger, shuffles_go
from tamis.operators.tables import discard, shared_folder, written
from tamis.plans.domains import RECORDS, _pick, _records
from tamis.plans.recollection import MEMORIES, memories
from tamis.plans.registry import query
from tamis.plans.routing import _values
from tamis.plans.sieve import CASCADE_SQL, DECISIONS_SQL, cascade
from tamis.sources import synthetic
from tamis.sources.adapters import SIGNALS_SQL, K, event_signals


def _rows(spark, sf_dir, columns: dict[str, str]):
    return _records(spark, sf_dir).selectExpr("event_id", *(f"{sql.replace('VARCHAR', 'STRING')} AS {name}" for name, sql in columns.items()))


def _sql(columns: dict[str, str]) -> str:
    return f"{RECORDS}, m AS (SELECT event_id, " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + " FROM r)"


# ---------------------------------------------------------------- packs

_PAIRS = [(d, *p) for d, pack in packs.PACKS.items() for p in pack.causes]


@query("pack_causes", f"WITH e(domain, cause, effect) AS (VALUES {_values(_PAIRS)}), {SIGNALS_SQL}, t AS (SELECT DISTINCT signal_type FROM signals) SELECT domain, cause, effect FROM e WHERE effect IN (SELECT * FROM t) OR cause IN (SELECT * FROM t)")
def pack_causes(spark, sf_dir):
    """Known causes and effects among the types that occur."""
    types = event_signals(spark, sf_dir).select("signal_type").distinct()
    edges = packs.causes(spark)
    as_effect = edges.join(types.withColumnRenamed("signal_type", "effect"), "effect", "left_semi")
    as_cause = edges.join(types.withColumnRenamed("signal_type", "cause"), "cause", "left_semi")
    columns = ["domain", "cause", "effect"]
    return as_effect.select(*columns).unionByName(as_cause.select(*columns)).distinct()


_ABOUT = {
    "cluster": _pick("k", "c1", "c2", ""), "namespace": _pick("user_id", "ns1", "ns2", ""), "source": _pick("event_id", "n1", "", "n3", ""),
    "what": _pick("k", "job", "task", "activity", "focus", "code", "system"), "job_id": _pick("event_id", "7", ""), "app": _pick("k", "mail", ""), "repo": _pick("event_id", "r1", ""),
    "person": _pick("user_id", "ann", ""), "team": _pick("k", "core", ""), "topic": _pick("event_id", "search", ""),
}


@query(
    "pack_entities",
    _sql(_ABOUT)
    + """ SELECT event_id, nullif(concat_ws(':', nullif(cluster, ''), nullif(namespace, ''), nullif(source, '')), '') AS plain,
    CASE WHEN source <> '' THEN 'node:' || source || CASE WHEN cluster <> '' THEN ':' || cluster ELSE '' END WHEN namespace <> '' AND cluster <> '' THEN 'ns:' || namespace || ':' || cluster END AS kubernetes,
    CASE what WHEN 'job' THEN CASE WHEN source <> '' THEN 'job:' || namespace || ':' || source END WHEN 'task' THEN CASE WHEN job_id <> '' THEN 'job-run:' || job_id END WHEN 'activity' THEN 'config:' || namespace END AS automation,
    CASE WHEN person <> '' AND team <> '' THEN 'person:' || person || '@' || team WHEN topic <> '' THEN 'topic:' || topic WHEN person <> '' THEN 'person:' || person END AS knowledge,
    CASE what WHEN 'focus' THEN CASE WHEN app <> '' THEN 'app:' || app END WHEN 'code' THEN CASE WHEN repo <> '' THEN 'repo:' || repo END WHEN 'system' THEN 'system:' || CASE WHEN source <> '' THEN source ELSE 'local' END END AS workstation FROM m""",
)
def pack_entities(spark, sf_dir):
    rows = _rows(spark, sf_dir, _ABOUT)
    label = lambda n, c: (F.lit(n), F.col(c))
    rows = rows.withColumn("labels", F.create_map(*label("source", "what"), *label("category", "what"), *label("person", "person"), *label("team", "team"), *label("topic", "topic")))
    domains = ("kubernetes", "automation", "knowledge", "workstation")
    return rows.select("event_id", packs.entities(rows).alias("plain"), *(packs.entities(rows, d).alias(d) for d in domains))


@query("pack_decay", MEMORIES + f", r(signal_type, rate) AS (VALUES {_values(list(packs.KUBERNETES_DECAY.items()))}) SELECT memory_id, round(greatest(strength * exp(-coalesce(rate::DOUBLE, 0.01) * 24), 0), 6) AS strength FROM memories LEFT JOIN r USING (signal_type)")
def pack_decay(spark, sf_dir):
    faded = memory.decay(memories(spark, sf_dir), packs.decay_rates(spark, "kubernetes"), F.lit(24.0))
    return faded.select("memory_id", F.round("strength", 6).alias("strength"))


# ---------------------------------------------------------------- its own events

_EVENT = {"agent_name": "'agent_' || CAST(user_id AS VARCHAR)", "event_type": _pick("k", "promotion", "demotion", "ttl_expired"), "from_tier": _pick("event_id", "draft", "candidate", "nano", "micro"), "to_tier": _pick("user_id", "nano", "draft", "macro", "candidate")}


@query(
    "meta_signals",
    _sql(_EVENT)
    + """ SELECT event_id, 'cascade_' || event_type AS signal_type, CASE WHEN event_type = 'demotion' THEN CASE WHEN from_tier IN ('nano', 'micro', 'macro') THEN 'high' ELSE 'medium' END WHEN event_type = 'promotion' AND to_tier IN ('nano', 'micro', 'macro') THEN 'medium' ELSE 'info' END AS severity,
    'Agent ''' || agent_name || ''' ' || event_type || ': ' || from_tier || ' → ' || to_tier AS message FROM m""",
)
def meta_signals(spark, sf_dir):
    return governance.meta_signals(_rows(spark, sf_dir, _EVENT)).select("event_id", "signal_type", "severity", "message")


_HELD = {"memories": "k * 10", "capacity": "1000", "buffered": "CAST(user_id % 100 AS INT)", "buffer": "100", "busy": "CAST(event_id % 4 AS INT)", "threads": "3", "processed": "CAST(event_id % 50 AS INT)", "evicted": "k % 7"}


@query(
    "meta_alerts",
    _sql(_HELD)
    + """ SELECT event_id, 'meta_memory_pressure' AS signal_type, 'medium' AS severity, round(memories / greatest(1, capacity), 3) AS level FROM m WHERE memories / greatest(1, capacity) > 0.8
    UNION ALL SELECT event_id, 'meta_llm_starvation', 'high', round(buffered / greatest(1, buffer), 3) FROM m WHERE buffered / greatest(1, buffer) > 0.8 AND busy >= threads
    UNION ALL SELECT event_id, 'meta_consolidation_eviction_spike', 'high', round(evicted / processed, 3) FROM m WHERE processed > 0 AND evicted / processed > 0.1""",
)
def meta_alerts(spark, sf_dir):
    return governance.meta_alerts(_rows(spark, sf_dir, _HELD)).select("event_id", "signal_type", "severity", "level")


@query(
    "inverse_report",
    MEMORIES
    + f""", s AS (SELECT signal_type, severity, count(*) AS n FROM signals WHERE severity IN ('info', 'low') GROUP BY ALL), t AS (SELECT signal_type, sum(n) AS f FROM s GROUP BY 1), e(domain, cause, effect) AS (VALUES {_values(_PAIRS)}), p AS (SELECT DISTINCT signal_type FROM memories),
    c AS (SELECT (SELECT count(*) FROM s) AS suppression_patterns, (SELECT count(*) FROM t) AS normal_signal_types, (SELECT count(*) FROM memories) AS memories, (SELECT count(*) FROM e WHERE effect IN (SELECT * FROM p) AND cause NOT IN (SELECT * FROM p)) AS causal_gaps,
    (SELECT string_agg(signal_type, ',' ORDER BY f DESC, signal_type) FROM (SELECT * FROM t ORDER BY f DESC, signal_type LIMIT 10)) AS top_normal)
    SELECT *, round(memories / greatest(1, suppression_patterns), 3) AS ratio, CASE WHEN suppression_patterns > memories * 5 THEN 'The system suppresses far more than it remembers' ELSE 'Memory and suppression are balanced' END AS interpretation FROM c""",
)
def inverse_report(spark, sf_dir):
    quiet = event_signals(spark, sf_dir).where("severity in ('info', 'low')").groupBy("signal_type", "severity").agg(F.count("*").alias("count"))
    return governance.inverse_report(quiet, memories(spark, sf_dir), packs.causes(spark).drop("domain"))


# ---------------------------------------------------------------- ledger


@query(
    "ledger_records",
    CASCADE_SQL
    + DECISIONS_SQL
    + """, j AS (SELECT d.signal_id, agent_pos, agent_name, outcome, CASE WHEN d.signal_id % 7 = 0 THEN '' ELSE message END AS message, CASE WHEN d.signal_id % 7 = 0 THEN '' ELSE s.severity END AS severity FROM decisions d JOIN signals s ON d.signal_id = s.signal_id),
    h AS (SELECT *, sha256('{"message":"' || message || '","severity":"' || severity || '"}') AS input_hash FROM j)
    SELECT signal_id, agent_name, input_hash, '{"agent_name":"' || agent_name || '","input_hash":"' || input_hash || '","message":"' || message || '","outcome":"' || outcome || '","severity":"' || severity || '","signal_id":"' || signal_id || '"}' AS record, sha256(signal_id || ':' || agent_name || ':' || outcome || ':' || input_hash) AS idempotency_key FROM h""",
)
def ledger_records(spark, sf_dir):
    """Decisions as records that a ledger takes, sent twice and kept once; a seventh of the signals isn't there any more."""
    made = pipeline.decisions(cascade(spark, sf_dir)).select("signal_id", "agent_pos", "agent_name", "outcome")
    known = event_signals(spark, sf_dir).where("signal_id % 7 <> 0")
    return governance.ledger_records(made.unionByName(made), known, "severity", "message").select("signal_id", "agent_name", "input_hash", "record", "idempotency_key")


@query(
    "ledger_sink",
    CASCADE_SQL
    + DECISIONS_SQL
    + "SELECT signal_id, agent_name, outcome, sha256(signal_id || ':' || agent_name || ':' || outcome) AS idempotency_key FROM decisions",
)
def ledger_sink(spark, sf_dir):
    """Decisions in a ledger once each: in three batches, of which the second is written twice and once without a commit, and
    the third brings all records of the first again."""
    with shuffles_go(spark):  # the cascade runs once
        stored = written(pipeline.decisions(cascade(spark, sf_dir)).select("signal_id", "agent_name", "outcome"), "decisions")
    made = stored.withColumn("idempotency_key", F.sha2(F.concat_ws(":", "signal_id", "agent_name", "outcome"), 256))
    ledger = Ledger(spark, f"{shared_folder(spark)}/ledgers/{uuid.uuid4().hex}", "idempotency_key")
    part = lambda *k: made.where((F.col("signal_id") % 3).isin(*k))
    ledger.append(part(0), 0)
    ledger.prepare(part(1), 1)  # a job that dies before it commits
    ledger.append(part(1), 1)
    ledger.append(part(1), 1)
    ledger.append(part(0, 2), 2)
    discard(stored)
    return ledger.read()


_REPORT = {"agent_name": _pick("k", "deduplicate", "learned_a", "learned_b", "severity_gate"), "verdict": _pick("user_id", "FAILS", "fails", "HOLDS"), "us": "event_id"}


@query("failed_verdicts", _sql(_REPORT) + " SELECT event_id, agent_name FROM m WHERE upper(verdict) = 'FAILS' AND agent_name NOT IN ('deduplicate', 'severity_gate') AND us > 100")
def failed_verdicts(spark, sf_dir):
    rows = _rows(spark, sf_dir, _REPORT)
    return governance.failed_verdicts(rows, ("deduplicate", "severity_gate"), F.lit(100)).select("event_id", "agent_name")


# ---------------------------------------------------------------- memory


@query("recall_reinforced", MEMORIES + ", n AS (SELECT memory_id, count(*) AS n, max(us) AS last_at FROM memories JOIN signals USING (signal_type) WHERE signal_id % 200 = memory_id % 200 GROUP BY memory_id) SELECT memory_id, round(CASE WHEN n > 0 THEN least(1, 1 - (1 - strength) * pow(0.9::DOUBLE, n)) ELSE strength END, 6) AS strength, coalesce(n, 0) AS recall_count, last_at AS last_recalled_us FROM memories LEFT JOIN n USING (memory_id)")
def recall_reinforced(spark, sf_dir):
    """Memories after they were recalled by signals of their type."""
    known = memories(spark, sf_dir).select("memory_id", "signal_type", "strength").withColumn("recall_count", F.lit(0).cast("long"))
    asked = event_signals(spark, sf_dir).select("signal_type", "us", (F.col("signal_id") % 200).alias("_k"))
    recalls = known.select("memory_id", "signal_type", (F.col("memory_id") % 200).alias("_k")).join(asked, ["signal_type", "_k"]).select("memory_id", "us")
    made = governance.reinforce_recalled(known, recalls)
    return made.select("memory_id", F.round("strength", 6).alias("strength"), "recall_count", "last_recalled_us")


_CYCLE = "SELECT memory_id, CASE WHEN memory_id % 9 = 0 THEN 0.01 * (memory_id % 11) ELSE strength END AS strength, CASE WHEN memory_id % 3 > 0 THEN modified_us END AS consolidated_us FROM memories"


@query("consolidation_batch", MEMORIES + f", c AS ({_CYCLE}), u AS (SELECT memory_id FROM c WHERE strength < 0.1) SELECT memory_id FROM u UNION ALL SELECT memory_id FROM (SELECT memory_id FROM c WHERE strength >= 0.1 ORDER BY coalesce(consolidated_us, -1), memory_id LIMIT greatest(0, 400 - (SELECT count(*) FROM u)))")
def consolidation_batch(spark, sf_dir):
    memories(spark, sf_dir).createOrReplaceTempView("memories")
    return governance.consolidation_batch(spark.sql(_CYCLE), 400).select("memory_id")


@query("rejection_set", f"WITH {SIGNALS_SQL}, b AS (SELECT message || ':' || source AS content_hash, min(seq) AS seq FROM signals GROUP BY 1) SELECT content_hash, seq FROM b ORDER BY seq DESC, content_hash LIMIT 500")
def rejection_set(spark, sf_dir):
    rows = event_signals(spark, sf_dir).select(F.concat("message", F.lit(":"), "source").alias("content_hash"), "seq")
    return governance.rejected(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), 500)


@query("priming_set", "WITH w AS (SELECT 't' || (user_id % 25) AS signal_type, min(event_id) AS first, arg_max(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT), event_id) AS hours FROM events GROUP BY 1) SELECT signal_type, first, hours FROM w ORDER BY first DESC LIMIT 10")
def priming_set(spark, sf_dir):
    rows = _records(spark, sf_dir).selectExpr("concat('t', CAST(user_id % 25 AS STRING)) AS signal_type", "event_id AS seq", "k AS hours")
    return governance.priming_set(rows)


@query("pairs_pruned", "SELECT user_id AS a, event_type AS b, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, a, b LIMIT 300")
def pairs_pruned(spark, sf_dir):
    """The strongest pairs, up to a capacity."""
    pairs = _records(spark, sf_dir).groupBy(F.col("user_id").alias("a"), F.col("event_type").alias("b")).agg(F.count("*").alias("n"))
    return governance.strongest(pairs, 300, "n", "a", "b")


@query("entity_rings", f"WITH {SIGNALS_SQL} SELECT signal_id FROM (SELECT signal_id, row_number() OVER (PARTITION BY source ORDER BY seq DESC) AS r FROM signals) WHERE r <= 5")
def entity_rings(spark, sf_dir):
    return governance.rings(event_signals(spark, sf_dir).select("signal_id", "source", "seq"), "source", "seq", 5).select("signal_id")


# ---------------------------------------------------------------- notes and claims

_DECISION = {"agent": _pick("k", "dedupe", "gate", "gate", "trend", "gate", "rule", "rule", "rule"), "subject_type": "event_type", "severity": _pick("user_id", "low", "high", "critical", "info"), "outcome": _pick("event_id", "drop", "suppress", "keep", "classify", "escalate", "dedupe", "dedupe"), "confidence": "CAST(k AS DOUBLE) / 100", "namespace": _pick("user_id", "a", "a", "b")}


@query(
    "workload_statements",
    _sql(_DECISION).replace("event_type AS subject_type", "et AS subject_type")
    + """, t AS (SELECT count(*) AS total FROM m), y AS (SELECT subject_type AS k, count(*) AS n, count(DISTINCT agent) AS a FROM m GROUP BY 1), ns AS (SELECT namespace AS k, count(*) AS n FROM m GROUP BY 1),
    b AS (SELECT count_if(confidence >= 0.9) AS h, count_if(confidence >= 0.5 AND confidence < 0.9) AS mid, count_if(confidence < 0.5) AS l, count_if(outcome IN ('dedupe', 'suppress', 'drop')) AS z FROM m)
    SELECT 'agent-' || agent || '-effectiveness' AS name, 'Agent ''' || agent || ''' handles ' || (count(*) * 100 // any_value(total)) || '% of decisions' AS description FROM m, t GROUP BY agent HAVING count(*) * 100 // any_value(total) >= 5
    UNION ALL SELECT 'dominant-signal-type', 'Signal type ''' || k || ''' dominates at ' || (n * 100 // total) || '%' FROM (SELECT * FROM y ORDER BY n DESC, k DESC LIMIT 1), t WHERE n * 100 // total > 30
    UNION ALL SELECT 'multi-agent-routing', count(*) || ' signal types require multiple agents' FROM y WHERE a > 1 HAVING count(*) > 0
    UNION ALL SELECT 'safety-' || severity || '-severity', severity || '-severity: ' || count_if(outcome IN ('drop', 'suppress')) || ' suppressed, ' || count_if(outcome IN ('keep', 'classify', 'escalate')) || ' classified, ' || count_if(outcome = 'dedupe') || ' deduped' FROM m WHERE severity IN ('critical', 'high') GROUP BY severity
    UNION ALL SELECT 'confidence-distribution', 'Confidence: ' || (h * 100 // total)::BIGINT || '% high, ' || (mid * 100 // total)::BIGINT || '% medium, ' || (l * 100 // total)::BIGINT || '% low' FROM b, t
    UNION ALL SELECT 'namespace-hotspot', '''' || k || ''' namespace generates ' || (n * 100 // total) || '% of signals' FROM (SELECT * FROM ns ORDER BY n DESC, k DESC LIMIT 1), t WHERE n * 100 // total > 30
    UNION ALL SELECT 'self-tuning-compression', 'Fleet achieved ' || (z * 100 // total)::BIGINT || '% compression with zero human rules' FROM b, t""",
)
def workload_statements(spark, sf_dir):
    return governance.workload_claims(_rows(spark, sf_dir, _DECISION))


_HOW = "One item with its note that is long enough {0}. See [[other]].\n\n- first point {0}\n* second point\n\n| name | value |\n| --- | --- |\n| rows | {0} |\n\n```\ncode stays out of it\n```\n\nshort\n\nuse password: hunter2 for all of it\n**Why:** because of {0}\n**How to apply:**\n- start here\n- end {0}\n**Empty:** "


@query(
    "note_claims",
    "WITH i AS (SELECT item_id AS x FROM benchmark) "
    + " UNION ALL ".join(f"SELECT x AS item_id, {claim} AS claim, '{section}' AS section FROM i" for claim, section in (("'One item with its note that is long enough ' || x || '. See .'", "opening"), ("'first point ' || x", "body"), ("'second point'", "body"), ("'name | value'", "table"), ("'rows | ' || x", "table"), ("'because of ' || x", "why"), ("'start here'", "how to apply"), ("'end ' || x", "how to apply"))),
)
def note_claims(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id")
    notes = items.withColumn("body", F.replace(F.lit(_HOW), F.lit("{0}"), F.col("item_id").cast("string")))
    return claims.note_claims(notes, "item_id")


_SAYINGS = ("tests first, then code", "granite on xeon", "fail open, never dismiss", "deploy to openshift namespace", "hash chain of decision record", "12 tests pass with pytest", "quickstart for self serve", "nothing of note", "a domain pack, framework unchanged", "svg viewbox and css class", "temperature 0 is deterministic", "routing engine and corpora")
_SAID = {"said": _pick("event_id", *_SAYINGS)}


@query("topic_tags", _sql(_SAID) + ", t AS (SELECT event_id, unnest([" + ", ".join(f"CASE WHEN regexp_matches(said, '{p}') THEN '{n}' END" for n, p in sorted(claims.TOPICS.items())) + "]) AS topic FROM m) SELECT topic, count(*) AS n FROM t WHERE topic IS NOT NULL GROUP BY topic")
def topic_tags(spark, sf_dir):
    rows = _rows(spark, sf_dir, _SAID).select(F.explode(claims.topics(F.col("said"), claims.TOPICS)).alias("topic"))
    return rows.groupBy("topic").agg(F.count("*").alias("n"))


_CONTENT = {"node": "'node-' || CAST(user_id AS VARCHAR) || '-abcde'", "message": "'pod web-7f9c8d on ' || CAST(event_id AS VARCHAR) || ' at 2026-01-02T03:04:05Z by 123e4567-e89b-12d3-a456-426614174000'"}


@query("content_normalized", _sql(_CONTENT) + " SELECT event_id, node, 'pod web on ' || event_id || ' at <ts> by <uuid>' AS message FROM m")
def content_normalized(spark, sf_dir):
    """Fields that say where stay as they are, the others lose what changes from one event to the next."""
    rows = _rows(spark, sf_dir, _CONTENT)
    content = memory.normal_content(F.create_map(F.lit("node"), F.col("node"), F.lit("message"), F.col("message")))
    return rows.withColumn("c", content).select("event_id", F.col("c")["node"].alias("node"), F.col("c")["message"].alias("message"))


_NESTED = (
    """CASE WHEN event_id % 10 = 9 THEN '{"cut": ' || event_id ELSE '{"message":"pod web-7f9c8d at 2026-01-02T03:04:05Z","node":"node-' || user_id || '-abcde","cpu":' || k || '.5,"ready":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END
    || ',"none":null,"tags":["a-12345",' || event_id || '],"pod":{"name":"api-' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 6) || '","host":"h-12345","spec":{"image":"img-7f9c8d","replicas":' || k || ',"deep":{"id":"123e4567-e89b-12d3-a456-426614174000","empty":{}}}},"props":' || props || '}' END"""
)
_NESTED_SQL = f"""WITH r AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events), t AS (SELECT event_id, {_NESTED} AS t FROM r),
c AS (SELECT event_id, CASE WHEN json_valid(t) THEN CAST(t AS JSON) ELSE json_object('raw', t) END AS c FROM t),
tree AS (SELECT event_id, j.* FROM c, json_tree(c) AS j),
kept AS (SELECT event_id, key, CAST(value AS VARCHAR) AS value, type, substr(fullkey, 3) AS path, path = '$' AS top FROM tree WHERE key IS NOT NULL AND type <> 'OBJECT' AND NOT regexp_matches(fullkey, '[[]')),
fields AS (SELECT event_id, replace(path, '"', '') AS path, top, CASE type WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'flag' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'list' ELSE 'number' END AS kind,
  CASE WHEN type <> 'VARCHAR' THEN coalesce(value, 'null') WHEN key IN ('node', 'host') THEN json_extract_string(value, '$')
  ELSE regexp_replace(regexp_replace(regexp_replace(json_extract_string(value, '$'), '(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}', '<uuid>', 'g'), '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}[^\\s]*', '<ts>', 'g'), '(\\w)-[a-z0-9]{{5,10}}(\\s|$)', '\\1\\2', 'g') END AS text FROM kept)
"""


def _fields(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.expr(K)).withColumn("t", F.expr(_NESTED.replace("VARCHAR", "STRING").replace("sha256(CAST(event_id AS STRING))", "sha2(CAST(event_id AS STRING), 256)")))
    return contents.leaves(rows.withColumn("c", contents.parsed("t")), "event_id", "c")


@query("variant_fields", _NESTED_SQL + "SELECT event_id, path, kind, text FROM fields")
def variant_fields(spark, sf_dir):
    """Fields of nested contents at any depth, made comparable; a text that isn't JSON is a field of its own."""
    return _fields(spark, sf_dir).drop("top")


@query(
    "variant_hashes",
    _NESTED_SQL + ", h AS (SELECT event_id, sha256(string_agg(path || '=' || text, '|' ORDER BY path)) AS content_hash FROM fields GROUP BY event_id), f AS (SELECT event_id, count(*) AS features, sum(CASE WHEN kind = 'flag' THEN (text = 'true')::INT ELSE CAST(text AS DOUBLE) END) AS total FROM fields WHERE top AND kind IN ('number', 'flag') GROUP BY event_id) SELECT event_id, content_hash, coalesce(features, 0) AS features, coalesce(total, 0) AS total FROM h LEFT JOIN f USING (event_id)",
)
def variant_hashes(spark, sf_dir):
    """Hashes of nested contents, and how many numbers of their own they have, with their sum."""
    fields = written(_fields(spark, sf_dir), "fields")
    numbers = contents.features(fields, "event_id").groupBy("event_id").agg(F.count("*").alias("features"), F.sum("value").alias("total"))
    return contents.hashes(fields, "event_id").join(numbers, "event_id", "left").fillna({"features": 0, "total": 0.0})


# ---------------------------------------------------------------- generated records


def _drawn_sql(seed: int, name: str, choices: tuple) -> str:
    draw = f"('0x' || substr(md5('{seed}:{name}:' || id), 1, 8))::BIGINT"
    if len(choices) == 2 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in choices):
        low, high = choices
        if isinstance(low, int):
            return f"{low} + {draw} % {high - low + 1}"
        return f"round({low}::DOUBLE + ({draw} / 4294967296.0::DOUBLE) * {high - low}::DOUBLE, 2)"
    return "([" + ", ".join(f"'{c}'" if isinstance(c, str) else str(c).lower() for c in choices) + f"])[{draw} % {len(choices)} + 1]"


def _generated(domain: str):
    def run(spark, sf_dir):
        return synthetic.records(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id")), domain)

    return run


for _domain, _columns in synthetic.DOMAINS.items():
    _made = ", ".join(f"{_drawn_sql(42, n, c)} AS {n}" for n, c in _columns.items())
    query(f"generated_{_domain}", f"SELECT id, {_made} FROM (SELECT event_id AS id FROM events)")(_generated(_domain))
