"""Queries over memories and what is like them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators import agents, memory, neighbours, pipeline, recall
from tamis.plans.registry import query
from tamis.plans.sieve import BYPASS, CASCADE_SQL, cascade
from tamis.schema import ESCALATE, NEVER_SUPPRESS
from tamis.sources.adapters import SIGNALS_SQL, content_text, event_signals

WEIGHT = "CASE severity WHEN 'info' THEN 0.1 WHEN 'low' THEN 0.2 WHEN 'high' THEN 0.7 WHEN 'critical' THEN 1.0 ELSE 0.4 END"
MEMORIES = f"""WITH RECURSIVE {SIGNALS_SQL},
hashed AS (SELECT *, sha256(concat_ws('|', signal_type, 'message=' || message, 'source=' || source)) AS content_hash FROM signals),
formed AS (SELECT content_hash, signal_type, min(seq) AS memory_id, arg_min(severity, seq) AS severity, arg_min(source, seq) AS source, arg_min(namespace, seq) AS namespace, arg_min(cluster, seq) AS cluster, arg_min(label, seq) AS label, arg_min(message, seq) AS message, arg_min(cpu_percent, seq) AS cpu_percent, arg_min(latency_ms, seq) AS latency_ms, min(us) AS formed_us, max(us) AS modified_us, count(*) AS occurrences FROM hashed GROUP BY content_hash, signal_type),
memories AS (SELECT *, 1 - (1 - {WEIGHT}) * pow(0.9, occurrences - 1) AS strength FROM formed)
"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory for each type, message and source of the events."""
    return memory.form(event_signals(spark, sf_dir), ["message"], ["source"])


def short(*more: str) -> tuple:
    return ("memory_id", "signal_type", "severity", "occurrences", F.round("strength", 6).alias("strength"), *more)


@query("normalize_hash", r"""WITH t AS (SELECT event_id, 'restart of web-' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8) || ' at ' || '2024-01-01T00:00:00Z' || ' id ' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8) || '-0000-4000-8000-' || substr(sha256(CAST(event_id AS VARCHAR)), 9, 12) || ' ' || event_type AS raw FROM events),
n AS (SELECT event_id, regexp_replace(regexp_replace(regexp_replace(raw, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '<uuid>', 'g'), '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[^\s]*', '<ts>', 'g'), '(\w)-[a-z0-9]{5,10}(\s|$)', '\1\2', 'g') AS text FROM t)
SELECT text, sha256(text) AS hash, count(*) AS n FROM n GROUP BY ALL""")
def normalize_hash(spark, sf_dir):
    """Texts that differ in generated parts only have one hash."""
    h = F.sha2(F.col("event_id").cast("string"), 256)
    raw = F.concat(F.lit("restart of web-"), F.substring(h, 1, 8), F.lit(" at 2024-01-01T00:00:00Z id "), F.substring(h, 1, 8), F.lit("-0000-4000-8000-"), F.substring(h, 9, 12), F.lit(" "), F.col("event_type"))
    texts = spark.read.parquet(f"{sf_dir}/events.parquet").select(memory.normal_text(raw).alias("text"))
    return texts.groupBy("text").agg(F.count("*").alias("n")).withColumn("hash", F.sha2("text", 256))


@query("memory_formation", MEMORIES + "SELECT memory_id, signal_type, severity, occurrences, round(strength, 6) AS strength, content_hash FROM memories")
def memory_formation(spark, sf_dir):
    return memories(spark, sf_dir).select(*short("content_hash"))


@query("archive_stats", MEMORIES + "SELECT count(*) AS size, round(avg(strength), 6) AS avg_strength, round(min(strength), 6) AS min_strength, round(max(strength), 6) AS max_strength, count(DISTINCT source) AS sources FROM memories")
def archive_stats(spark, sf_dir):
    return memories(spark, sf_dir).agg(F.count("*").alias("size"), F.round(F.avg("strength"), 6).alias("avg_strength"), F.round(F.min("strength"), 6).alias("min_strength"), F.round(F.max("strength"), 6).alias("max_strength"), F.count_distinct("source").alias("sources"))


NOW = "epoch_us(TIMESTAMP '2024-01-31')"


def _hours():
    return (F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.col("modified_us")) / 3600e6


@query("memory_decay", MEMORIES + f"SELECT memory_id, round(strength * exp(-(CASE signal_type WHEN 'heartbeat' THEN 0.05 WHEN 'pod_crashloop' THEN 0.002 ELSE 0.01 END) * ({NOW} - modified_us) / 3600e6), 6) AS strength FROM memories")
def memory_decay(spark, sf_dir):
    rates = spark.createDataFrame([("heartbeat", 0.05), ("pod_crashloop", 0.002)], "signal_type string, rate double")
    return memory.decay(memories(spark, sf_dir), rates, _hours()).select("memory_id", F.round("strength", 6).alias("strength"))


@query("memory_evict", MEMORIES + "SELECT memory_id FROM (SELECT *, row_number() OVER (ORDER BY strength, memory_id) AS r, count(*) OVER () AS n FROM memories) WHERE n > 1000 AND r <= n - 900")
def memory_evict(spark, sf_dir):
    return memory.evict(memories(spark, sf_dir), 1000)[1].select("memory_id")


@query("memory_query", MEMORIES + "SELECT memory_id, signal_type, severity, occurrences, round(strength, 6) AS strength FROM memories WHERE strength >= 0.3 AND signal_type = 'pod_crashloop' AND label = 'fraud' ORDER BY memories.strength DESC, memory_id LIMIT 100")
def memory_query(spark, sf_dir):
    return memory.search(memories(spark, sf_dir), "pod_crashloop", {"label": "fraud"}, 0.3).select(*short())


@query("memory_export", MEMORIES + "SELECT memory_id, signal_type, severity, occurrences, round(strength, 6) AS strength FROM memories WHERE strength >= 0.2 AND modified_us >= epoch_us(TIMESTAMP '2024-01-20')")
def memory_export(spark, sf_dir):
    since = int(spark.sql("SELECT unix_micros(timestamp'2024-01-20')").first()[0])
    return memory.export(memories(spark, sf_dir), since, 0.2).select(*short())


_ALIKE = "sha256(concat_ws('|', signal_type, 'message=' || message))"


@query(
    "federation_import",
    MEMORIES
    + f""", shared AS (SELECT *, {_ALIKE} AS h FROM memories),
here AS (SELECT h, signal_type, min(memory_id) AS memory_id, max(strength) AS strength FROM shared WHERE cluster = 'c0' AND namespace < 'ns_5' GROUP BY ALL),
there AS (SELECT h, memory_id, signal_type, strength FROM shared WHERE cluster = 'c1'),
wanted AS (SELECT * FROM there WHERE h NOT IN (SELECT h FROM shared WHERE message = 'kernel panic')),
times AS (SELECT h, count(*) AS n FROM wanted GROUP BY h)
SELECT memory_id, round(least(1.0, 1 - (1 - strength) * pow(0.9, coalesce(n, 0))), 6) AS strength, CASE WHEN n IS NULL THEN 'local' ELSE 'reinforced' END AS origin FROM here LEFT JOIN times USING (h)
UNION ALL SELECT memory_id, round(strength, 6), 'imported' FROM wanted WHERE h NOT IN (SELECT h FROM here)""",
)
def federation_import(spark, sf_dir):
    """Memories of cluster c1 come to those of c0; content of one message was rejected before."""
    shared = memories(spark, sf_dir).withColumn("content_hash", F.sha2(F.concat_ws("|", "signal_type", F.concat(F.lit("message="), "message")), 256))
    here = shared.where("cluster = 'c0' and namespace < 'ns_5'").groupBy("content_hash", "signal_type").agg(F.min("memory_id").alias("memory_id"), F.max("strength").alias("strength"))
    there = shared.where("cluster = 'c1'").select("content_hash", "signal_type", "memory_id", "strength")
    made = memory.receive(here, there, shared.where("message = 'kernel panic'"))
    return made.select("memory_id", F.round("strength", 6).alias("strength"), "origin")


@query(
    "consolidation",
    MEMORIES
    + f""", texts AS (SELECT *, 'message: ' || message || ', cpu_percent: ' || CAST(cpu_percent AS VARCHAR) AS content_text FROM memories),
ran AS (SELECT *, signal_type = 'probe_failure' AND severity IN ('info', 'low') AND NOT regexp_matches(content_text, '{NEVER_SUPPRESS}') AS sup FROM texts),
gated AS (SELECT *, NOT sup AND severity = 'info' AND NOT {BYPASS} AND NOT regexp_matches(content_text, '{ESCALATE}') AS dropped, NOT sup AND severity = 'info' AND NOT {BYPASS} AND regexp_matches(content_text, '{ESCALATE}') AS loud FROM ran),
done AS (SELECT *, NOT sup AND NOT dropped AND (severity <> 'info' OR loud) AS survives FROM gated),
changed AS (SELECT memory_id, signal_type, CASE WHEN survives THEN least(strength + 0.05, 1.0) WHEN sup OR dropped THEN greatest(strength - 0.3, 0.0) ELSE strength END AS s, CASE WHEN survives THEN 'survived' WHEN sup OR dropped THEN 'suppressed' ELSE 'unchanged' END AS status FROM done)
SELECT memory_id, signal_type, round(s, 6) AS strength, status, s < 0.05 AS evicted FROM changed""",
)
def consolidation(spark, sf_dir):
    rows = memories(spark, sf_dir).withColumn("content_text", content_text("message", "cpu_percent"))
    return memory.consolidate(rows, [agents.transient(), agents.severity_gate()]).withColumn("strength", F.round("strength", 6))


@query("table_upsert", f"WITH {SIGNALS_SQL} SELECT source, arg_max(signal_id, seq) AS signal_id, arg_max(severity, seq) AS severity FROM signals GROUP BY source")
def table_upsert(spark, sf_dir):
    """The latest row of each source, of what was stored and what came."""
    rows = event_signals(spark, sf_dir).select("source", "signal_id", "severity", "seq")
    return memory.upsert(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), "source", "seq").drop("seq")


GRAMS = "CASE WHEN length({0}) >= 3 THEN list_distinct(list_transform(range(1, length({0}) - 1), lambda x: substr(lower({0}), x, 3))) ELSE [] END"
JACCARD = "CASE WHEN len({0}) > 0 AND len({1}) > 0 THEN len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) ELSE 0 END"


@query(
    "recall_topk",
    MEMORIES
    + f""", m AS (SELECT memory_id, signal_type, ['label=' || label, 'ns=' || namespace] AS labels, [cpu_percent, latency_ms] AS f, {GRAMS.format('message')} AS g, strength FROM memories),
q AS (SELECT signal_id AS query_id, signal_type AS q_type, ['label=' || label, 'ns=' || namespace] AS q_labels, [cpu_percent, latency_ms] AS qf, {GRAMS.format('message')} AS qg FROM signals WHERE signal_id % 50 = 0),
s AS (SELECT query_id, memory_id, round((CASE WHEN q_type = signal_type THEN 0.4 ELSE 0 END + 0.2 * {JACCARD.format('q_labels', 'labels')} + 0.2 * coalesce(list_cosine_similarity(qf, f), 0) + 0.2 * {JACCARD.format('qg', 'g')}) * strength, 6) AS score FROM m CROSS JOIN q)
SELECT query_id, memory_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM s WHERE score >= 0.1) WHERE rank <= 5""",
)
def recall_topk(spark, sf_dir):
    labels = F.array(F.concat(F.lit("label="), "label"), F.concat(F.lit("ns="), "namespace"))
    m = memories(spark, sf_dir).select("memory_id", "signal_type", labels.alias("labels"), F.array("cpu_percent", "latency_ms").alias("features"), recall.trigrams(F.col("message")).alias("grams"), "strength")
    q = event_signals(spark, sf_dir).where("signal_id % 50 = 0").select(F.col("signal_id").alias("query_id"), F.col("signal_type").alias("q_type"), labels.alias("q_labels"), F.array("cpu_percent", "latency_ms").alias("q_features"), recall.trigrams(F.col("message")).alias("q_grams"))
    return recall.recall_bounded(q, m)


_COSINE = "coalesce((q.cpu_percent * m.cpu_percent + q.latency_ms * m.latency_ms) / nullif(sqrt((q.cpu_percent * q.cpu_percent + q.latency_ms * q.latency_ms) * (m.cpu_percent * m.cpu_percent + m.latency_ms * m.latency_ms)), 0), 0)"


@query(
    "evidence_bundles",
    CASCADE_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + MEMORIES.split(SIGNALS_SQL)[1]
    + f""", kept AS (SELECT signal_id, signal_type, message, cpu_percent, latency_ms FROM done WHERE survives),
texts_ AS (SELECT DISTINCT message FROM signals), grams AS (SELECT message, {GRAMS.format('message')} AS g FROM texts_),
alike AS (SELECT a.message AS a, b.message AS b, {JACCARD.format('a.g', 'b.g')} AS j FROM grams a, grams b),
scored AS (SELECT q.signal_id, m.memory_id, m.signal_type, m.strength, m.message, round((CASE WHEN q.signal_type = m.signal_type THEN 0.4 ELSE 0 END + 0.2 * {_COSINE} + 0.2 * j) * m.strength, 6) AS score FROM kept q JOIN alike ON a = q.message JOIN memories m ON m.message = b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY score DESC, memory_id) AS rank FROM scored WHERE score >= 0.1)
SELECT signal_id, CAST(rank AS INT) AS rank, memory_id, signal_type, round(strength, 3) AS strength, substr(message, 1, 150) AS message, round(score, 3) AS score FROM ranked WHERE rank <= 5""",
)
def evidence_bundles(spark, sf_dir):
    """What is known of each survivor of the cascade: the five memories most like it, in order. Labels aren't asked for."""
    none, features = F.array().cast("array<string>"), F.array("cpu_percent", "latency_ms")
    known = memories(spark, sf_dir).select("memory_id", "signal_type", none.alias("labels"), features.alias("features"), F.col("message").alias("grams"), "strength", "message")
    kept = pipeline.survivors(cascade(spark, sf_dir)).select(F.col("signal_id").alias("query_id"), F.col("signal_type").alias("q_type"), none.alias("q_labels"), features.alias("q_features"), F.col("message").alias("q_grams"))
    found = recall.recall_bounded(kept, known, carried=("signal_type", "strength", "message"))
    return found.select(F.col("query_id").alias("signal_id"), "rank", "memory_id", "signal_type", F.round("strength", 3).alias("strength"), F.substring("message", 1, 150).alias("message"), F.round("score", 3).alias("score"))


@query("trigram_jaccard", f"WITH g AS (SELECT item_id, {GRAMS.format('text')} AS g FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round({JACCARD.format('a.g', 'b.g')}, 6) AS similarity FROM g a JOIN g b ON a.item_id < b.item_id WHERE {JACCARD.format('a.g', 'b.g')} >= 0.3")
def trigram_jaccard(spark, sf_dir):
    """Texts of which three trigrams in ten are common."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), recall.trigrams(F.col("text")).alias("grams"))
    return recall.alike(rows, 0.3).withColumn("similarity", F.round("similarity", 6))


@query("vector_topk", "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS similarity FROM embeddings CROSS JOIN q) SELECT query_id, vec_id, similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s WHERE similarity >= 0.2) WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return recall.vector_search(queries, rows, 10, 0.2)


_VECTORS = "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings"


@query(
    "vector_index_topk",
    f"""WITH v AS ({_VECTORS}), s AS (SELECT q.vec_id AS query_id, CASE WHEN v.label % 2 = 0 THEN 'memories' ELSE 'analyses' END AS source_table, v.vec_id, round(list_cosine_similarity(q.v, v.v), 6) AS similarity FROM v JOIN v q ON q.vec_id % 50 = 0)
    SELECT query_id, source_table, vec_id, similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, source_table, vec_id) AS rank FROM s WHERE similarity >= 0.2) WHERE rank <= 10""",
)
def vector_index_topk(spark, sf_dir):
    """The nearest of two tables, each searched through an index of its own until its cells' bounds certify the result."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("v", F.col("embedding").cast("array<double>"))
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    tables = {"memories": rows.where("label % 2 = 0"), "analyses": rows.where("label % 2 <> 0")}
    return neighbours.merged({name: neighbours.Index(t, dims=96).search(queries, 10, 0.2) for name, t in tables.items()}, 10)


@query("vector_index_recall", f"WITH v AS ({_VECTORS}), s AS (SELECT q.vec_id AS query_id, round(list_cosine_similarity(q.v, v.v), 6) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, v.v), 6) DESC, v.vec_id) AS rank FROM v JOIN v q ON q.vec_id % 50 = 0 WHERE round(list_cosine_similarity(q.v, v.v), 6) >= 0.2) SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, true AS recall_reached FROM s WHERE rank <= 10")
def vector_index_recall(spark, sf_dir):
    """How many of the true neighbours the index finds with as many probes as a sample of queries asks for: 0.95 or more."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    index = neighbours.Index(rows)
    found = index.search(queries, 10, 0.2, index.probes_for(queries, 0.97, 10, 0.2)).select("query_id", "vec_id", F.lit(1).alias("hit"))
    true = recall.vector_search(queries, rows, 10, 0.2)
    both = true.join(found, ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("neighbours"), (F.count("hit") >= 0.95 * F.count("*")).alias("recall_reached"))


_WORD = "substr(sha256(text || ':' || CAST(n // 8 AS VARCHAR)), CAST(n % 8 * 8 + 1 AS BIGINT), 8)"


@query(
    "hash_embedding",
    f"WITH w AS (SELECT item_id, n, {_WORD} AS w FROM benchmark, range(0, 384) AS r(n)), v AS (SELECT item_id, n, ('0x' || substr(w, 7, 2) || substr(w, 5, 2) || substr(w, 3, 2) || substr(w, 1, 2))::BIGINT AS v FROM w),"
    " s AS (SELECT item_id, n, CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END / 2147483648.0::DOUBLE AS x FROM v), z AS (SELECT item_id, sqrt(sum(x * x)) AS size FROM s GROUP BY item_id)"
    " SELECT item_id, list(round(x / size, 6) ORDER BY n) AS embedding FROM s JOIN z USING (item_id) GROUP BY item_id",
)
def hash_embedding(spark, sf_dir):
    made = recall.hash_embedding(F.col("text"))
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.transform(made, lambda x: F.round(x, 6)).alias("embedding"))
