"""Queries over rules that climb and fall, choices of models, evidence of what was suppressed, and texts that may be bad."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.operators import inverse, pipeline, promotion, routing, serving
from tamis.plans.insight import ARCHIVE
from tamis.plans.learning import COUNTS, STATUS, validated
from tamis.plans.registry import query
from tamis.plans.sieve import cascade
from tamis.sources.adapters import SIGNALS_SQL, event_signals, seconds_of

# ---------------------------------------------------------------- tiers


@query(
    "promotion_walk",
    f"""{COUNTS}, t AS (SELECT signal_type, noise + important AS samples, important, important / (noise + important) AS unsafe FROM counts WHERE level = 'type' AND noise + important > 0),
    w AS (SELECT *, CASE WHEN samples >= 50 AND 1 - unsafe >= 0.6 AND unsafe <= 0.2 THEN CASE WHEN samples >= 200 AND unsafe <= 0 THEN 'nano' ELSE 'candidate' END ELSE 'draft' END AS tier, samples >= 200 AND important = 0 AS enough FROM t)
    SELECT signal_type, 'promoted' AS event, tier, CASE WHEN enough THEN 'green' ELSE 'red' END AS status, samples, important FROM w WHERE tier <> 'draft'
    UNION ALL SELECT signal_type, 'activated', tier, 'validated', samples, important FROM w WHERE tier = 'nano' AND enough""",
)
def promotion_walk(spark, sf_dir):
    """What the log says after types have climbed as far as their answers carry them."""
    return promotion.walk_events(promotion.walk_types(promotion.label_counts(event_signals(spark, sf_dir))))


@query(
    "demotion_events",
    f"{STATUS}, a AS (SELECT *, CASE WHEN name < 'h' THEN 'candidate' WHEN name < 'n' THEN 'draft' ELSE 'nano' END AS tier FROM status) SELECT name AS agent_name, 'demotion' AS event_type, tier AS from_tier, 'draft' AS to_tier, samples AS samples_tested, accuracy, false_positive_rate, false_negative_rate, fn AS false_negative_count, fn || ' false negative(s) in validation batch' AS reason FROM a WHERE tier = 'nano' AND fn > 0",
)
def demotion_events(spark, sf_dir):
    tier = F.when(F.col("name") < "h", "candidate").when(F.col("name") < "n", "draft").otherwise("nano")
    return promotion.demotions(validated(spark, sf_dir).withColumns({"tier": tier, "deactivated": F.lit(False)}))


# ---------------------------------------------------------------- models

_ENTRY = "p_type AS industry, p_brand AS task, CASE WHEN p_size % 2 = 0 THEN 'micro' ELSE 'macro' END AS tier"
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY industry, task, tier ORDER BY price, part) AS r FROM (SELECT {_ENTRY}, concat('m', CAST(p_partkey % 37 AS {{0}})) AS model, CASE WHEN p_partkey % 3 = 0 THEN 'int8' ELSE 'bf16' END AS dtype, p_retailprice AS price, p_partkey AS part FROM part)"
_WANTED = f"SELECT DISTINCT {_ENTRY}, p_partkey % 2 = 0 AS use_int8, p_partkey % 5 AS k FROM part"


@query(
    "corpora_choice",
    f"""WITH ranked AS ({_RANKED.format("VARCHAR")}), e AS (SELECT industry, task, tier, any_value({{'model': model, 'dtype': dtype}}) FILTER (r = 1) AS config, any_value({{'model': model, 'dtype': dtype}}) FILTER (r = 2) AS fb, coalesce(list({{'model': model, 'dtype': dtype}} ORDER BY r) FILTER (r BETWEEN 3 AND 6), []) AS alt FROM ranked GROUP BY ALL HAVING count(*) % 4 > 0),
    wanted AS (SELECT *, ['m' || (k * 7), 'm' || (k * 3 + 1), 'm' || (k + 20)] AS excluded FROM ({_WANTED})),
    b AS (SELECT w.*, coalesce(e.config, d.config) AS config, CASE WHEN e.config IS NOT NULL THEN e.fb ELSE d.fb END AS fb, coalesce(e.alt, d.alt) AS alt FROM wanted w LEFT JOIN e USING (industry, task, tier) LEFT JOIN (SELECT * FROM e WHERE industry = 'ECONOMY') d ON d.task = w.task AND d.tier = w.tier),
    i AS (SELECT *, list_filter(alt, lambda a: a.dtype = 'int8')[1] AS q FROM b WHERE config IS NOT NULL),
    s AS (SELECT *, use_int8 AND config.dtype <> 'int8' AND q IS NOT NULL AS swaps FROM i),
    c AS (SELECT industry, task, tier, use_int8, k, excluded, CASE WHEN swaps THEN q ELSE config END AS c, CASE WHEN swaps THEN config ELSE fb END AS f, CASE WHEN swaps THEN list_filter(alt, lambda a: a.model <> q.model) ELSE alt END AS a FROM s),
    g AS (SELECT *, list_contains(excluded, c.model) AS gone, list_filter(a, lambda x: NOT list_contains(excluded, x.model))[1] AS left_ FROM c),
    h AS (SELECT *, CASE WHEN NOT gone THEN c WHEN f IS NOT NULL AND NOT list_contains(excluded, f.model) THEN f ELSE left_ END AS chosen FROM g)
    SELECT industry, task, tier, use_int8, k, chosen.model AS model, chosen.dtype AS dtype, CASE WHEN NOT gone THEN f.model END AS fallback FROM h WHERE chosen IS NOT NULL""",
)
def corpora_choice(spark, sf_dir):
    """Models for each industry, task and tier that is asked for, with INT8 where it is wanted, without what is excluded."""
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("part")
    ranked = spark.sql(_RANKED.format("STRING"))
    one = F.struct("model", "dtype")
    at = lambda n: F.first(F.when(F.col("r") == n, one), ignorenulls=True)
    later = F.array_sort(F.collect_list(F.when(F.col("r").between(3, 6), F.struct("r", "model", "dtype"))))
    entries = ranked.groupBy("industry", "task", "tier").agg(at(1).alias("config"), at(2).alias("fallback"), later.alias("a"), F.count("*").alias("n")).where("n % 4 > 0")
    entries = entries.withColumn("alternatives", F.transform("a", lambda x: F.struct(x["model"].alias("model"), x["dtype"].alias("dtype")))).drop("a", "n")
    name = lambda n: F.concat(F.lit("m"), n.cast("string"))
    k = F.col("k")
    wanted = spark.sql(_WANTED).withColumn("excluded", F.array(name(k * 7), name(k * 3 + 1), name(k + 20)))
    return serving.choose_entry(wanted, entries, "ECONOMY").drop("excluded")


_TASK = "CASE l_partkey % 5 WHEN 0 THEN 'classify-short' WHEN 1 THEN 'summarize-long' WHEN 2 THEN 'similarity-search' WHEN 3 THEN 'clinical-classification' ELSE 'unheard-of' END"


@query(
    "latency_graded",
    f"WITH s AS (SELECT {_TASK} AS task, l_suppkey, max(l_extendedprice) / 20 AS p95_ms FROM lineitem GROUP BY ALL), g AS (SELECT *, CASE task WHEN 'classify-short' THEN 200 WHEN 'summarize-long' THEN 3000 WHEN 'similarity-search' THEN 10 ELSE 500 END AS green, CASE task WHEN 'classify-short' THEN 500 WHEN 'summarize-long' THEN 8000 WHEN 'similarity-search' THEN 50 ELSE 2000 END AS yellow FROM s) SELECT task, l_suppkey, CASE WHEN p95_ms <= green THEN 'green' WHEN p95_ms <= yellow THEN 'yellow' ELSE 'red' END AS grade FROM g",
)
def latency_graded(spark, sf_dir):
    """Suppliers' slowest items as latencies of tasks, of which one has no limits of its own."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.expr(_TASK).alias("task"), "l_suppkey").agg((F.max("l_extendedprice") / 20).alias("p95_ms"))
    return rows.select("task", "l_suppkey", routing.task_latency_grade(F.col("task"), F.col("p95_ms")).alias("grade"))


# ---------------------------------------------------------------- evidence, analyses, times


@query(
    "suppression_evidence",
    ARCHIVE
    + ", e AS (SELECT d.signal_type, agent_name, arg_min(substr(d.agent_name || ' of ' || s.message || ' from ' || s.source, 1, 200), d.signal_id) AS evidence_sample FROM decisions d JOIN signals s ON s.signal_id = d.signal_id WHERE outcome IN ('suppress', 'dedupe', 'drop') GROUP BY ALL) SELECT signal_type, agent_name, count, strength, evidence_sample FROM archive JOIN e USING (signal_type, agent_name) ORDER BY archive.strength DESC, signal_type, agent_name LIMIT 4",
)
def suppression_evidence(spark, sf_dir):
    """The four strongest patterns of what was suppressed, with what the first decision of each said."""
    run = cascade(spark, sf_dir)
    made = pipeline.decisions(run).join(run.select("signal_id", "message", "source"), "signal_id")
    said = F.concat("agent_name", F.lit(" of "), "message", F.lit(" from "), "source")
    return inverse.archive_with_evidence(made, said, 4).select("signal_type", "agent_name", "count", "strength", "evidence_sample")


@query(
    "biography_analyses",
    f"WITH {SIGNALS_SQL} SELECT signal_type, count(*) AS analyses, round(avg(cpu_percent / 100), 3) AS confidence, array_to_string(list_sort(list(DISTINCT substr(message, 1, 150)))[1:5], '|') AS root_causes FROM signals WHERE severity IN ('high', 'critical') GROUP BY signal_type",
)
def biography_analyses(spark, sf_dir):
    """Grave events as analyses: by type how many, how sure, and up to five of their causes."""
    grave = event_signals(spark, sf_dir).where("severity in ('high', 'critical')")
    causes = F.slice(F.array_sort(F.collect_set(F.substring("message", 1, 150))), 1, 5)
    return grave.groupBy("signal_type").agg(F.count("*").alias("analyses"), F.round(F.avg(F.col("cpu_percent") / 100), 3).alias("confidence"), F.array_join(causes, "|").alias("root_causes"))


_TIME = "CASE event_id % 5 WHEN 0 THEN CAST(ts AS {0}) WHEN 1 THEN concat('2024-01-', CAST(event_id % 28 + 1 AS {0}), ' soon') WHEN 2 THEN concat('2024-01-0', CAST(event_id % 9 + 1 AS {0}), 'T10:00:00Z') WHEN 3 THEN '' ELSE concat('2024-02-3', CAST(event_id % 10 AS {0})) END"


@query("times_read", f"WITH t AS (SELECT event_id, {_TIME.format('VARCHAR')} AS t FROM events) SELECT event_id, coalesce(epoch_us(try_cast(t AS TIMESTAMP)) / 1e6, 0)::DOUBLE AS seconds FROM t")
def times_read(spark, sf_dir):
    """Times as texts, of which some are none."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(_TIME.format("STRING")).alias("t"))
    return rows.select("event_id", seconds_of("t").alias("seconds"))
