"""Queries that discover rules and promote them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators import discovery, promotion
from tamis.plans.registry import query
from tamis.sources.adapters import SIGNALS_SQL, event_signals

WITH = f"WITH {SIGNALS_SQL}"
NOISE = "(contains(answer, 'routine_noise') OR contains(answer, 'known_pattern'))"
COUNTS = f"{WITH}, counts AS (SELECT signal_type, coalesce(namespace, '') AS namespace, CASE WHEN grouping(namespace) = 1 THEN 'type' ELSE 'context' END AS level, count_if({NOISE})::BIGINT AS noise, count_if(NOT {NOISE})::BIGINT AS important FROM signals GROUP BY GROUPING SETS ((signal_type), (signal_type, namespace)))"
FLOODS = "SELECT signal_type, sum(n)::BIGINT AS count, (SELECT count(*) FROM signals) AS total_signals, sum(n)::BIGINT / (SELECT count(*) FROM signals) AS frequency FROM (SELECT signal_type, count(*) AS n FROM signals GROUP BY signal_type, source, namespace HAVING count(*) >= 10) GROUP BY signal_type"
DOMINANT = "SELECT signal_type, count, total_signals, count / total_signals AS frequency FROM (SELECT signal_type, count(*) AS count, min(seq) AS s, (SELECT count(*) FROM signals) AS total_signals FROM signals GROUP BY signal_type ORDER BY count DESC, s LIMIT 10) WHERE count / total_signals >= 0.05"


@query("discover_repeat", f"{WITH} {FLOODS}")
def discover_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.repeat_floods(event_signals(spark, sf_dir))


@query("discover_dominant", f"{WITH} {DOMINANT}")
def discover_dominant(spark, sf_dir):
    return discovery.dominant_types(event_signals(spark, sf_dir))


@query("discover_mono_severity", f"{WITH} SELECT *, count / type_total AS frequency FROM (SELECT *, (sum(count) OVER (PARTITION BY signal_type))::BIGINT AS type_total FROM (SELECT signal_type, severity, count(*) AS count FROM signals GROUP BY ALL)) WHERE type_total >= 20 AND count / type_total > 0.8")
def discover_mono_severity(spark, sf_dir):
    return discovery.mono_severity(event_signals(spark, sf_dir))


@query("discover_samples", f"{WITH} SELECT signal_type, CAST(r - 1 AS INT) AS pos, signal_id FROM (SELECT *, row_number() OVER (PARTITION BY signal_type ORDER BY signal_id) AS r FROM signals) WHERE r <= 3")
def discover_samples(spark, sf_dir):
    return discovery.samples(event_signals(spark, sf_dir))


@query(
    "draft_agents",
    f"{WITH} SELECT signal_type, count, round(frequency, 6) AS frequency, 'repeat_flood' AS pattern_type, 'suppress_' || signal_type || '_repeat' AS name, signal_type || '_repeat_noise' AS classification, 'draft' AS tier FROM ({FLOODS}) UNION ALL SELECT signal_type, count, round(frequency, 6), 'dominant_type', 'classify_' || signal_type, signal_type || '_classified', 'draft' FROM ({DOMINANT})",
)
def draft_agents(spark, sf_dir):
    return discovery.draft_agents(event_signals(spark, sf_dir))


@query("oracle_counts", f"{COUNTS} SELECT * FROM counts")
def oracle_counts(spark, sf_dir):
    return promotion.label_counts(event_signals(spark, sf_dir))


def _promoted(share: float) -> str:
    return f"SELECT signal_type, noise + important AS samples, important, important / (noise + important) AS important_rate FROM counts WHERE level = 'type' AND noise + important >= 200 AND important / (noise + important) <= {share}"


@query("promote_types", f"{COUNTS} {_promoted(0.0)}")
def promote_types(spark, sf_dir):
    return promotion.promote_types(promotion.label_counts(event_signals(spark, sf_dir)))


@query("restore_promotion", f"{COUNTS} {_promoted(0.02)}")
def restore_promotion(spark, sf_dir):
    return promotion.promote_types(promotion.label_counts(event_signals(spark, sf_dir)), share=0.02)


@query("promote_contexts", f"{COUNTS} SELECT signal_type, namespace, noise + important AS samples, important, important / (noise + important) AS important_rate FROM counts WHERE level = 'context' AND signal_type NOT IN (SELECT signal_type FROM ({_promoted(0.02)})) AND noise + important >= 100 AND important / (noise + important) <= 0.02")
def promote_contexts(spark, sf_dir):
    counts = promotion.label_counts(event_signals(spark, sf_dir))
    return promotion.promote_contexts(counts, promotion.promote_types(counts, share=0.02).select("signal_type"))


@query("activation_ttl", f"{WITH}, seen AS (SELECT signal_type, namespace, max(ts) AS activated FROM signals GROUP BY ALL) SELECT signal_type, namespace FROM seen WHERE epoch_us(TIMESTAMP '2024-01-31') - epoch_us(activated) >= 12 * 3600000000")
def activation_ttl(spark, sf_dir):
    """Activations (here: the last event of a type and namespace) that are older than their time to live."""
    seen = event_signals(spark, sf_dir).groupBy("signal_type", "namespace").agg(F.max("us").alias("activated"))
    return seen.where(F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.col("activated") >= 12 * 3600 * 1_000_000).select("signal_type", "namespace")


LONG = "long AS (SELECT signal_id, signal_type, 'cpu_percent' AS field, CAST(CAST(cpu_percent AS INT) AS VARCHAR) AS value FROM signals UNION ALL SELECT signal_id, signal_type, 'severity', severity FROM signals UNION ALL SELECT signal_id, signal_type, 'message', message FROM signals)"
RULES = [("hot", "cpu_percent", "gt", "90"), ("idle", "cpu_percent", "lte", "10"), ("exact", "cpu_percent", "eq", "50.0"), ("grave", "severity", "eq", "critical"), ("not_low", "severity", "ne", "low"), ("panic", "message", "contains", "panic"), ("text_order", "severity", "gt", "high")]
BASELINE = [("pod_crashloop", "cpu_percent", 5.0, 92.0), ("heartbeat", "cpu_percent", 0.0, 95.0), ("probe_failure", "cpu_percent", 10.0, 80.0), ("event_unhealthy", "cpu_percent", 0.0, 90.0)]
_RULES_SQL = "rules(name, field, op, operand) AS (VALUES " + ", ".join(str(r) for r in RULES) + ")"
_BASE_SQL = "baseline(signal_type, field, low, high) AS (VALUES " + ", ".join(str(r) for r in BASELINE) + ")"
_TEST = " ".join(f"WHEN op = '{k}' THEN CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a {s} b ELSE value {s} operand END" for k, s in (("gt", ">"), ("lt", "<"), ("gte", ">="), ("lte", "<="), ("eq", "="), ("ne", "<>")))
FLAGGED = f"flagged AS (SELECT *, coalesce(CASE {_TEST} WHEN op = 'contains' THEN contains(value, operand) END, false) AS flagged FROM (SELECT *, try_cast(value AS DOUBLE) AS a, try_cast(operand AS DOUBLE) AS b FROM long JOIN rules USING (field)))"
ABNORMAL = "abnormal AS (SELECT signal_id, coalesce(bool_or(try_cast(value AS DOUBLE) < low OR try_cast(value AS DOUBLE) > high), false) AS abnormal FROM long LEFT JOIN baseline USING (signal_type, field) GROUP BY signal_id)"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal's fields as rows of text."""
    signals = event_signals(spark, sf_dir)
    fields = F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in (("cpu_percent", F.col("cpu_percent").cast("int").cast("string")), ("severity", F.col("severity")), ("message", F.col("message")))))
    return signals.select("signal_id", "signal_type", F.inline(fields))


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "name string, field string, op string, operand string")


def baseline(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BASELINE, "signal_type string, field string, low double, high double")


@query("rule_predicates", f"{WITH}, {LONG}, {_RULES_SQL}, {FLAGGED} SELECT name, signal_type, count_if(flagged)::BIGINT AS flagged, count(*) AS samples FROM flagged GROUP BY ALL")
def rule_predicates(spark, sf_dir):
    made = promotion.evaluate_rules(readings(spark, sf_dir), rules(spark))
    return made.groupBy("name", "signal_type").agg(F.count_if("flagged").alias("flagged"), F.count("*").alias("samples"))


@query("baseline_abnormal", f"{WITH}, {LONG}, {_BASE_SQL}, {ABNORMAL} SELECT * FROM abnormal WHERE abnormal")
def baseline_abnormal(spark, sf_dir):
    return promotion.abnormal(readings(spark, sf_dir), baseline(spark)).where("abnormal")


_RATE = "CASE WHEN {1} > 0 THEN ({0}) / ({1}) ELSE 0.0 END"
METRICS = f"counts AS (SELECT name, count(*) AS samples, count_if(flagged AND abnormal)::BIGINT AS tp, count_if(flagged AND NOT abnormal)::BIGINT AS fp, count_if(NOT flagged AND NOT abnormal)::BIGINT AS tn, count_if(NOT flagged AND abnormal)::BIGINT AS fn FROM flagged JOIN abnormal USING (signal_id) GROUP BY name), metrics AS (SELECT *, (tp + tn) / samples AS accuracy, {_RATE.format('fp', 'fp + tn')} AS false_positive_rate, {_RATE.format('fn', 'fn + tp')} AS false_negative_rate, (tp + fp) / samples AS coverage FROM counts), status AS (SELECT *, CASE WHEN false_negative_rate > 0.2 THEN 'red' WHEN accuracy >= 0.75 AND false_positive_rate <= 0.15 THEN 'green' WHEN accuracy >= 0.6 THEN 'yellow' ELSE 'red' END AS rubric_status FROM metrics)"
STATUS = f"{WITH}, {LONG}, {_RULES_SQL}, {FLAGGED}, {_BASE_SQL}, {ABNORMAL}, {METRICS}"


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every rule over every signal, the truth being whether the signal is outside its type's ranges."""
    flagged = promotion.evaluate_rules(readings(spark, sf_dir), rules(spark))
    return promotion.confusion(flagged.join(promotion.abnormal(readings(spark, sf_dir), baseline(spark)), "signal_id"), "name")


@query("confusion_metrics", f"{STATUS} SELECT * FROM status")
def confusion_metrics(spark, sf_dir):
    return validated(spark, sf_dir)


@query("rubric_matrix", f"{STATUS} SELECT *, total - green - yellow AS red, CASE WHEN total = 0 THEN 'red' WHEN green / total >= 0.5 THEN 'green' WHEN (green + yellow) / total >= 0.3 THEN 'yellow' ELSE 'red' END AS overall FROM (SELECT count(*) AS total, count_if(rubric_status = 'green')::BIGINT AS green, count_if(rubric_status = 'yellow')::BIGINT AS yellow FROM status)")
def rubric_matrix(spark, sf_dir):
    return promotion.rubric_matrix(validated(spark, sf_dir))


@query("tier_ladder", f"{STATUS} SELECT name, tier, CASE WHEN tier = 'nano' AND fn > 0 THEN 'draft' WHEN tier = 'draft' AND samples >= 50 AND accuracy >= 0.6 AND false_positive_rate <= 0.3 AND false_negative_rate <= 0.2 THEN 'candidate' WHEN tier = 'candidate' AND samples >= 200 AND accuracy >= 0.75 AND false_positive_rate <= 0.15 AND false_negative_rate <= 0 THEN 'nano' ELSE tier END AS new_tier, tier = 'nano' AND fn > 0 AS deactivated FROM (SELECT *, CASE WHEN name < 'h' THEN 'candidate' WHEN name < 'n' THEN 'draft' ELSE 'nano' END AS tier FROM status)")
def tier_ladder(spark, sf_dir):
    tier = F.when(F.col("name") < "h", "candidate").when(F.col("name") < "n", "draft").otherwise("nano")
    agents = validated(spark, sf_dir).withColumns({"tier": tier, "human_reviewed": F.lit(False), "human_approved": F.lit(False), "deactivated": F.lit(False)})
    return promotion.next_tier(agents).select("name", "tier", "new_tier", "deactivated")


@query("feedback_demotion", f"{COUNTS}, active AS ({_promoted(0.02)}), missed AS (SELECT signal_type, count(*) AS misses FROM signals WHERE NOT {NOISE} AND severity = 'critical' GROUP BY 1) SELECT signal_type, samples, important, important_rate, coalesce(misses, 0) AS misses, coalesce(misses, 0) = 0 AS active FROM active LEFT JOIN missed USING (signal_type)")
def feedback_demotion(spark, sf_dir):
    signals = event_signals(spark, sf_dir)
    reports = signals.select("signal_type", (F.col("severity") == "critical").alias("was_suppressed"), (~promotion.is_noise()).alias("is_important"))
    return promotion.feedback(promotion.promote_types(promotion.label_counts(signals), share=0.02), reports)


@query("quality_confusion", "SELECT lang, samples, tp, fp, tn, fn, (tp + tn) / samples AS accuracy, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END AS false_positive_rate, CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0.0 END AS false_negative_rate, (tp + fp) / samples AS coverage FROM (SELECT lang, count(*) AS samples, count_if(f AND a)::BIGINT AS tp, count_if(f AND NOT a)::BIGINT AS fp, count_if(NOT f AND NOT a)::BIGINT AS tn, count_if(NOT f AND a)::BIGINT AS fn FROM (SELECT lang, n_chars < 1000 AS f, quality = 0 AS a FROM documents JOIN labels USING (doc_id)) GROUP BY lang)")
def quality_confusion(spark, sf_dir):
    """How a rule on length does against quality labels, by language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars")
    rows = docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"), "doc_id")
    return promotion.confusion(rows.select("lang", (F.col("n_chars") < 1000).alias("flagged"), (F.col("quality") == 0).alias("abnormal")), "lang").drop("rubric_status")
