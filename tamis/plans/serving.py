"""Queries over routing, benchmarks, pressure and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators import serving
from tamis.plans.registry import query
from tamis.sources.adapters import SIGNALS_SQL, event_signals

WITH = f"WITH RECURSIVE {SIGNALS_SQL}"
TASKS = ("classify-short", "medical-ner", "summarize-long", "generate-qa", "encode-text", "unknown-task")
TASK = "CASE CAST(cpu_percent AS INT) % 6 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TASKS)) + " END"
_LANE = "CASE task " + " ".join(f"WHEN '{t}' THEN '{lane}'" for lane, tasks in serving.LANES.items() for t in tasks) + " ELSE 'classification' END"
_MODEL = "CASE lane " + " ".join(f"WHEN '{lane}' THEN {[m for m in models if m != 'mistral-7b']!r}" for lane, models in serving.LANE_MODELS.items()) + " END"
_TOKENS = "CASE lane " + " ".join(f"WHEN '{lane}' THEN {n}" for lane, n in serving.LANE_TOKENS.items()) + " END"


@query("lane_route", f"{WITH}, l AS (SELECT signal_id, seq, severity, {_LANE} AS lane FROM (SELECT *, {TASK} AS task FROM signals)), r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY seq) - 1 AS r, {_MODEL} AS m FROM l) SELECT signal_id, lane, CASE WHEN severity IN ('critical', 'high') THEN 'macro' ELSE 'micro' END AS tier, CAST({_TOKENS} AS INT) AS max_tokens, m[r % len(m) + 1] AS model FROM r")
def lane_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = event_signals(spark, sf_dir).select("signal_id", "seq", "severity", F.expr(TASK).alias("task_type"), F.floor(F.col("us") / 86_400_000_000).alias("slice"))
    return serving.route(requests, ("mistral-7b",)).select("signal_id", "lane", "tier", "max_tokens", "model")


FINGERPRINT = f"{WITH}, recent AS (SELECT *, row_number() OVER (ORDER BY seq DESC) - 1 AS age FROM signals ORDER BY seq DESC LIMIT 200), long AS (SELECT age, 'signal_type' AS dim, signal_type AS key FROM recent UNION ALL SELECT age, 'severity', severity FROM recent), w AS (SELECT dim, key, sum(pow(0.95, age)) AS w FROM long GROUP BY ALL), print AS (SELECT dim, key, w / sum(w) OVER (PARTITION BY dim) AS weight FROM w)"
PROFILES = [("platform", "signal_type", "pod_crashloop", 0.6), ("platform", "signal_type", "probe_failure", 0.4), ("platform", "severity", "high", 0.5), ("platform", "severity", "low", 0.5), ("payments", "signal_type", "txn_purchase", 1.0), ("payments", "severity", "medium", 1.0), ("quiet", "signal_type", "heartbeat", 0.9), ("quiet", "severity", "low", 1.0)]


@query("fingerprint_weights", f"{FINGERPRINT} SELECT dim, key, round(weight, 6) AS weight FROM print")
def fingerprint_weights(spark, sf_dir):
    return serving.fingerprint(event_signals(spark, sf_dir), ["signal_type", "severity"]).withColumn("weight", F.round("weight", 6))


@query("workload_classify", f"{FINGERPRINT}, profiles(workload, dim, key, p) AS (VALUES {', '.join(map(str, PROFILES))}), q AS (SELECT sum(weight * weight) AS q FROM print) SELECT workload, round(least(1.0, sum(p * coalesce(weight, 0)) / sqrt(sum(p * p) * any_value(q)) + CASE WHEN workload = 'platform' THEN 0.1 ELSE 0 END), 4)::DOUBLE AS similarity FROM profiles LEFT JOIN print USING (dim, key), q GROUP BY workload")
def workload_classify(spark, sf_dir):
    profiles = spark.createDataFrame(PROFILES, "workload string, dim string, key string, weight double")
    boosted = spark.createDataFrame([("platform",)], "workload string")
    return serving.classify_workload(serving.fingerprint(event_signals(spark, sf_dir), ["signal_type", "severity"]), profiles, boosted)


@query("model_rank", "WITH c AS (SELECT p_brand AS brand, p_name || '#' || p_partkey AS model, CASE p_size % 3 WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' ELSE 'red' END AS quality, CASE WHEN p_partkey % 2 = 0 THEN 'green' ELSE 'red' END AS latency, p_partkey % 5 = 0 AS varies, p_retailprice AS speed, p_size AS params FROM part), g AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY CASE quality WHEN 'green' THEN 0 WHEN 'yellow' THEN 1 ELSE 2 END, CASE latency WHEN 'green' THEN 0 ELSE 2 END, varies::INT, speed DESC, params, model) AS rank FROM c) SELECT brand, model, CAST(rank AS INT) AS rank, CASE WHEN rank = 1 THEN 'primary' WHEN rank = 2 THEN 'fallback' WHEN rank <= 5 THEN 'alternative' ELSE 'none' END AS role FROM g")
def model_rank(spark, sf_dir):
    grade = F.when(F.col("p_size") % 3 == 0, "green").when(F.col("p_size") % 3 == 1, "yellow").otherwise("red")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("brand"), F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("model"), grade.alias("quality"), F.when(F.col("p_partkey") % 2 == 0, "green").otherwise("red").alias("latency"), (F.col("p_partkey") % 5 == 0).alias("varies"), F.col("p_retailprice").alias("speed"), F.col("p_size").alias("params"))
    return serving.rank_models(rows, "brand").select("brand", "model", "rank", "role")


@query("corpora_lookup", "WITH e AS (SELECT p_type AS industry, p_brand AS task, list(DISTINCT p_name ORDER BY p_name) AS models FROM part GROUP BY ALL HAVING count(*) % 2 = 0), basic AS (SELECT task, models FROM e WHERE industry = 'ECONOMY'), w AS (SELECT DISTINCT p_type AS industry, p_brand AS task FROM part) SELECT w.industry, w.task, list_filter(coalesce(e.models, basic.models), lambda x: x NOT IN ('red widget', ''))[1] AS model FROM w LEFT JOIN e ON e.industry = w.industry AND e.task = w.task LEFT JOIN basic ON basic.task = w.task")
def corpora_lookup(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("industry"), F.col("p_brand").alias("task"), "p_name")
    # entries are missing where a group has an odd number of parts
    entries = part.groupBy("industry", "task").agg(F.array_sort(F.collect_set("p_name")).alias("models"), F.count("*").alias("n")).where("n % 2 = 0").drop("n")
    return serving.lookup(part.select("industry", "task").distinct(), entries, ("red widget",), "ECONOMY")


_SIZE = "CAST(p_size AS {0})"
_PARAMS = "CASE p_partkey % 6 WHEN 0 THEN concat({0}, '0M') WHEN 1 THEN concat({0}, 'B') WHEN 2 THEN concat({0}, '.5B') WHEN 3 THEN concat({0}, 'B+350M') WHEN 4 THEN concat({0}, '5B total / ', {0}, 'B active (MoE)') ELSE 'unknown' END"


@query("params_parse", f"SELECT p_partkey, {_PARAMS.format(_SIZE.format('VARCHAR'))} AS params, CASE p_partkey % 6 WHEN 0 THEN round(p_size / 100.0, 6) WHEN 1 THEN p_size WHEN 2 THEN p_size + 0.5 WHEN 3 THEN p_size WHEN 4 THEN p_size ELSE 0 END::DOUBLE AS billions FROM part")
def params_parse(spark, sf_dir):
    """Parts' sizes as models' parameters in all the ways that they are written."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(_PARAMS.format(_SIZE.format("STRING"))).alias("params"))
    return rows.withColumn("billions", F.round(serving.params_billions(F.col("params")), 6))


SAMPLES = "SELECT l_shipdate, l_returnflag AS model, l_linestatus AS task, l_extendedprice AS latency_ms, l_quantity AS output_tokens FROM lineitem"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as benchmark samples."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("task"), F.col("l_extendedprice").alias("latency_ms"), F.col("l_quantity").alias("output_tokens"))


@query("bench_percentiles", f"WITH s AS ({SAMPLES}) SELECT model, task, count(*) AS samples, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, round(sum(output_tokens) / (sum(latency_ms) / 1000), 2) AS tokens_per_s, round(stddev_samp(latency_ms) / avg(latency_ms), 4) AS variation, stddev_samp(latency_ms) / avg(latency_ms) > 0.2 AS varies FROM s GROUP BY ALL")
def bench_percentiles(spark, sf_dir):
    return serving.latency_table(samples(spark, sf_dir), "model", "task")


@query("bench_soak_rank", f"WITH s AS ({SAMPLES}), r AS (SELECT model, latency_ms, row_number() OVER (PARTITION BY model ORDER BY latency_ms) - 1 AS r, count(*) OVER (PARTITION BY model) AS n FROM s) SELECT model, max(n) AS samples, max(CASE WHEN r = floor(n * 0.5) THEN latency_ms END) AS median_ms, max(CASE WHEN r = floor(n * 0.95) THEN latency_ms END) AS p95_ms FROM r GROUP BY model")
def bench_soak_rank(spark, sf_dir):
    return serving.nearest_rank(samples(spark, sf_dir), "model")


@query("best_throughput", f"WITH s AS ({SAMPLES}), t AS (SELECT model, task, sum(output_tokens) / sum(latency_ms) AS t FROM s GROUP BY ALL) SELECT model, arg_max(task, t) AS task, round(max(t), 9) AS throughput FROM t GROUP BY model")
def best_throughput(spark, sf_dir):
    per = samples(spark, sf_dir).groupBy("model", "task").agg((F.sum("output_tokens") / F.sum("latency_ms")).alias("t"))
    return per.groupBy("model").agg(F.max_by("task", "t").alias("task"), F.round(F.max("t"), 9).alias("throughput"))


@query("majority_vote", f"{WITH}, v AS (SELECT source, seq, CASE severity WHEN 'info' THEN 'Neutral I think' WHEN 'low' THEN ' neutral' WHEN 'medium' THEN 'it is POSITIVE overall' WHEN 'high' THEN 'negative' ELSE 'cannot say anything about that' END AS answer FROM signals), w AS (SELECT source, seq, coalesce(nullif(regexp_extract(lower(trim(answer)), '(?:^|\\s)(positive|negative|neutral)(?:\\s|$)', 1), ''), substr(lower(trim(answer)), 1, 20)) AS vote FROM v), c AS (SELECT source, vote, count(*) AS n, min(seq) AS f FROM w GROUP BY ALL) SELECT source, vote AS winner, n AS votes, total, round(n / total, 6) AS agreement FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS r, (sum(n) OVER (PARTITION BY source))::BIGINT AS total FROM c) WHERE r = 1")
def majority_vote(spark, sf_dir):
    answer = F.expr("CASE severity WHEN 'info' THEN 'Neutral I think' WHEN 'low' THEN ' neutral' WHEN 'medium' THEN 'it is POSITIVE overall' WHEN 'high' THEN 'negative' ELSE 'cannot say anything about that' END")
    return serving.majority(event_signals(spark, sf_dir).select("source", "seq", answer.alias("answer")), "source")


GRADED = "CASE WHEN severity IN ('info', 'low') THEN 'green' WHEN severity = 'medium' THEN 'yellow' ELSE 'red' END"


@query("rubric_summary", f"{WITH}, g AS (SELECT signal_type, namespace, {GRADED} AS overall FROM signals) SELECT coalesce(signal_type, '') AS signal_type, coalesce(namespace, '') AS namespace, count(*) AS total, count_if(overall = 'green')::BIGINT AS green, count_if(overall = 'yellow')::BIGINT AS yellow, count_if(overall = 'red')::BIGINT AS red, round(count_if(overall = 'green') / count(*), 4)::DOUBLE AS pass_rate FROM g GROUP BY GROUPING SETS ((signal_type), (namespace), ())")
def rubric_summary(spark, sf_dir):
    graded = event_signals(spark, sf_dir).withColumn("overall", F.expr(GRADED))
    is_ = lambda c: F.count_if(F.col("overall") == c)
    made = graded.groupingSets([["signal_type"], ["namespace"], []], "signal_type", "namespace").agg(F.count("*").alias("total"), is_("green").alias("green"), is_("yellow").alias("yellow"), is_("red").alias("red"))
    return made.select(F.coalesce("signal_type", F.lit("")).alias("signal_type"), F.coalesce("namespace", F.lit("")).alias("namespace"), "total", "green", "yellow", "red", F.round(F.col("green") / F.col("total"), 4).alias("pass_rate"))


@query("precision_score", f"{WITH} SELECT signal_type, count_if(severity = 'critical')::BIGINT AS true_important, count_if(severity = 'low')::BIGINT AS false_important, round(count_if(severity = 'critical') / greatest(1, count_if(severity IN ('critical', 'low'))), 6)::DOUBLE AS precision FROM signals GROUP BY 1")
def precision_score(spark, sf_dir):
    made = event_signals(spark, sf_dir).groupBy("signal_type").agg(F.count_if(F.col("severity") == "critical").alias("true_important"), F.count_if(F.col("severity") == "low").alias("false_important"))
    return made.withColumn("precision", F.round(F.col("true_important") / F.greatest(F.lit(1), F.col("true_important") + F.col("false_important")), 6))


_READ = "SELECT signal_id, seq, us, source, cpu_percent AS cpu_some, CAST(seq % 40 AS DOUBLE) AS memory_some, 50 + CAST(seq % 50 AS DOUBLE) AS memory_used, least(100, latency_ms) AS io_some FROM signals"
_GRADE = "CASE WHEN {0} <= {1} THEN 'green' WHEN {0} <= {2} THEN 'yellow' ELSE 'red' END AS {0}_grade"
PRESSURE = f"{WITH}, readings AS ({_READ}), graded AS (SELECT *, {_GRADE.format('cpu_some', 40, 70)}, {_GRADE.format('memory_some', 10, 30)}, {_GRADE.format('memory_used', 70, 85)}, {_GRADE.format('io_some', 20, 50)} FROM readings), counted AS (SELECT *, len(list_filter([cpu_some_grade, memory_some_grade, memory_used_grade, io_some_grade], lambda g: g = 'red')) AS reds, len(list_filter([cpu_some_grade, memory_some_grade, memory_used_grade, io_some_grade], lambda g: g = 'yellow')) AS yellows FROM graded), acted AS (SELECT *, CASE WHEN reds > 0 THEN 'red' WHEN yellows > 0 THEN 'yellow' ELSE 'green' END AS overall, CASE WHEN reds >= 2 THEN 'shed_aggressive' WHEN reds >= 1 THEN 'shed' WHEN yellows >= 1 THEN 'hold' ELSE 'restore' END AS action FROM counted)"


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_signals(spark, sf_dir)
    readings = s.select("signal_id", "seq", "us", "source", F.col("cpu_percent").alias("cpu_some"), (F.col("seq") % 40).cast("double").alias("memory_some"), (50 + (F.col("seq") % 50)).cast("double").alias("memory_used"), F.least(F.lit(100.0), "latency_ms").alias("io_some"))
    return serving.pressure_grade(readings)


@query("pressure_grade", f"{PRESSURE} SELECT signal_id, overall, action FROM acted")
def pressure_grade(spark, sf_dir):
    return graded(spark, sf_dir).select("signal_id", "overall", "action")


@query("pressure_hysteresis", f"{PRESSURE}, o AS (SELECT source, us, action, row_number() OVER (PARTITION BY source ORDER BY us, seq) AS n FROM acted), walk AS (SELECT source, n, 6 - (action LIKE 'shed%')::INT AS loaded, CASE WHEN action LIKE 'shed%' THEN us END AS sa, CAST(NULL AS BIGINT) AS ra, (action LIKE 'shed%')::INT AS sheds, 0 AS restores FROM o WHERE n = 1 UNION ALL SELECT source, n, loaded - s::INT + r::INT, CASE WHEN s THEN us ELSE sa END, CASE WHEN r THEN us ELSE ra END, sheds + s::INT, restores + r::INT FROM (SELECT w.source, o.n, o.us, loaded, sa, ra, sheds, restores, o.action LIKE 'shed%' AND loaded > 0 AND (sa IS NULL OR o.us - sa >= 30000000) AS s, o.action = 'restore' AND loaded < 6 AND (ra IS NULL OR o.us - ra >= 120000000) AS r FROM walk w JOIN o ON o.source = w.source AND o.n = w.n + 1)) SELECT source, arg_max(loaded, n) AS loaded, arg_max(sheds, n) AS sheds, arg_max(restores, n) AS restores FROM walk GROUP BY source")
def pressure_hysteresis(spark, sf_dir):
    return serving.hysteresis(graded(spark, sf_dir), "source")


@query(
    "fleet_allocate",
    """WITH RECURSIVE m AS (SELECT p_brand AS brand, p_name || '#' || p_partkey AS model, (p_size * 2 * 1.3::DOUBLE / 10) AS gb FROM part),
    o AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY gb DESC, model DESC) AS n FROM m),
    w AS (SELECT brand, 0::BIGINT AS n, 64.0::DOUBLE AS room, '' AS model, 0::BIGINT AS replicas, 0.0::DOUBLE AS total FROM (SELECT DISTINCT brand FROM o)
      UNION ALL SELECT o.brand, o.n, w.room - k * o.gb, o.model, k, k * o.gb FROM w JOIN o ON o.brand = w.brand AND o.n = w.n + 1,
        LATERAL (SELECT CAST(floor(w.room / o.gb) AS BIGINT) AS fits), LATERAL (SELECT least(fits, CASE WHEN o.gb > 5 THEN 1 WHEN o.gb > 1 THEN greatest(2, least(3, greatest(1, fits))) ELSE least(8, greatest(1, fits)) END) AS k))
    SELECT brand, model, CAST(replicas AS INT) AS replicas, round(total, 3) AS total_gb FROM w WHERE replicas > 0""",
)
def fleet_allocate(spark, sf_dir):
    """Parts as models, brands as fleets; memory from size."""
    models = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("brand"), F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("model"), (F.col("p_size") * 2 * 1.3 / 10).alias("memory_gb"))
    return serving.allocate(models, "brand", 64.0)


_W = "SELECT c_custkey AS workload, CAST(abs(c_acctbal) * 100 AS BIGINT) AS daily_volume, CAST(70 + c_custkey % 20 AS DOUBLE) AS routine_pct, CAST(10 AS DOUBLE) AS ambiguous_pct, CAST(20 - c_custkey % 20 AS DOUBLE) AS complex_pct, 150 AS tokens_in, 20 AS tokens_out FROM customer"
SPLIT = f"WITH w AS ({_W.replace('CAST(abs(c_acctbal) * 100 AS BIGINT)', 'CAST(floor(abs(c_acctbal) * 100) AS BIGINT)')}), split AS (SELECT *, CAST(floor(daily_volume * routine_pct / 100) AS BIGINT) AS nano, CAST(floor(daily_volume * ambiguous_pct / 100) AS BIGINT) AS micro FROM w WHERE abs(routine_pct + ambiguous_pct + complex_pct - 100) <= 0.01), tiers AS (SELECT *, daily_volume - nano - micro AS macro FROM split)"
HARDWARE = [("cpu", 12000.0, 700.0, 400.0, 60.0), ("gpu", 30000.0, 1000.0, 5000.0, 1500.0), ("old", 500.0, 300.0, 0.0, 10.0)]


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as workloads."""
    c = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(c.alias("workload"), F.floor(F.abs("c_acctbal") * 100).cast("long").alias("daily_volume"), (70 + c % 20).cast("double").alias("routine_pct"), F.lit(10.0).alias("ambiguous_pct"), (20 - c % 20).cast("double").alias("complex_pct"), F.lit(150).alias("tokens_in"), F.lit(20).alias("tokens_out"))
    return serving.tiers(rows)


@query("tier_split", f"{SPLIT} SELECT workload, nano, micro, macro, round(CASE WHEN daily_volume > 0 THEN nano / daily_volume ELSE 0 END, 6)::DOUBLE AS compression FROM tiers")
def tier_split(spark, sf_dir):
    return split(spark, sf_dir).select("workload", "nano", "micro", "macro", "compression")


@query("tco_onprem", f"{SPLIT}, hw(hardware, unit_cost, watts, micro_tps, macro_tps) AS (VALUES {', '.join(map(str, HARDWARE))}), u AS (SELECT *, CAST(ceil((CASE WHEN micro > 0 THEN ceil(micro * 170 / (micro_tps::DOUBLE * 86400)) ELSE 0 END + CASE WHEN macro > 0 THEN ceil(macro * 170 / (macro_tps::DOUBLE * 86400)) ELSE 0 END) * 1.5::DOUBLE) AS BIGINT) AS units FROM tiers, hw WHERE (micro = 0 OR micro_tps > 0) AND (macro = 0 OR macro_tps > 0)), c AS (SELECT *, units * unit_cost::DOUBLE AS capex, units * watts::DOUBLE * 8760 * 0.12::DOUBLE * 1.4::DOUBLE / 1000 AS power FROM u) SELECT workload, hardware, units, round(capex, 2) AS capex, round(power, 2) AS power, round(capex + 3 * power, 2) AS tco, round((capex + 3 * power) / (daily_volume * 365 * 3), 8) AS per_signal FROM c")
def tco_onprem(spark, sf_dir):
    hardware = spark.createDataFrame(HARDWARE, "hardware string, unit_cost double, watts double, micro_tps double, macro_tps double")
    return serving.owned_cost(split(spark, sf_dir), hardware)


@query("tco_cloud", f"{SPLIT}, a AS (SELECT workload, ((micro + macro) * 150 * 0.0005::DOUBLE / 1000 + (micro + macro) * 20 * 0.0015::DOUBLE / 1000) * 365 AS annual FROM tiers) SELECT workload, round(annual, 2) AS annual, round(annual * 3, 2) AS tco FROM a")
def tco_cloud(spark, sf_dir):
    return serving.rented_cost(split(spark, sf_dir), 0.0005, 0.0015)
