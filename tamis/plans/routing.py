"""Queries over workloads, strategies, compiled benchmarks and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators import routing, serving
from tamis.plans.domains import RECORDS, _pick, _records
from tamis.plans.registry import query
from tamis.plans.serving import FINGERPRINT, PROFILES
from tamis.sources.adapters import SIGNALS_SQL, event_signals

HOUR = 3_600_000_000


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x) for x in r) + ")" for r in rows)


def _case(column: str, values: dict, otherwise) -> str:
    show = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {show(v)}" for k, v in values.items()) + f" ELSE {show(otherwise)} END"


# ---------------------------------------------------------------- workloads

INDUSTRIES = [("platform", "basic"), ("payments", "finance"), ("quiet", "basic")]
PATTERNS = [("platform", "ns_[0-9]*"), ("platform", "kube-*"), ("payments", "ns_?"), ("quiet", "none.*")]


@query(
    "workload_told",
    f"{FINGERPRINT}, profiles(workload, dim, key, p) AS (VALUES {_values(PROFILES)}), q AS (SELECT sum(weight * weight) AS q FROM print),"
    " sims AS (SELECT workload, round(coalesce(sum(p * coalesce(weight, 0)) / sqrt(sum(p * p) * any_value(q)), 0), 4) AS s FROM profiles LEFT JOIN print USING (dim, key), q GROUP BY workload),"
    f" ind(workload, industry) AS (VALUES {_values(INDUSTRIES)}), hit AS (SELECT 'payments' AS workload, true AS m),"
    " told AS (SELECT workload, industry, round(least(1, s + CASE WHEN m THEN 0.1 ELSE 0 END), 4) AS confidence, coalesce(m, false) AS matched FROM sims JOIN ind USING (workload) LEFT JOIN hit USING (workload))"
    " SELECT workload, industry, confidence, matched FROM told WHERE confidence > 0 ORDER BY confidence DESC, workload LIMIT 1",
)
def workload_told(spark, sf_dir):
    """The likeliest workload; namespaces that fit its patterns speak for it. Brackets in a pattern stand for themselves."""
    signals = event_signals(spark, sf_dir)
    profiles = spark.createDataFrame(PROFILES, "workload string, dim string, key string, weight double")
    none = spark.createDataFrame([], "workload string")
    likeness = serving.classify_workload(serving.fingerprint(signals, ["signal_type", "severity"]), profiles, none)
    likeness = likeness.join(spark.createDataFrame(INDUSTRIES, "workload string, industry string"), "workload")
    patterns = spark.createDataFrame(PATTERNS, "workload string, pattern string")
    return routing.best_workload(likeness, routing.namespace_matches(signals, patterns), signals.limit(routing.MIN_SAMPLES).count())


_STATE = {"confidence": "CAST(k % 100 AS DOUBLE) / 100", "matched": "user_id % 3 = 0"}
_STATES_SQL = f"{RECORDS}, m AS (SELECT event_id, " + ", ".join(f"{v} AS {n}" for n, v in _STATE.items()) + " FROM r)"


@query(
    "bootstrap_scorecard",
    _STATES_SQL
    + """, g AS (SELECT event_id, CASE WHEN confidence >= 0.8 THEN 'green' WHEN confidence >= 0.5 THEN 'yellow' ELSE 'red' END AS confidence_grade,
    CASE WHEN confidence >= 0.9 THEN 'yellow' ELSE 'green' END AS reclassification_speed_grade, CASE WHEN matched THEN 'green' ELSE 'red' END AS namespace_match_grade FROM m)
    SELECT *, CASE WHEN 'red' IN (confidence_grade, namespace_match_grade) THEN 'red' WHEN 'yellow' IN (confidence_grade, reclassification_speed_grade) THEN 'yellow' ELSE 'green' END AS overall_grade FROM g""",
)
def bootstrap_scorecard(spark, sf_dir):
    rows = _records(spark, sf_dir).selectExpr("event_id", *(f"{v} AS {n}" for n, v in _STATE.items()))
    return routing.scorecard(rows).drop("confidence", "matched")


@query(
    "adaptive_cadence",
    f"""WITH RECURSIVE r0 AS (SELECT event_id AS seq, user_id % 20 AS stream, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100 AS confidence FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seq) AS n FROM r0),
    w AS (SELECT stream, seq, n, false AS reclassified, 0.0::DOUBLE AS sure FROM o WHERE n = 1
      UNION ALL SELECT o.stream, o.seq, o.n, t, CASE WHEN t THEN o.confidence ELSE w.sure END FROM w JOIN o ON o.stream = w.stream AND o.n = w.n + 1,
        LATERAL (SELECT o.n >= {routing.MIN_SAMPLES} AND o.n % (CASE WHEN w.sure >= 0.9 THEN 20 WHEN w.sure >= 0.5 THEN 5 ELSE 2 END) = 0 AS t))
    SELECT stream, seq, n, reclassified FROM w""",
)
def adaptive_cadence(spark, sf_dir):
    rows = _records(spark, sf_dir).selectExpr("event_id AS seq", "user_id % 20 AS stream", "k / 100 AS confidence")
    return routing.adaptive_cadence(rows, "stream").select("stream", "seq", "n", "reclassified")


STRATEGIES = [("ECONOMY", "green", "yellow", True, False), ("PROMO", "yellow", "red", False, True), ("generic", "red", "red", False, False)]


@query(
    "strategy_resolve",
    f"WITH s(workload, throughput_grade, quality_grade, use_cascade, use_int8) AS (VALUES {_values(STRATEGIES)}), w AS (SELECT DISTINCT p_type AS workload FROM part)"
    " SELECT w.workload, coalesce(s.workload, 'generic') AS strategy, coalesce(s.throughput_grade, 'red') AS throughput_grade, coalesce(s.quality_grade, 'red') AS quality_grade, coalesce(s.use_cascade, false) AS use_cascade, coalesce(s.use_int8, false) AS use_int8 FROM w LEFT JOIN s USING (workload)",
)
def strategy_resolve(spark, sf_dir):
    strategies = spark.createDataFrame(STRATEGIES, "workload string, throughput_grade string, quality_grade string, use_cascade boolean, use_int8 boolean")
    workloads = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("workload")).distinct()
    return routing.resolve_strategy(workloads, strategies)


OVERRIDES = [("s0", "classify_signal", "ticket-routing"), ("s1", "correlate_findings", "medical-ner")]
_TASK = _pick("k", "classify_signal", "correlate_findings", "embed_signal", "root_cause_analysis", "unknown_task")


@query(
    "task_resolve",
    f"{RECORDS}, o(industry, task_type, own) AS (VALUES {_values(OVERRIDES)}), q AS (SELECT event_id, 's' || (user_id % 3) AS industry, {_TASK} AS task_type, value * 20 AS p95 FROM r),"
    f" b AS (SELECT event_id, coalesce(own, {_case('task_type', routing.TASK_SHAPES, 'classify-short')}) AS benchmark, p95 FROM q LEFT JOIN o USING (industry, task_type))"
    f" SELECT event_id, benchmark, CASE WHEN p95 <= {_case('benchmark', {t: x[0] for t, x in routing.TASK_LATENCY.items()}, 500)} THEN 'green' WHEN p95 <= {_case('benchmark', {t: x[1] for t, x in routing.TASK_LATENCY.items()}, 2000)} THEN 'yellow' ELSE 'red' END AS grade FROM b",
)
def task_resolve(spark, sf_dir):
    """The benchmark that stands for a task, and the grade of a latency by it."""
    overrides = spark.createDataFrame(OVERRIDES, "industry string, task_type string, benchmark string")
    rows = _records(spark, sf_dir).selectExpr("event_id", "concat('s', CAST(user_id % 3 AS STRING)) AS industry", f"{_TASK} AS task_type", "value * 20 AS p95")
    found = routing.resolve_task(rows, overrides)
    return found.select("event_id", "benchmark", routing.task_latency_grade(F.col("benchmark"), F.col("p95")).alias("grade"))


_DTYPE = _pick("p_partkey", "bfloat16", "int8", "Q4_K_M", "Q8_0", "i2_s", "other")


@query("model_footprint", f"SELECT p_partkey, round((p_size * {_case('dtype', routing.BYTES_PER_PARAMETER, 2.0)} * 1.3)::DOUBLE, 6) AS memory_gb FROM (SELECT *, {_DTYPE} AS dtype FROM part)")
def model_footprint(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("dtype", F.expr(_DTYPE))
    return rows.select("p_partkey", F.round(routing.memory_gb(F.col("p_size").cast("double"), F.col("dtype")), 6).alias("memory_gb"))


# ---------------------------------------------------------------- benchmarks

_ENTRIES = """SELECT p_type AS industry, p_brand AS task, p_name || '#' || p_partkey % 97 AS model, CASE WHEN p_size % 10 < 6 THEN 'red' WHEN p_size % 10 < 8 THEN 'yellow' ELSE 'green' END AS quality, p_size / 50 AS quality_value,
CASE WHEN p_partkey % 2 = 0 THEN 'green' ELSE 'red' END AS latency, p_partkey % 5 = 0 AS varies, p_retailprice AS speed, p_partkey FROM part"""
_ROSTER = "SELECT p_name || '#' || p_partkey % 97 AS model, CAST(min(p_size) AS DOUBLE) / 8 AS params FROM part WHERE p_partkey % 7 <> 0 GROUP BY 1"
_TIERED = f"WITH e AS ({_ENTRIES}), ro AS ({_ROSTER}), t AS (SELECT e.*, params, CASE WHEN params <= 3.0 THEN 'micro' ELSE 'macro' END AS tier FROM e JOIN ro USING (model))"


def _compiled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    part.createOrReplaceTempView("part")
    return routing.compile_corpora(spark.sql(_ENTRIES), spark.sql(_ROSTER))


@query(
    "corpora_models",
    _TIERED
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY industry, task, tier ORDER BY CASE quality WHEN 'green' THEN 0 WHEN 'yellow' THEN 1 ELSE 2 END, CASE latency WHEN 'green' THEN 0 ELSE 2 END, varies::INT, speed DESC, params, model) AS rank FROM t WHERE quality <> 'red')
    SELECT industry, task, tier, CAST(rank AS INT) AS rank, speed, CASE WHEN rank = 1 THEN 'primary' WHEN rank = 2 THEN 'fallback' ELSE 'alternative' END AS role FROM k WHERE rank <= 5""",
)
def corpora_models(spark, sf_dir):
    return _compiled(spark, sf_dir)[0].select("industry", "task", "tier", "rank", "speed", "role")


@query(
    "corpora_gaps",
    _TIERED
    + """, every AS (SELECT DISTINCT industry, task, u.tier FROM t, (VALUES ('micro'), ('macro')) AS u(tier)), s AS (SELECT industry, task, tier, count(*) AS models_tested, round(max(quality_value), 3) AS best_quality, count_if(quality <> 'red') AS passed FROM t GROUP BY ALL)
    SELECT industry, task, tier, coalesce(models_tested, 0) AS models_tested, coalesce(best_quality, 0.0) AS best_quality FROM every LEFT JOIN s USING (industry, task, tier) WHERE coalesce(passed, 0) = 0""",
)
def corpora_gaps(spark, sf_dir):
    """Tasks of a tier that no model is good enough for."""
    return _compiled(spark, sf_dir)[1]


_RUNS = {"model": _pick("user_id", "granite-2b-cpu", "qwen25-3b-cpu", "granite-3-2-8b-instruct", "phi3-mini", "other"), "task": _pick("k", "classify-short", "extract-medium", "generate-qa"), "speed": "CASE WHEN k % 10 = 0 THEN 0.0 ELSE value END", "quality_value": "CAST(k AS DOUBLE) / 100"}
_RUN_GRADES = {"speed_grade": "CASE WHEN value > 150 THEN 'green' WHEN value > 60 THEN 'yellow' ELSE 'red' END", "quality_grade": "CASE WHEN k > 97 THEN 'green' WHEN k > 90 THEN 'yellow' ELSE 'red' END"}
_RUNS_SQL = f"{RECORDS}, m AS (SELECT event_id, " + ", ".join(f"{v} AS {n}" for n, v in {**_RUNS, **_RUN_GRADES}.items()) + " FROM r)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).selectExpr("event_id", *(f"{v} AS {n}" for n, v in {**_RUNS, **_RUN_GRADES}.items()))


_BEST = "CASE min(CASE {0} WHEN 'green' THEN 0 WHEN 'yellow' THEN 1 ELSE 2 END){1} WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' ELSE 'red' END"


@query(
    "hardware_profile",
    f"{_RUNS_SQL} SELECT model, task, round(coalesce(quantile_cont(speed, 0.5) FILTER (speed > 0), 0), 1) AS tokens_per_second, round(quantile_cont(quality_value, 0.5), 3) AS accuracy, {_BEST.format('speed_grade', ' FILTER (speed > 0)')} AS speed_grade, {_BEST.format('quality_grade', '')} AS quality_grade FROM m GROUP BY model, task",
)
def hardware_profile(spark, sf_dir):
    return routing.hardware_profile(_runs(spark, sf_dir))


@query(
    "reference_ratio",
    f"{_RUNS_SQL}, s AS (SELECT *, replace(replace(replace(model, '-cpu', ''), 'granite-3-2-8b-instruct', 'granite-8b'), 'qwen25-3b', 'qwen-3b') AS short FROM m), ref(short, reference_speed) AS (VALUES {_values(list(routing.REFERENCE_TOKENS.items()))})"
    " SELECT event_id, model, CAST(reference_speed AS INT) AS reference_speed, round(reference_speed / speed, 2) AS ratio FROM s JOIN ref USING (short) WHERE speed > 0",
)
def reference_ratio(spark, sf_dir):
    return routing.against_reference(_runs(spark, sf_dir)).select("event_id", "model", "reference_speed", "ratio")


_SIM = {"vertical": _pick("user_id", "retail", "telecom"), "lane": _pick("k", "classification", "extraction", "generation", "reasoning", "embedding", "other"), "model": _pick("event_id", "a", "b"), "ok": "k % 7 <> 0", "latency_ms": "CAST(floor(value) * 40 AS INT)", "speed": "value / 3", "valid": "user_id % 4 <> 0"}
_LANES = routing.LANE_LATENCY


@query(
    "simulation_summary",
    f"{RECORDS}, m AS (SELECT " + ", ".join(f"{v} AS {n}" for n, v in _SIM.items()) + """ FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY vertical, lane, model ORDER BY latency_ms) - 1 AS p, count(*) OVER (PARTITION BY vertical, lane, model) AS n FROM m WHERE ok),
    p AS (SELECT vertical, lane, model, max(latency_ms) AS p95 FROM o WHERE p = CASE WHEN n > 1 THEN floor(n * 0.95) ELSE 0 END GROUP BY ALL),
    s AS (SELECT vertical, lane, model, count_if(ok) AS ok, count_if(NOT ok) AS errors, coalesce(avg(latency_ms) FILTER (ok), 0) AS ms, coalesce(avg(speed) FILTER (ok), 0) AS tok, count_if(ok AND valid) * 100 / greatest(count_if(ok), 1) AS pct FROM m GROUP BY vertical, lane, model)
    """ + f"SELECT vertical, lane, model, ok::BIGINT AS ok, errors::BIGINT AS errors, round(ms, 3) AS avg_ms, coalesce(p95, 0)::DOUBLE AS p95_ms, round(tok, 3) AS tok_s, round(pct, 3) AS standard_pct, CASE WHEN ms <= {_case('lane', {n: x[0] for n, x in _LANES.items()}, 500)} THEN 'GREEN' WHEN ms <= {_case('lane', {n: x[1] for n, x in _LANES.items()}, 2000)} THEN 'YELLOW' ELSE 'RED' END AS grade FROM s LEFT JOIN p USING (vertical, lane, model)",
)
def simulation_summary(spark, sf_dir):
    return routing.simulation_summary(_records(spark, sf_dir).selectExpr(*(f"{v} AS {n}" for n, v in _SIM.items())))


_TEMPLATE = "Read {document} and {ticket}, keep {this}."


_FILLED = f"'{_TEMPLATE}'"
for _name in routing.PLACEHOLDERS:
    _FILLED = f"replace({_FILLED}, '{{{_name}}}', text)"


@query("prompts_filled", f"SELECT conv_id, turn, {_FILLED} AS prompt FROM conversations WHERE text IS NOT NULL")
def prompts_filled(spark, sf_dir):
    """Every text that there is in a template; what a text itself has in braces is filled as well where it is a placeholder."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null")
    return rows.select("conv_id", "turn", routing.filled_prompt(F.lit(_TEMPLATE), F.col("text")).alias("prompt"))


_CHECK = {"answer": _pick("user_id", '{"label": "POSITIVE"}', "it is Positive", '["label"]', "no idea at all", "1"), "chk": _pick("k", "exact_match", "substring", "structured_json", "none", "length_and_content", "odd", "structured_json"), "target": _pick("event_id", "label", "positive", "positive", None)}
_CHECK_SQL = f"{RECORDS}, m AS (SELECT event_id, " + ", ".join(f"{v} AS {n}" for n, v in _CHECK.items()) + " FROM r), w AS (SELECT *, contains(lower(trim(answer)), lower(target)) AS has, len(regexp_extract_all(answer, '\\S+')) AS words FROM m)"


@query(
    "answer_checks",
    _CHECK_SQL
    + """ SELECT event_id, CASE WHEN chk = 'length_and_content' THEN CASE WHEN words > 10 AND words < 200 THEN 'correct' ELSE 'incorrect' END WHEN chk = 'none' OR target IS NULL THEN 'unknown' WHEN chk IN ('exact_match', 'substring') THEN CASE WHEN has THEN 'correct' ELSE 'incorrect' END
    WHEN chk = 'structured_json' THEN CASE WHEN answer = '{"label": "POSITIVE"}' THEN CASE WHEN target = 'label' THEN 'correct' ELSE 'incorrect' END WHEN answer IN ('["label"]', '1') THEN 'incorrect' WHEN has THEN 'correct' ELSE 'incorrect' END ELSE 'unknown' END AS quality FROM w""",
)
def answer_checks(spark, sf_dir):
    rows = _records(spark, sf_dir).selectExpr("event_id", *(f"{v} AS {n}" for n, v in _CHECK.items()))
    return rows.select("event_id", routing.answer_quality(F.col("answer"), F.col("chk"), F.col("target")).alias("quality"))


ROSTER = [("large", 16.0, 8.0), ("middle", 6.0, 4.0), ("small", 1.5, 2.0)]
_ACTION = _pick("k", "shed", "restore", "hold", "shed_aggressive", "restore")


@query(
    "shed_restore",
    f"""WITH RECURSIVE {SIGNALS_SQL}, a AS (SELECT seq, us, CAST(substr(source, 6) AS BIGINT) % 50 AS machine, {_ACTION.replace('k %', 'CAST(cpu_percent AS INT) %')} AS action FROM signals),
    o AS (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY us, seq) AS n FROM a),
    w AS (SELECT machine, 0::BIGINT AS seq, 0::BIGINT AS n, []::VARCHAR[] AS gone, NULL::BIGINT AS shed_at, NULL::BIGINT AS back_at, '' AS did FROM (SELECT DISTINCT machine FROM o)
      UNION ALL SELECT o.machine, o.seq, o.n, CASE WHEN d LIKE 'evicted:%' THEN list_append(w.gone, substr(d, 9)) WHEN d LIKE 'restored:%' THEN w.gone[:-2] ELSE w.gone END,
        CASE WHEN d LIKE 'evicted:%' THEN o.us ELSE w.shed_at END, CASE WHEN d LIKE 'restored:%' THEN o.us ELSE w.back_at END, d
      FROM w JOIN o ON o.machine = w.machine AND o.n = w.n + 1, LATERAL (SELECT CASE
        WHEN o.action = 'restore' THEN CASE WHEN w.back_at IS NOT NULL AND o.us - w.back_at < {4 * HOUR} THEN 'restore:hysteresis' WHEN len(w.gone) = 0 THEN 'restore:noop' ELSE 'restored:' || w.gone[-1] END
        WHEN o.action LIKE 'shed%' THEN CASE WHEN w.shed_at IS NOT NULL AND o.us - w.shed_at < {HOUR} THEN 'shed:hysteresis' WHEN NOT list_contains(w.gone, 'large') THEN 'evicted:large' WHEN NOT list_contains(w.gone, 'middle') THEN 'evicted:middle' WHEN NOT list_contains(w.gone, 'small') THEN 'evicted:small' ELSE 'shed:noop' END
        ELSE 'hold' END AS d))
    SELECT machine, seq, did, CAST(3 - len(gone) AS INT) AS loaded, (CASE WHEN list_contains(gone, 'large') THEN 16.0 ELSE 0 END + CASE WHEN list_contains(gone, 'middle') THEN 6.0 ELSE 0 END + CASE WHEN list_contains(gone, 'small') THEN 1.5 ELSE 0 END)::DOUBLE AS freed_gb FROM w WHERE n > 0""",
)
def shed_restore(spark, sf_dir):
    """Which model each machine sheds or gets back after each of its readings."""
    signals = event_signals(spark, sf_dir).withColumn("k", F.col("cpu_percent").cast("int"))
    rows = signals.select("seq", "us", (F.substring("source", 6, 20).cast("long") % 50).alias("machine"), F.expr(_ACTION).alias("action"))
    made = routing.shed_and_restore(rows, "machine", ROSTER, HOUR, 4 * HOUR)
    return made.select("machine", "seq", "did", "loaded", "freed_gb")
