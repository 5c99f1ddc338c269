"""Which workload a stream is, which strategy and model serve it, and what benchmarks say about models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators.folds import fold
from tamis.operators.serving import _choose, rank_models, worst

# Observations before a workload is told, the benchmark that a task is like, latencies by task and lane in
# ms (green, yellow), bytes a parameter takes, tokens a second of a reference accelerator.
MIN_SAMPLES = 20
TASK_SHAPES = {
    "classify_signal": "classify-short", "filter_noise": "classify-short", "summarize_finding": "summarize-long",
    "explain_signal": "summarize-long", "fleet_summary": "summarize-long", "suggest_remediation": "generate-qa",
    "root_cause_analysis": "generate-qa", "deep_root_cause_analysis": "generate-qa",
    "cross_cluster_correlation": "generate-qa", "correlate_findings": "extract-medium",
    "capacity_estimate": "extract-medium", "embed_signal": "encode-text", "embed_document": "encode-document",
    "semantic_search": "similarity-search",
}
TASK_LATENCY = {
    "classify-short": (200, 500), "extract-medium": (2000, 5000), "summarize-long": (3000, 8000), "generate-qa": (5000, 15000),
    "fraud-scoring": (200, 500), "dispute-classification": (200, 500), "claims-triage": (200, 500),
    "ticket-routing": (200, 500), "product-categorization": (200, 500), "clinical-classification": (500, 2000),
    "clinical-summarization": (3000, 8000), "medical-ner": (2000, 5000), "loan-document-extraction": (2000, 5000),
    "compliance-screening": (1000, 5000), "policy-extraction": (2000, 5000), "underwriting-risk": (5000, 15000),
    "review-sentiment": (500, 2000), "demand-classification": (200, 500), "network-anomaly": (500, 2000),
    "churn-prediction": (5000, 15000), "encode-text": (10, 50), "encode-document": (50, 200), "similarity-search": (10, 50),
}
DEFAULT_LATENCY = (500, 2000)
LANE_LATENCY = {"classification": (3000, 5000), "extraction": (4000, 8000), "generation": (5000, 10000), "reasoning": (8000, 20000), "embedding": (10, 50)}
BYTES_PER_PARAMETER = {"bfloat16": 2.0, "int8": 1.0, "Q4_K_M": 0.5625, "Q8_0": 1.0, "i2_s": 0.25}
CACHE_OVERHEAD = 1.3
REFERENCE_TOKENS = {"granite-2b": 800, "qwen-3b": 500, "phi3-mini": 300, "granite-8b": 150}
STRATEGY_FLAGS = ("use_cascade", "use_int8", "use_speculative", "use_batching", "use_cache", "use_ladder")


# ---------------------------------------------------------------- workloads


def glob_pattern(pattern: Column) -> Column:
    """A pattern with * and ? as a regular expression; other characters stand for themselves."""
    quoted = F.regexp_replace(pattern, r"([.\\+^$|(){}\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def namespace_matches(namespaces: DataFrame, patterns: DataFrame) -> DataFrame:
    """workload and matched: whether any namespace fits any of its patterns (workload, pattern). Names are made distinct
    first, patterns are configuration; a workload without patterns isn't listed."""
    names = namespaces.select("namespace").distinct()
    tests = patterns.select("workload", glob_pattern(F.col("pattern")).alias("form"))
    both = tests.join(names, F.expr("namespace rlike form"), "left")
    return both.groupBy("workload").agg(F.max(F.col("namespace").isNotNull()).alias("matched"))


def best_workload(similarities: DataFrame, matches: DataFrame, seen: int) -> DataFrame:
    """One row: workload, industry, confidence, matched of the likeliest of similarities (workload, industry, similarity),
    in the order of names where equal. A match of namespaces gives 0.1 more, 1 at most; before MIN_SAMPLES observations,
    and without any likeness, it is generic."""
    boosted = similarities.join(matches, "workload", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    likeness = F.least(F.lit(1.0), F.col("similarity") + F.when(F.col("matched"), 0.1).otherwise(0.0))
    ranked = boosted.withColumn("confidence", F.round(likeness, 4)).where("confidence > 0")
    least = F.min_by(F.struct("workload", "industry", "confidence", "matched"), F.struct(-F.col("confidence"), F.col("workload")))
    found = ranked.agg(least.alias("b")).select("b.*")
    known = F.col("workload").isNotNull() & F.lit(seen >= MIN_SAMPLES)
    return found.select(
        F.when(known, F.col("workload")).otherwise("generic").alias("workload"),
        F.when(known, F.col("industry")).otherwise("basic").alias("industry"),
        F.when(known, F.col("confidence")).otherwise(0.0).alias("confidence"),
        F.when(known, F.col("matched")).otherwise(F.lit(False)).alias("matched"),
    )


def reclassification_interval(confidence: Column) -> Column:
    """Observations until a workload is told anew: the surer, the more."""
    return F.when(confidence >= 0.9, 20).when(confidence >= 0.5, 5).otherwise(2)


def scorecard(workloads: DataFrame) -> DataFrame:
    """workloads (confidence, matched) with grades of confidence, pace and namespaces, and the worst of them."""
    confidence = F.col("confidence")
    grades = {
        "confidence_grade": F.when(confidence >= 0.8, "green").when(confidence >= 0.5, "yellow").otherwise("red"),
        "reclassification_speed_grade": F.when(reclassification_interval(confidence) <= 5, "green").otherwise("yellow"),
        "namespace_match_grade": F.when(F.col("matched"), "green").otherwise("red"),
    }
    return workloads.withColumns(grades).withColumn("overall_grade", worst(*map(F.col, grades)))


def adaptive_cadence(observations: DataFrame, stream: str, least: int = MIN_SAMPLES) -> DataFrame:
    """observations (stream, seq, confidence that telling the workload now would give) with n, their number in their stream,
    and reclassified: whether the workload is told there. The interval follows from the confidence told last."""

    def step(state: tuple[int, float], row: dict) -> tuple[tuple[int, float], tuple]:
        n, sure = state[0] + 1, state[1]
        every = 20 if sure >= 0.9 else 5 if sure >= 0.5 else 2
        told = n >= least and n % every == 0
        return (n, (row["confidence"] or 0.0) if told else sure), (n, told)

    rows = observations.select(stream, "seq", F.col("confidence").cast("double").alias("confidence"))
    return fold(rows, stream, ["seq"], lambda: (0, 0.0), step, "n long, reclassified boolean")


# ---------------------------------------------------------------- strategies and tasks


def resolve_strategy(workloads: DataFrame, strategies: DataFrame) -> DataFrame:
    """workloads (workload) with the strategy of that name, else the generic one, else one without optimizations and with
    red grades. strategies: workload, grades and flags."""
    named = strategies.select(F.col("workload").alias("_w"), F.struct(*(c for c in strategies.columns)).alias("_s"))
    generic = named.where("_w = 'generic'").select(F.col("_s").alias("_g"))
    both = workloads.join(named, F.col("workload") == F.col("_w"), "left").join(generic, F.lit(True), "left")
    chosen = F.coalesce("_s", "_g")
    grades = [c for c in strategies.columns if c.endswith("_grade")]
    flags = [c for c in STRATEGY_FLAGS if c in strategies.columns]
    kept = [F.coalesce(chosen[c], F.lit("red")).alias(c) for c in grades]
    kept += [F.coalesce(chosen[c], F.lit(False)).alias(c) for c in flags]
    return both.select(*workloads.columns, F.coalesce(chosen["workload"], F.lit("generic")).alias("strategy"), *kept)


def resolve_task(requests: DataFrame, overrides: DataFrame) -> DataFrame:
    """requests (industry, task_type) with benchmark: the industry's own (overrides: industry, task_type, benchmark), else
    that of the task's shape, else a short classification."""
    own = overrides.select("industry", "task_type", F.col("benchmark").alias("_own"))
    shape = _choose(F.col("task_type"), TASK_SHAPES, "classify-short")
    return requests.join(own, ["industry", "task_type"], "left").withColumn("benchmark", F.coalesce("_own", shape)).drop("_own")


def task_latency_grade(task: Column, p95_ms: Column) -> Column:
    green = _choose(task, {t: x[0] for t, x in TASK_LATENCY.items()}, DEFAULT_LATENCY[0])
    yellow = _choose(task, {t: x[1] for t, x in TASK_LATENCY.items()}, DEFAULT_LATENCY[1])
    return F.when(p95_ms <= green, "green").when(p95_ms <= yellow, "yellow").otherwise("red")


def memory_gb(params_billions: Column, dtype: Column) -> Column:
    """What a model takes: parameters by their width, and a third for caches."""
    return params_billions * _choose(dtype, BYTES_PER_PARAMETER, 2.0) * CACHE_OVERHEAD


# ---------------------------------------------------------------- benchmarks


def compile_corpora(entries: DataFrame, roster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(models, gaps) of benchmark entries (industry, task, model, quality, quality_value, latency, varies, speed) of the
    models in roster (model, params). models: those that pass the quality gate, ranked within industry, task and tier;
    gaps: tiers that were tested but of which none passes, with the best quality."""
    known = entries.join(roster.select("model", "params"), "model")
    tiered = known.withColumn("tier", F.when(F.col("params") <= 3.0, "micro").otherwise("macro"))
    by = ["industry", "task", "tier"]
    ranked = rank_models(tiered.where("quality <> 'red'"), *by).where("role <> 'none'")
    tested = tiered.groupBy(*by).agg(F.count("*").alias("models_tested"), F.round(F.max("quality_value"), 3).alias("best_quality"))
    # every tier of a task counts, tested or not
    every = tiered.select("industry", "task").distinct().withColumn("tier", F.explode(F.array(F.lit("micro"), F.lit("macro"))))
    gaps = every.join(ranked.select(*by).distinct(), by, "left_anti").join(tested, by, "left")
    return ranked, gaps.fillna({"models_tested": 0, "best_quality": 0.0})


def hardware_profile(entries: DataFrame) -> DataFrame:
    """Of entries (model, task, speed, quality_value, speed_grade, quality_grade): for each model and task the medians and
    best grades. Speeds of 0 weren't measured."""
    level = lambda c, test=F.lit(True): F.min(F.when(test, _choose(F.col(c), {"green": 0, "yellow": 1}, 2)))
    name = lambda c: F.when(F.col(c) == 0, "green").when(F.col(c) == 1, "yellow").otherwise("red")
    measured = F.col("speed") > 0
    made = entries.groupBy("model", "task").agg(
        F.round(F.coalesce(F.median(F.when(measured, F.col("speed"))), F.lit(0.0)), 1).alias("tokens_per_second"),
        F.round(F.median("quality_value"), 3).alias("accuracy"),
        level("speed_grade", measured).alias("_s"),
        level("quality_grade").alias("_q"),
    )
    return made.withColumns({"speed_grade": name("_s"), "quality_grade": name("_q")}).drop("_s", "_q")


def against_reference(entries: DataFrame) -> DataFrame:
    """entries (model, speed) of models that a reference accelerator was measured with, with its speed and the ratio."""
    short = F.replace("model", F.lit("-cpu"), F.lit(""))
    for long, name in (("granite-3-2-8b-instruct", "granite-8b"), ("qwen25-3b", "qwen-3b")):
        short = F.replace(short, F.lit(long), F.lit(name))
    rows = list(REFERENCE_TOKENS.items())
    reference = entries.sparkSession.createDataFrame(rows, "_short string, reference_speed int")
    both = entries.withColumn("_short", short).join(reference, "_short").where("speed > 0").drop("_short")
    return both.withColumn("ratio", F.round(F.col("reference_speed") / F.col("speed"), 2))


def simulation_summary(samples: DataFrame) -> DataFrame:
    """Of samples (vertical, lane, model, ok, latency_ms, speed, valid): for each of the first three the means of the
    samples that succeeded, the latency that 95 of 100 stay within (by place, not interpolated), failures, the share that
    keeps to the standard, and a grade by the lane's targets."""
    by = ["vertical", "lane", "model"]
    good = F.coalesce("ok", F.lit(False))
    means = samples.groupBy(*by).agg(
        F.count_if(good).alias("ok"),
        F.count_if(~good).alias("errors"),
        F.avg(F.when(good, F.col("latency_ms"))).alias("_ms"),
        F.avg(F.when(good, F.col("speed"))).alias("_speed"),
        (F.count_if(good & F.coalesce("valid", F.lit(False))) * 100 / F.greatest(F.count_if(good), F.lit(1))).alias("_valid"),
    )
    # by place: counts of equal latencies, summed upwards, so that a group's samples needn't be gathered
    counts = samples.where(good).groupBy(*by, "latency_ms").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto).join(means.select(*by, F.col("ok").alias("_n")), by)
    place = F.when(F.col("_n") > 1, F.floor(F.col("_n") * 0.95)).otherwise(0)
    high = placed.where(F.col("upto") > place).groupBy(*by).agg(F.min("latency_ms").alias("p95_ms"))
    both = means.join(high, by, "left")
    lane = lambda k: _choose(F.col("lane"), {n: x[k] for n, x in LANE_LATENCY.items()}, DEFAULT_LATENCY[k])
    ms = F.coalesce("_ms", F.lit(0.0))
    grade = F.when(ms <= lane(0), "GREEN").when(ms <= lane(1), "YELLOW").otherwise("RED")
    return both.select(
        *by, "ok", "errors", F.round(ms, 3).alias("avg_ms"), F.coalesce(F.col("p95_ms").cast("double"), F.lit(0.0)).alias("p95_ms"),
        F.round(F.coalesce("_speed", F.lit(0.0)), 3).alias("tok_s"), F.round("_valid", 3).alias("standard_pct"), grade.alias("grade"),
    )


# ---------------------------------------------------------------- answers


# What templates name the text.
PLACEHOLDERS = ("document", "transaction", "dispute", "transaction_details", "application", "claim", "policy_text", "product", "review", "signal", "ticket", "log_excerpt", "customer_profile")


def filled_prompt(template: Column, text: Column) -> Column:
    """A template with every placeholder replaced by the text, one after the other."""
    for name in PLACEHOLDERS:
        template = F.replace(template, F.lit(f"{{{name}}}"), text)
    return template


def answer_quality(answer: Column, check: Column, target: Column) -> Column:
    """Whether an answer is correct by its task's check: a text in it, a key of its JSON object, its length."""
    low = F.lower(F.trim(answer))
    within = F.when(F.contains(low, F.lower(target)), "correct").otherwise("incorrect")
    words = F.size(F.regexp_extract_all(answer, F.lit(r"(\S+)"), F.lit(1)))
    keys = F.json_object_keys(answer)
    parsed = F.try_parse_json(answer)
    structured = F.when(keys.isNotNull(), F.when(F.array_contains(keys, target), "correct").otherwise("incorrect")).when(parsed.isNotNull(), "incorrect").otherwise(within)
    return (
        F.when(check == "length_and_content", F.when((words > 10) & (words < 200), "correct").otherwise("incorrect"))
        .when((check == "none") | target.isNull(), "unknown")
        .when(check.isin("exact_match", "substring"), within)
        .when(check == "structured_json", structured)
        .otherwise("unknown")
    )


# ---------------------------------------------------------------- scaling


def shed_and_restore(graded: DataFrame, by: str, roster: list[tuple[str, float, float]], shed_us: int = 30_000_000, restore_us: int = 120_000_000) -> DataFrame:
    """graded (by, us, seq, action) with did (which model goes or comes back, or why none does), and the memory and cores
    that are left of what the roster (model, memory, cores) takes. The largest loaded model goes first, the last that went
    comes back first; neither sooner than the given time after the last such step."""
    size = {m: (gb, cores) for m, gb, cores in roster}
    largest = sorted(size, key=lambda m: (-size[m][0], m))

    def start() -> tuple:
        return list(largest), [], None, None

    def step(state: tuple, row: dict) -> tuple[tuple, tuple]:
        loaded, gone, shed_at, back_at = state
        us, action, did = row["us"], row["action"] or "", "hold"
        if action == "restore":
            did = "restore:hysteresis"
            if back_at is None or us - back_at >= restore_us:
                did = "restore:noop"
                if gone:
                    loaded, gone, back_at = [*loaded, gone[-1]], gone[:-1], us
                    did = f"restored:{loaded[-1]}"
        elif action.startswith("shed"):
            did = "shed:hysteresis"
            if shed_at is None or us - shed_at >= shed_us:
                did = "shed:noop"
                model = next((m for m in largest if m in loaded), None)
                if model is not None:
                    loaded, gone, shed_at = [m for m in loaded if m != model], [*gone, model], us
                    did = f"evicted:{model}"
        free = [sum(size[m][k] for m in gone) for k in (0, 1)]
        return (loaded, gone, shed_at, back_at), (did, len(loaded), float(free[0]), float(free[1]))

    rows = graded.select(by, "us", "seq", "action")
    return fold(rows, by, ["us", "seq"], start, step, "did string, loaded int, freed_gb double, freed_cores double")
