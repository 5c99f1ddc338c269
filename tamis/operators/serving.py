"""Where survivors go and what that costs: lanes, models, fingerprints, benchmarks, pressure, capacity, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators.folds import fold
from tamis.operators.places import values_at

# Lanes of task types, models and answer lengths of lanes.
LANES = {
    "classification": ("classify-short", "fraud-scoring", "dispute-classification", "claims-triage", "ticket-routing", "product-categorization", "demand-classification", "clinical-classification"),
    "extraction": ("extract-medium", "loan-document-extraction", "policy-extraction", "medical-ner", "review-sentiment", "network-anomaly"),
    "generation": ("summarize-long", "clinical-summarization", "compliance-screening"),
    "reasoning": ("generate-qa", "underwriting-risk", "churn-prediction"),
    "embedding": ("encode-text", "encode-document", "similarity-search"),
}
LANE_MODELS = {
    "classification": ("gemma3-4b", "phi4-mini", "llama32-1b"),
    "extraction": ("phi4-mini", "gemma3-4b", "mistral-7b"),
    "generation": ("phi4-mini", "gemma3-4b", "mistral-7b"),
    "reasoning": ("phi4-mini", "mistral-7b", "gemma3-4b"),
    "embedding": ("nomic-embed-text", "all-minilm-l6-v2", "bge-small-en"),
}
LANE_TOKENS = {"classification": 10, "extraction": 200, "generation": 300, "reasoning": 500, "embedding": 0}
GRADES = ("green", "yellow", "red")


def _choose(column: Column, values: dict, otherwise) -> Column:
    found = F
    for key, value in values.items():
        found = found.when(column == key, F.lit(value))
    return found.otherwise(F.lit(otherwise))


def lane(task: Column) -> Column:
    return _choose(task, {t: name for name, tasks in LANES.items() for t in tasks}, "classification")


def route(requests: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """requests (seq, task_type, severity, slice) with tier, lane, model and max_tokens. Models of a lane take turns, in order
    of seq: places are counted within slices and over the slices' sums, so no lane is put into one task."""
    made = requests.withColumn("lane", lane(F.col("task_type"))).withColumn("tier", F.when(F.col("severity").isin("critical", "high"), "macro").otherwise("micro")).withColumn("max_tokens", _choose(F.col("lane"), LANE_TOKENS, 100))
    counts = made.groupBy("lane", "slice").agg(F.count("*").alias("_n"))
    before = counts.select("lane", "slice", F.coalesce(F.sum("_n").over(Window.partitionBy("lane").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = made.withColumn("_r", F.row_number().over(Window.partitionBy("lane", "slice").orderBy("seq"))).join(before, ["lane", "slice"])
    models = F
    for name, candidates in LANE_MODELS.items():
        left = [m for m in candidates if m not in excluded]
        models = models.when(F.col("lane") == name, F.array(*map(F.lit, left)).cast("array<string>"))
    models = models.otherwise(F.array().cast("array<string>"))
    turn = (F.col("_before") + F.col("_r") - 1) % F.greatest(F.size("_models"), F.lit(1)) + 1
    named = placed.withColumn("_models", models).withColumn("model", F.when(F.size("_models") > 0, F.get("_models", (turn - 1).cast("int"))).otherwise(""))
    return named.drop("_r", "_before", "_models")


def grade_lower(value: Column, green: float, yellow: float) -> Column:
    return F.when(value <= green, "green").when(value <= yellow, "yellow").otherwise("red")


def grade_higher(value: Column, green: float, yellow: float) -> Column:
    return F.when(value >= green, "green").when(value >= yellow, "yellow").otherwise("red")


def rank_of(grade: Column) -> Column:
    return _choose(grade, {g: k for k, g in enumerate(GRADES)}, 2)


def worst(*grades: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, GRADES)), F.greatest(*map(rank_of, grades)) + 1)


def fingerprint(observations: DataFrame, dims: list[str], decay: float = 0.95, window: int = 200) -> DataFrame:
    """(dim, key, weight) of the last `window` observations (seq and dims), later ones weighing more; weights of a dim add up
    to 1."""
    recent = observations.orderBy(F.desc("seq")).limit(window)
    aged = recent.withColumn("age", F.row_number().over(Window.orderBy(F.desc("seq"))) - 1)  # of `window` rows
    long = aged.select("age", F.inline(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("key")) for d in dims)))).where("key <> ''")
    sums = long.groupBy("dim", "key").agg(F.sum(F.pow(F.lit(decay), F.col("age"))).alias("w"))
    return sums.select("dim", "key", (F.col("w") / F.sum("w").over(Window.partitionBy("dim"))).alias("weight"))


def classify_workload(observed: DataFrame, profiles: DataFrame, boosted: DataFrame) -> DataFrame:
    """Cosine of a fingerprint to each profile (workload, dim, key, weight); workloads in boosted get 0.1 more, 1 at most."""
    both = profiles.join(observed.select("dim", "key", F.col("weight").alias("o")), ["dim", "key"], "left")
    sums = both.groupBy("workload").agg(F.sum(F.col("weight") * F.coalesce("o", F.lit(0.0))).alias("d"), F.sum(F.col("weight") * F.col("weight")).alias("p"))
    size = observed.agg(F.sum(F.col("weight") * F.col("weight")).alias("q"))
    made = sums.crossJoin(F.broadcast(size)).join(boosted.select("workload", F.lit(0.1).alias("boost")), "workload", "left")
    cos = F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("d") / F.sqrt(F.col("p") * F.col("q"))).otherwise(0.0)
    return made.select("workload", F.round(F.least(F.lit(1.0), cos + F.coalesce("boost", F.lit(0.0))), 4).alias("similarity"))


def rank_models(candidates: DataFrame, *by: str) -> DataFrame:
    """Candidates (model, quality, latency, varies, speed, params) ranked within a group: grades, steadiness, speed, size.
    Role: primary, fallback, alternative (the next three) or none."""
    w = Window.partitionBy(*by).orderBy(rank_of(F.col("quality")), rank_of(F.col("latency")), F.col("varies").cast("int"), F.desc("speed"), "params", "model")
    ranked = candidates.withColumn("rank", F.row_number().over(w))
    return ranked.withColumn("role", F.when(F.col("rank") == 1, "primary").when(F.col("rank") == 2, "fallback").when(F.col("rank") <= 5, "alternative").otherwise("none"))


def lookup(wanted: DataFrame, entries: DataFrame, excluded: tuple[str, ...] = (), default: str = "basic") -> DataFrame:
    """The first model that isn't excluded for (industry, task), else for (default, task). entries: industry, task, models."""
    own = wanted.join(entries, ["industry", "task"], "left")
    basic = entries.where(F.col("industry") == default).select("task", F.col("models").alias("basic_models"))
    both = own.join(basic, "task", "left").withColumn("m", F.coalesce("models", "basic_models"))
    return both.select("industry", "task", F.expr("try_element_at(filter(m, x -> not array_contains(array(%s), x)), 1)" % ", ".join(f"'{x}'" for x in (*excluded, ""))).alias("model"))


def choose_entry(wanted: DataFrame, entries: DataFrame, default: str = "basic") -> DataFrame:
    """The entry that serves each of wanted (industry, task, tier, use_int8, excluded: an array of models): that of its
    industry, else that of `default`. model, dtype, fallback; no row where there is none or all of its models are excluded.

    entries: industry, task, tier, config, fallback (structs of model and dtype) and alternatives (an array of such). Where
    INT8 is wanted, the first INT8 alternative takes the place of a configuration that isn't one, which becomes the fallback.
    An excluded model gives way to the fallback, else to the first alternative that isn't excluded, without a fallback then.
    """
    shape = "config", "fallback", "alternatives"
    own = entries.select("industry", "task", "tier", F.struct(*shape).alias("own"))
    basic = entries.where(F.col("industry") == default).select("task", "tier", F.struct(*shape).alias("basic"))
    both = wanted.join(own, ["industry", "task", "tier"], "left").join(basic, ["task", "tier"], "left")
    both = both.withColumn("e", F.coalesce("own", "basic")).where("e is not null")
    int8 = F.try_element_at(F.filter("e.alternatives", lambda a: a["dtype"] == "int8"), F.lit(1))
    swaps = F.col("use_int8") & (F.col("e.config.dtype") != "int8") & int8.isNotNull()
    rest = F.filter("e.alternatives", lambda a: a["model"] != int8["model"])
    both = both.withColumns({"c": F.when(swaps, int8).otherwise(F.col("e.config")), "f": F.when(swaps, F.col("e.config")).otherwise(F.col("e.fallback")), "a": F.when(swaps, rest).otherwise(F.col("e.alternatives"))})
    out = lambda x: F.array_contains("excluded", x["model"])
    left = F.try_element_at(F.filter("a", lambda x: ~out(x)), F.lit(1))
    gone = F.coalesce(out(F.col("c")), F.lit(False))
    usable = F.col("f").isNotNull() & ~F.coalesce(out(F.col("f")), F.lit(False))
    found = both.withColumn("chosen", F.when(~gone, F.col("c")).when(usable, F.col("f")).otherwise(left)).where("chosen is not null")
    return found.select(*wanted.columns, F.col("chosen.model").alias("model"), F.col("chosen.dtype").alias("dtype"), F.when(~gone, F.col("f.model")).alias("fallback"))


def params_billions(text: Column) -> Column:
    """350M, 2B, 2B+350M (the larger), 35B total / 3B active (the active), as billions; 0 if none."""
    active = F.regexp_extract(text, r"(?i)(\d+(?:\.\d+)?)\s*B\s*active", 1)
    one = lambda s: F.when(F.upper(F.regexp_extract(s, r"(?i)^\s*(\d+(?:\.\d+)?)\s*(M|B)", 2)) == "M", F.expr("0.001D")).otherwise(F.lit(1.0)) * F.coalesce(F.nullif(F.regexp_extract(s, r"(?i)^\s*(\d+(?:\.\d+)?)\s*(M|B)", 1), F.lit("")).cast("double"), F.lit(0.0))
    return F.when(active != "", active.cast("double")).otherwise(F.array_max(F.transform(F.split(text, r"\+"), one)))


def latency_table(samples: DataFrame, *by: str) -> DataFrame:
    """Percentiles (interpolated), spread and throughput of samples (latency_ms, output_tokens)."""
    shares = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    ms = F.col("latency_ms")
    made = samples.groupBy(*by).agg(
        F.count("*").alias("samples"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.avg(ms).alias("mean"),
        F.stddev_samp(ms).alias("sd"), F.sum("output_tokens").alias("tokens"), F.sum(ms).alias("ms"),
    )
    at = lambda share: (F.col("n") - 1) * share
    places = {f"{n}_{end}": f(at(q)) for n, q in shares.items() for end, f in (("lo", F.floor), ("hi", F.ceil))}
    found = values_at(samples, list(by), "latency_ms", places)
    between = lambda n, q: F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * (at(q) - F.floor(at(q)))
    found = found.select(*by, *(F.round(between(n, q), 6).alias(n) for n, q in shares.items()))
    cov = F.when((F.col("samples") >= 2) & (F.col("mean") > 0), F.col("sd") / F.col("mean")).otherwise(0.0)
    speed = F.round(F.when(F.col("ms") > 0, F.col("tokens") / (F.col("ms") / 1000)).otherwise(0.0), 2)
    both = made.join(found, list(by), "left")
    return both.select(
        *by, "samples", *shares, "min_ms", "max_ms", speed.alias("tokens_per_s"), F.round(cov, 4).alias("variation"), (cov > 0.20).alias("varies")
    )


def nearest_rank(samples: DataFrame, by: str) -> DataFrame:
    """The element at half and at 95 % of each group in order (not interpolated)."""
    places = {"median_ms": F.floor(F.col("n") * 0.5), "p95_ms": F.floor(F.col("n") * 0.95)}
    return values_at(samples, [by], "latency_ms", places).withColumnRenamed("n", "samples")


def majority(votes: DataFrame, by: str) -> DataFrame:
    """The answer most given in each group (ties: the one given first): its label word, else its first 20 characters."""
    low = F.lower(F.trim("answer"))
    word = F.regexp_extract(low, r"(?:^|\s)(positive|negative|neutral)(?:\s|$)", 1)
    counts = votes.withColumn("vote", F.when(word != "", word).otherwise(F.substring(low, 1, 20))).groupBy(by, "vote").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    best = counts.groupBy(by).agg(F.max_by("vote", F.struct("n", -F.col("first"))).alias("winner"), F.max("n").alias("votes"), F.sum("n").alias("total"))
    return best.withColumn("agreement", F.round(F.col("votes") / F.col("total"), 6))


def pressure_grade(readings: DataFrame) -> DataFrame:
    """readings (cpu_some, memory_some, memory_used, io_some as percent) with grades, overall and what to do."""
    limits = {"cpu_some": (40, 70), "memory_some": (10, 30), "memory_used": (70, 85), "io_some": (20, 50)}
    made = readings
    for name, (green, yellow) in limits.items():
        made = made.withColumn(f"{name}_grade", grade_lower(F.col(name), green, yellow))
    grades = [F.col(f"{n}_grade") for n in limits]
    reds, yellows = (sum((F.when(g == c, 1).otherwise(0) for g in grades), F.lit(0)) for c in ("red", "yellow"))
    return made.withColumn("overall", worst(*grades)).withColumn("action", F.when(reds >= 2, "shed_aggressive").when(reds >= 1, "shed").when(yellows >= 1, "hold").otherwise("restore"))


def hysteresis(graded: DataFrame, by: str, models: int = 6, shed_us: int = 30_000_000, restore_us: int = 120_000_000) -> DataFrame:
    """Models loaded after each group's readings (us, seq, action): one is shed or restored at a time, not sooner than the
    given times after the last one. A streamed fold over each group's readings in order."""

    def step(s: tuple, row: dict) -> tuple[tuple, tuple]:
        loaded, shed_at, back_at, sheds, restores = s
        us, action = row["us"], row["action"] or ""
        if action.startswith("shed") and loaded > 0 and (shed_at is None or us - shed_at >= shed_us):
            loaded, shed_at, sheds = loaded - 1, us, sheds + 1
        elif action == "restore" and loaded < models and (back_at is None or us - back_at >= restore_us):
            loaded, back_at, restores = loaded + 1, us, restores + 1
        return (loaded, shed_at, back_at, sheds, restores), (loaded, sheds, restores)

    rows = fold(graded.select(by, "us", "seq", "action"), by, ["us", "seq"], lambda: (models, None, None, 0, 0), step, "loaded int, sheds int, restores int")
    last = F.max_by(F.struct("loaded", "sheds", "restores"), F.struct("us", "seq")).alias("s")
    return rows.groupBy(by).agg(last).select(by, "s.loaded", "s.sheds", "s.restores")


def allocate(models: DataFrame, by: str, budget: float) -> DataFrame:
    """Replicas of each model (model, memory_gb) within a group's memory, the largest first: one over 5 GB, two or three over
    1 GB, at most eight below; what doesn't fit is left out. A fold over the group's models, of which there are few."""
    ordered = models.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("memory_gb", "model")), asc=False).alias("t"))
    start = F.struct(F.lit(float(budget)).alias("left"), F.array().cast("array<struct<model:string,replicas:int,total:double>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fits = F.floor(s["left"] / x["memory_gb"]).cast("int")
        want = F.when(x["memory_gb"] > 5.0, F.lit(1)).when(x["memory_gb"] > 1.0, F.greatest(F.lit(2), F.least(F.lit(3), F.greatest(F.lit(1), fits)))).otherwise(F.least(F.lit(8), F.greatest(F.lit(1), fits)))
        n = F.least(want, fits)
        given = F.struct(x["model"].alias("model"), n.alias("replicas"), (n * x["memory_gb"]).alias("total"))
        return F.when(fits >= 1, F.struct((s["left"] - n * x["memory_gb"]).alias("left"), F.concat(s["out"], F.array(given)).alias("out"))).otherwise(s)

    return ordered.select(by, F.explode(F.aggregate("t", start, step)["out"]).alias("m")).select(by, "m.model", "m.replicas", F.round("m.total", 3).alias("total_gb"))


def tiers(workloads: DataFrame) -> DataFrame:
    """workloads (daily_volume, routine_pct, ambiguous_pct) with nano, micro and macro signals a day; they add up. Workloads
    whose percentages don't add up to 100 are left out."""
    valid = workloads.where(F.abs(F.col("routine_pct") + F.col("ambiguous_pct") + F.col("complex_pct") - 100) <= 0.01)
    part = lambda c: F.floor(F.col("daily_volume") * F.col(c) / 100).cast("long")
    made = valid.withColumn("nano", part("routine_pct")).withColumn("micro", part("ambiguous_pct")).withColumn("macro", F.col("daily_volume") - F.col("nano") - F.col("micro"))
    return made.withColumn("compression", F.round(F.when(F.col("daily_volume") > 0, F.col("nano") / F.col("daily_volume")).otherwise(0.0), 6))


def owned_cost(split: DataFrame, hardware: DataFrame, years: int = 3, redundancy: float = 1.5, pue: float = 1.4, per_kwh: float = 0.12, hours: int = 8760) -> DataFrame:
    """Units and cost of each workload on each hardware that has a measured speed for both tiers (micro_tps, macro_tps). A
    workload without signals costs nothing, and for each signal NaN, as SQL's doubles say it."""
    tokens = F.col("tokens_in") + F.col("tokens_out")
    units = lambda tier: F.when(F.col(tier) * tokens > 0, F.ceil(F.col(tier) * tokens / (F.col(f"{tier}_tps") * 86400))).otherwise(0)
    served = ((F.col("micro") * tokens == 0) | (F.col("micro_tps") > 0)) & ((F.col("macro") * tokens == 0) | (F.col("macro_tps") > 0))
    rows = split.crossJoin(F.broadcast(hardware)).where(served).withColumn("units", F.ceil((units("micro") + units("macro")) * redundancy).cast("long"))
    rows = rows.withColumn("capex", F.col("units") * F.col("unit_cost")).withColumn("power", F.col("units") * F.col("watts") * hours * per_kwh * pue / 1000)
    each = F.when(F.col("daily_volume") == 0, F.lit(float("nan"))).otherwise(F.col("tco") / (F.col("daily_volume") * 365 * years))
    return rows.withColumn("tco", F.col("capex") + years * F.col("power")).select("workload", "hardware", "units", F.round("capex", 2).alias("capex"), F.round("power", 2).alias("power"), F.round("tco", 2).alias("tco"), F.round(each, 8).alias("per_signal"))


def rented_cost(split: DataFrame, per_1k_in: float, per_1k_out: float, years: int = 3) -> DataFrame:
    inferred = F.col("micro") + F.col("macro")
    annual = (inferred * F.col("tokens_in") * per_1k_in / 1000 + inferred * F.col("tokens_out") * per_1k_out / 1000) * 365
    return split.select("workload", F.round(annual, 2).alias("annual"), F.round(annual * years, 2).alias("tco"))
