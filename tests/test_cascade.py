"""The cascade over small literal signals."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tamis.operators import agents, discovery, intelligence, memory, pipeline, promotion, recall, serving
from tamis.operators.agents import Agent, decision
from tamis.sources import mappings
from tamis.sources.adapters import content_text, event_signals, first_of, normal_severity

SCHEMA = "signal_id long, seq long, us long, ts timestamp, signal_type string, severity string, source string, namespace string, cluster string, message string, label string, cpu_percent double, latency_ms double"


def signals(spark, *rows):
    """Rows of (type, severity, message) and what differs from the defaults."""
    made = []
    for k, (kind, severity, message, *more) in enumerate(rows):
        own = {"source": "a", "namespace": "n", "label": "", "cpu_percent": 10.0, "latency_ms": 1.0, "us": k * 1_000_000} | (more[0] if more else {})
        made.append((k, k, own["us"], None, kind, severity, own["source"], own["namespace"], "c", message, own["label"], own["cpu_percent"], own["latency_ms"]))
    return spark.createDataFrame(made, SCHEMA).withColumn("content_text", content_text("message", "cpu_percent"))


def outcome(df):
    return {r.signal_id: (r.survives, r.removed, r.escalated) for r in pipeline.annotate(df).collect()}


def test_duplicates_go_and_labelled_ones_stay(spark):
    got = outcome(signals(spark, ("x", "high", "m"), ("x", "high", "m"), ("x", "high", "m", {"label": "fraud"}), ("x", "high", "m", {"label": "fraud"}), ("x", "high", "other")))
    assert [got[k][0] for k in range(5)] == [True, False, True, True, True]


def test_critical_words_in_info_survive(spark):
    got = outcome(signals(spark, ("x", "info", "kernel panic"), ("x", "info", "all well"), ("x", "info", "all well", {"label": "compliance", "source": "b"})))
    assert got[0] == (True, False, True)
    assert not got[1][0] and got[1][1]
    assert not got[2][0] and not got[2][1]  # passes the gate and goes at the end, without a decision


def test_transient_types_need_low_severity_and_calm_text(spark):
    got = outcome(signals(spark, ("dns_timeout", "low", "a"), ("dns_timeout", "high", "b"), ("dns_timeout", "low", "data loss")))
    assert [got[k][0] for k in range(3)] == [False, True, True]


def test_trend_protects_from_later_removal(spark):
    rise = [("v", "info", f"r{k}", {"latency_ms": v}) for k, v in enumerate((10.0, 11.0, 12.5))]
    got = outcome(signals(spark, *rise))
    assert got[2] == (True, False, True)
    assert not got[0][0] and not got[1][0]


def test_oscillation_needs_four_readings(spark):
    df = signals(spark, *(("v", "info", f"r{k}", {"latency_ms": v}) for k, v in enumerate((10.0, 20.0, 10.0, 20.0))))
    assert [outcome(df)[k][2] for k in range(4)] == [False, False, False, True]


def test_classified_medium_survives_with_its_class(spark):
    kept = pipeline.survivors(pipeline.annotate(signals(spark, ("x", "medium", "disk full"), ("y", "high", "OOMKilled and disk full"), ("z", "low", "fine")))).collect()
    assert {r.signal_id: r.classification for r in kept} == {0: "disk_pressure", 1: "memory_exhaustion", 2: ""}


def test_thresholds_are_strict_and_zero_is_no_reading(spark):
    df = signals(spark, *(("x", "high", f"m{k}", {"cpu_percent": v}) for k, v in enumerate((80.0, 80.1, 95.0, 95.1)))).withColumn("cpu_usage", F.lit(99.0))
    kinds = [r.k for r in df.select(agents.threshold_class(df.columns).alias("k")).collect()]
    assert kinds == [None, "cpu_warning", "cpu_warning", "cpu_critical"]
    zero = signals(spark, ("x", "high", "m", {"cpu_percent": 0.0})).withColumn("cpu_usage", F.lit(99.0))
    assert zero.select(agents.threshold_class(zero.columns)).first()[0] == "cpu_critical"


def test_an_agent_that_fails_drops_nothing(spark):
    def broken(df, active):
        raise RuntimeError

    def unplannable(df, active):
        return F.when(F.col("no such column") == 1, decision("drop"))

    df = signals(spark, ("x", "high", "m"))
    assert pipeline.annotate(df, [Agent("broken", 1, broken), Agent("unplannable", 1, unplannable)]).where("survives").count() == 1


def test_nothing_is_lost(spark, sf):
    run = pipeline.annotate(event_signals(spark, sf)).cache()
    s = pipeline.summary(run).first()
    assert s.total == run.count() == s.remaining + run.where("not survives").count()
    # what is high or critical goes as a duplicate only
    gone = run.where("not survives and severity in ('high', 'critical')")
    assert gone.where("d_deduplicate is null").count() == 0


def test_empty_batch(spark):
    run = pipeline.annotate(signals(spark).limit(0))
    assert run.count() == 0 and pipeline.summary(run).first().compression_ratio == 0.0 and pipeline.decisions(run).count() == 0


def test_result_does_not_depend_on_partitions(spark, sf):
    one = {r.signal_id for r in pipeline.annotate(event_signals(spark, sf).repartition(1)).where("survives").select("signal_id").collect()}
    many = {r.signal_id for r in pipeline.annotate(event_signals(spark, sf).repartition(7, "namespace")).where("survives").select("signal_id").collect()}
    assert one == many


def test_flood_counts_what_it_suppresses(spark):
    df = signals(spark, *(("beat", "low", "m", {"us": t * 1_000_000}) for t in (0, 1, 2, 3, 4, 303)))
    agent = agents.repeat_flood(("beat",), 3, 300)
    hit = [r.seq for r in df.withColumn("d", agent.decide(df, F.lit(True))).where("d is not null").collect()]
    assert hit == [3, 4]
    high = signals(spark, *(("beat", "high", "m") for _ in range(6)))
    assert high.withColumn("d", agent.decide(high, F.lit(True))).where("d is not null").count() == 0


def test_anchored_window_is_not_moved_by_what_it_holds(spark):
    df = signals(spark, *(("t", "low", "m", {"us": t * 1_000_000}) for t in (0, 200, 299, 300, 599, 600)))
    got = {r.signal_id: r.anchored for r in agents.anchored(df, F.col("signal_type"), 300, F.lit(True)).collect()}
    assert [got[k] for k in range(6)] == [True, False, False, True, False, True]


def test_missing_severity_is_medium_and_entities_have_order(spark):
    df = spark.createDataFrame([(None, "", "h"), ("odd", "n1", "h"), ("low", None, None)], "severity string, node string, host string")
    rows = df.select(normal_severity().alias("s"), first_of({"node": F.col("node"), "host": F.col("host")}).alias("e")).collect()
    assert [tuple(r) for r in rows] == [("medium", "host=h"), ("medium", "node=n1"), ("low", None)]


def test_promotion_ladder(spark):
    rows = [("a", "draft", 50, 0.6, 0.3, 0.2, 5), ("b", "candidate", 200, 0.75, 0.15, 0.0, 0), ("c", "candidate", 199, 0.9, 0.0, 0.0, 0), ("d", "nano", 900, 0.9, 0.0, 0.1, 1), ("e", "nano", 500, 0.85, 0.1, 0.0, 0)]
    df = spark.createDataFrame(rows, "name string, tier string, samples long, accuracy double, false_positive_rate double, false_negative_rate double, fn long").withColumns({"human_reviewed": F.lit(False), "human_approved": F.lit(False), "deactivated": F.lit(False)})
    got = {r.name: (r.new_tier, r.deactivated) for r in promotion.next_tier(df).collect()}
    assert got == {"a": ("candidate", False), "b": ("nano", False), "c": ("candidate", False), "d": ("draft", True), "e": ("nano", False)}
    gated = {r.name: r.new_tier for r in promotion.next_tier(df, human_gate=True).collect()}
    assert gated["b"] == "pending_approval"


def test_discovery_of_nothing(spark):
    none = signals(spark).limit(0)
    assert discovery.draft_agents(none).count() == 0 and discovery.mono_severity(none).count() == 0


def test_memory_strength_and_eviction(spark):
    rows = memory.form(signals(spark, ("x", "critical", "a"), ("x", "low", "b"), ("x", "high", "b"), ("y", "info", "c 0f8fad5b-d9cb-469f-a165-70867728950e"), ("y", "info", "c 7c9e6679-7425-40de-944b-e07fc1f90ae7")), ["message"])
    got = {r.memory_id: round(r.strength, 6) for r in rows.collect()}
    assert got == {0: 1.0, 1: round(1 - 0.8 * 0.9, 6), 3: round(1 - 0.9 * 0.9, 6)}
    kept, gone = memory.evict(rows, 2)
    assert [r.memory_id for r in gone.collect()] == [3, 1] and kept.count() == 1
    assert memory.evict(rows, 3)[1].count() == 0


def test_federation_rejects_reinforces_and_adds(spark):
    shape = "content_hash string, memory_id long, strength double"
    local, incoming = spark.createDataFrame([("a", 1, 0.5)], shape), spark.createDataFrame([("a", 9, 0.9), ("b", 8, 0.2), ("c", 7, 0.3)], shape)
    got = {r.memory_id: (r.origin, round(r.strength, 6)) for r in memory.receive(local, incoming, spark.createDataFrame([("c",)], "content_hash string")).collect()}
    assert got == {1: ("reinforced", 0.55), 8: ("imported", 0.2)}


def test_sessions_across_slices(spark):
    df = spark.createDataFrame([(k, us) for k, us in enumerate((5, 90, 105, 330, 395, 401, 900))], "seq long, us long")
    got = [r.session for r in intelligence.sessions(df, 100, slice_us=100).orderBy("seq").collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2]


def test_closure_reaches_its_start_through_a_cycle_only(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "cause string, effect string")
    assert {tuple(r) for r in intelligence.closure(edges).collect()} == {("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "b"), ("c", "c")}


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "abc", 1.0), ("abcd", "abce", 1 / 3), ("ab", "ab", 0.0), ("", "abc", 0.0), (None, "abc", 0.0)])
def test_trigram_similarity(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(recall.jaccard(recall.trigrams(F.col("a")), recall.trigrams(F.col("b")))).first()[0] == pytest.approx(want)


def test_hash_embedding_is_a_unit_vector_of_digests(spark):
    import hashlib
    import struct

    v = spark.createDataFrame([("hello",)], "t string").select(recall.hash_embedding(F.col("t"))).first()[0]
    raw = [x for block in range(48) for x in struct.unpack("<8i", hashlib.sha256(f"hello:{block}".encode()).digest())]
    size = sum(x * x for x in raw) ** 0.5
    assert v == pytest.approx([x / size for x in raw])


def test_allocation_takes_the_largest_first(spark):
    df = spark.createDataFrame([("f", "big", 6.0), ("f", "mid", 2.0), ("f", "small", 0.5), ("f", "huge", 50.0)], "fleet string, model string, memory_gb double")
    assert {r.model: r.replicas for r in serving.allocate(df, "fleet", 14.0).collect()} == {"big": 1, "mid": 3, "small": 4}


def test_finance_rules(spark):
    shape = "transaction_type string, amount double, velocity_1h int, is_first_time_country boolean, is_first_time_merchant boolean, is_recurring boolean, merchant string, country string"
    df = spark.createDataFrame([("wire_transfer", 10.0, 1, True, False, False, "m", "X"), ("cash_deposit", 9000.0, 1, False, False, False, "m", "X"), ("card", 1234.5, 3, False, True, True, "m", "X"), ("card", 10.0, 1, None, None, None, "m", "X")], shape)
    rows = mappings.finance(df).withColumn("message", mappings.finance_message()).collect()
    assert [(r.signal_type, r.severity) for r in rows] == [("wire_international_first", "high"), ("cash_deposit_sub_10k", "medium"), ("recurring_charge", "medium"), ("card_standard", "info")]
    assert rows[2].message == "$1,234.50 at m (card) in X [first-time merchant, recurring, velocity=3/hr]"


def test_long_chains_are_closed(spark):
    from tamis.operators import intelligence

    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(70)], "cause string, effect string")
    assert intelligence.closure(edges).count() == 71 * 70 // 2


def test_queries_that_are_not_small_meet_rows_in_blocks(spark):
    from tamis.operators import recall

    rows = spark.range(40).select(F.col("id").alias("row_id"))
    queries = spark.range(30).select(F.col("id").alias("query_id"))
    made = recall.every_pair(rows, queries, block_bytes=100)
    assert "Cartesian" not in made._jdf.queryExecution().toString() and made.distinct().count() == made.count() == 1200


def test_first_rows_and_places(spark):
    from tamis.operators import places

    values = [(k, (k * 37) % 101, "ab"[k % 2]) for k in range(101)]
    df = spark.createDataFrame(values, "id long, v long, g string")
    for n in (0, 1, 50, 101, 500):
        assert sorted(r.v for r in places.lowest(df, n, "v").collect()) == sorted(v for _, v, _ in values)[:n]
        assert sorted(r.v for r in places.lowest(df, n, "g", "v").collect()) == sorted(v for v, _ in sorted(((v, g) for _, v, g in values), key=lambda x: (x[1], x[0]))[:n])
    got = {r.g: (r.n, r.first, r.middle, r.last) for r in places.values_at(df, ["g"], "v", {"first": F.lit(0), "middle": F.floor(F.col("n") / 2), "last": F.col("n") - 1}).collect()}
    for g in "ab":
        own = sorted(v for _, v, x in values if x == g)
        assert got[g] == (len(own), own[0], own[len(own) // 2], own[-1])
    same = spark.createDataFrame([("x", 5.0)] * 9, "g string, v double")
    assert places.values_at(same, ["g"], "v", {"m": F.floor(F.col("n") / 2)}).first().m == 5.0


def test_selection_of_ties_texts_and_wide_ranges(spark):
    from tamis.operators import places

    rng = random.Random(2)
    names = ["", "a", "a\x00", "ab", "abcdefg", "abcdefgh", "abcdefgz", "é", "日本", "z" * 30]
    rows = [(k, rng.choice([0.1, 0.1, 0.1, -5.0, 1e300, -1e300, 1e-300, 0.5 + k * 1e-12]), rng.choice(names), rng.choice([-(1 << 62), 1 << 62, k])) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, v double, s string, n long").repartition(5)
    order = {"v": lambda r: r[1], "s": lambda r: r[2].encode(), "n": lambda r: r[3], "id": lambda r: r[0]}
    for by in (("v", "id"), ("s", "id"), ("n", "v", "id"), ("s", "v", "n", "id")):
        ranked = [r[0] for r in sorted(rows, key=lambda r: [order[c](r) for c in by])]
        for n in (1, 200, 399):
            assert sorted(r.id for r in places.lowest(df, n, *by).collect()) == sorted(ranked[:n])
    same = spark.createDataFrame([(1, "x")] * 50, "v int, s string")
    assert places.lowest(same, 20, "v", "s").count() == 20 and places.lowest(same.limit(0), 5, "v").count() == 0


def test_folds_stream_keys_in_order(spark):
    from tamis.operators.folds import fold

    df = spark.createDataFrame([(k, "ab"[k % 2] if k % 5 else None, 100 - k) for k in range(50)], "id long, k string, at long").repartition(4)
    rows = fold(df, "k", ["at"], lambda: 0, lambda s, r: (s + r["id"], (s,)), "before long").collect()
    for key in (None, "a", "b"):
        own, total = sorted((r for r in rows if r.k == key), key=lambda r: r.at), 0
        for r in own:
            assert r.before == total
            total += r.id
    assert len(rows) == 50 and fold(df.limit(0), "k", ["at"], lambda: 0, lambda s, r: (s, (s,)), "x long").count() == 0


def test_stream_memory_starts_again_where_it_stopped(spark, tmp_path):
    from tamis.streaming import jobs

    source = tmp_path / "events"
    part = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    part.where("event_id % 2 = 0").coalesce(1).write.parquet(str(source))
    run = lambda: jobs.remember(jobs.signals(spark, str(source)), ["message"], ["source"], str(tmp_path / "memories"))
    half = run().agg(F.sum("occurrences")).first()[0]
    part.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(str(source))
    assert (half, run().agg(F.sum("occurrences")).first()[0]) == (part.where("event_id % 2 = 0").count(), part.count())
    assert run().agg(F.sum("occurrences")).first()[0] == part.count()


def test_a_workload_without_signals_has_no_cost_for_each(spark):
    rows = spark.createDataFrame([(1, 0, 70.0, 10.0, 20.0, 150, 20), (2, 1_000_000, 70.0, 10.0, 20.0, 150, 20)], "workload long, daily_volume long, routine_pct double, ambiguous_pct double, complex_pct double, tokens_in int, tokens_out int")
    hardware = spark.createDataFrame([("cpu", 12000.0, 700.0, 400.0, 60.0)], "hardware string, unit_cost double, watts double, micro_tps double, macro_tps double")
    got = {r.workload: r for r in serving.owned_cost(serving.tiers(rows), hardware).collect()}
    assert (got[1].units, got[1].tco) == (0, 0.0) and math.isnan(got[1].per_signal) and got[2].per_signal > 0
