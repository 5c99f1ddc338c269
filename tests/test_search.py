"""Anchored windows, searches and contents at the sizes and shapes that plain forms are held against."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.operators import anchors, baselines, contents, neighbours, recall

ROWS = "signal_id long, us long, seq long, k string"


def walked(rows, width):
    """Which rows open a window, one after the other."""
    at, out = {}, {}
    for i, us, seq, k in sorted(rows, key=lambda r: (r[1], r[2])):
        out[i] = k not in at or us - at[k] >= width
        if out[i]:
            at[k] = us
    return out


@pytest.mark.parametrize(("parts", "width"), [("8", 10), ("3", 1), ("5", 100_000)])
def test_anchored_windows_are_those_of_a_walk(spark, parts, width):
    """A hot key over all slices, equal times, chains of thousands, far gaps; the keys' order isn't the rows'."""
    rng, rows, us = random.Random(3), [], 0
    for k in range(3_000):
        us += rng.choice([0, 1, 3, 3, 9, 10, 11, 5_000])
        rows.append((k, us, k, rng.choice(["hot"] * 8 + ["b", None])))
    rows += [(9_000 + k, 7, 9_000 + k, f"k{k}") for k in range(20)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, ROWS).repartition(6)
        got = {r.signal_id: r.anchored for r in anchors.anchored(df, F.col("k"), width / 1_000_000, F.col("signal_id") >= 0).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == walked(rows, width)


def test_a_hot_key_is_spread_over_slices(spark, monkeypatch):
    """No task of the sort or of what follows holds more than its share of a key that has all rows."""
    made = {}
    monkeypatch.setattr(anchors, "written", lambda df, name, put=anchors.written: made.setdefault(name, put(df, name)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        times = spark.range(4_000).select(F.lit("hot").alias("k"), (F.col("id") * 5).alias("t"))
        found = anchors.pointers(times, 12)
        assert found.count() == 4_000 - 3 and found.where("to <> t + 15").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in made["slices"].groupBy("slice").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 8_000 / 4


def test_anchored_windows_of_nothing(spark):
    none = spark.createDataFrame([], ROWS)
    assert anchors.anchored(none, F.col("k"), 1, F.lit(True)).count() == 0
    timeless = spark.createDataFrame([(1, None, 1, "a"), (2, 5, 2, "a")], ROWS)
    assert {r.signal_id: r.anchored for r in anchors.anchored(timeless, F.col("k"), 1, F.lit(True)).collect()} == {1: False, 2: True}


@pytest.mark.parametrize("seed", [1, 2])
def test_bounded_recall_gives_the_plain_rows(spark, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6)))

    def side(n):
        return [(k, rng.choice(["a", "a", "a", "b", "c", None]), rng.sample(["l1", "l2", "l3", "l4"], rng.randrange(0, 4)), [rng.uniform(-1, 5), rng.choice([0.0, 1.0, 2.0])], text(), rng.choice([0.0, 0.02, 0.3, 0.9, 1.0, rng.random()])) for k in range(n)]

    shape = "id long, t string, l array<string>, f array<double>, x string, s double"
    m = spark.createDataFrame([*side(300), *[(1000 + k, "a", ["l1"], [1.0, 1.0], "w1 w2 w3", 1.0) for k in range(40)]], shape).select(F.col("id").alias("memory_id"), F.col("t").alias("signal_type"), F.col("l").alias("labels"), F.col("f").alias("features"), recall.trigrams(F.col("x")).alias("grams"), F.col("s").alias("strength"))
    q = spark.createDataFrame(side(60), shape).select(F.col("id").alias("query_id"), F.col("t").alias("q_type"), F.col("l").alias("q_labels"), F.col("f").alias("q_features"), recall.trigrams(F.col("x")).alias("q_grams"))
    for k, least in ((5, 0.1), (400, 0.05)):
        plain = recall.recall(q, m, k, least)
        got = recall.recall_bounded(q, m, k, least)
        rows = lambda df: sorted((r.query_id, r.rank, r.memory_id, r.score) for r in df.collect())
        assert rows(got) == rows(plain)
    assert recall.recall_bounded(q.limit(0), m).count() == 0 and recall.recall_bounded(q, m.limit(0)).count() == 0


def test_bounded_recall_makes_few_pairs(spark, monkeypatch):
    """Where each query has memories much like it, what is compared is a small share of all pairs."""
    made = {}
    monkeypatch.setattr(recall, "written", lambda df, name, put=recall.written: made.setdefault(name, put(df, name)))
    rows = spark.range(2_000).select(F.col("id").alias("memory_id"), F.concat(F.lit("t"), F.col("id") % 3).alias("signal_type"), F.array(F.concat(F.lit("l"), F.col("id") % 50)).alias("labels"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("features"), recall.trigrams(F.sha2((F.col("id") % 100).cast("string"), 256)).alias("grams"), F.lit(1.0).alias("strength"))
    asked = rows.where("memory_id % 20 = 0").select(F.col("memory_id").alias("query_id"), F.col("signal_type").alias("q_type"), F.col("labels").alias("q_labels"), F.col("features").alias("q_features"), F.col("grams").alias("q_grams"))
    assert recall.recall_bounded(asked, rows).count() == 500
    assert made["pairs"].count() < 0.05 * made["profiles"].count() * made["asked"].count()


def vectors(n=1_500, dims=12, seed=5):
    rng = np.random.default_rng(seed)
    means = rng.standard_normal((20, dims)) * 2
    v = [(k, (means[k % 20] + rng.standard_normal(dims)).tolist()) for k in range(n)]
    v += [(5_000 + k, v[7][1]) for k in range(300)]  # copies
    return v + [(6_000, [0.0] * dims), (6_001, None), (6_002, [math.nan] * dims), (6_003, [1.0]), (6_004, [1.0, None])]


def test_cells_give_the_rows_of_a_full_scan(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(4)
    index = neighbours.Index(df, cells=30, part_rows=100)
    asked = df.where("vec_id % 50 = 0 or vec_id > 6000").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    got = sorted(tuple(r) for r in index.search(asked, 7, 0.3).collect())
    pad = lambda v: np.array([*v, *[0.0] * (12 - len(v))])
    held = [(i, pad(v) / np.linalg.norm(pad(v))) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    want = []
    for i, q in held:
        if i % 50 == 0 or i > 6000:
            best = sorted((-round(float(q @ x), 6), j) for j, x in held if round(float(q @ x), 6) >= 0.3)[:7]
            want += [(i, j, -s, rank) for rank, (s, j) in enumerate(best, 1)]
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in sorted(want)]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, sorted(want), strict=True))
    p = index.probes_for(asked, 0.97, 7, 0.3)
    few = {(r.query_id, r.vec_id) for r in index.search(asked, 7, 0.3, p).collect()}
    assert p < 30 and len(few & {(a, b) for a, b, *_ in want}) >= 0.95 * len(want)


def test_an_index_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, v array<double>")
    index = neighbours.Index(none)
    assert index.search(spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, q array<double>")).count() == 0
    one = neighbours.Index(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, v array<double>"))
    assert one.search(none.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))).count() == 0


def flat(content, path=""):
    out = {}
    for k, v in content.items():
        at = f"{path}.{k}" if path else k
        if isinstance(v, dict) and k not in ("node", "host"):
            out |= flat(v, at)
        else:
            out[at] = v
    return out


def test_nested_contents_are_walked_to_any_depth(spark):
    deep = {"x": 1}
    for k in range(12):
        deep = {f"d{k}": deep, "s": f"pod web-7f9c8d{k}"}
    contents_ = [{"a": 1, "b": {"c": [1, {"z": 2}], "node": {"q": "web-7f9c8d"}, "host": "web-7f9c8d"}, "t": True, "n": None, "e": {}}, deep, {}]
    texts = [(k, json.dumps(c)) for k, c in enumerate(contents_)] + [(7, "not json {"), (8, None), (9, "[1, 2]"), (10, '"word"')]
    df = spark.createDataFrame(texts, "id long, t string").withColumn("c", contents.parsed("t"))
    got = {}
    rows = contents.leaves(df, "id", "c")
    for r in rows.collect():
        got.setdefault(r.id, {})[r.path] = r.text
    assert got[1].keys() == flat(deep).keys() and got[1]["d11.d10.s"] == "pod web" and got[1]["s"] == "pod web"
    assert got[0] == {"a": "1", "b.c": '[1,{"z":2}]', "b.node": '{"q":"web-7f9c8d"}', "b.host": "web-7f9c8d", "t": "true", "n": "null"}
    assert got[7] == {"raw": "not json {"} and 2 not in got and 8 not in got and 9 not in got
    assert {(r.id, r.name, r.value) for r in contents.features(rows, "id").collect()} == {(0, "a", 1.0), (0, "t", 1.0)}
    alike = spark.createDataFrame([(1, '{"m": "pod web-7f9c8d", "b": {"y": 2, "x": 1}}'), (2, '{"b": {"x": 1, "y": 2}, "m": "pod web-abcde1"}'), (3, '{"b": {"x": 1, "y": 3}, "m": "pod web-abcde1"}')], "id long, t string")
    h = {r.id: r.content_hash for r in contents.hashes(contents.leaves(alike.withColumn("c", contents.parsed("t")), "id", "c"), "id").collect()}
    assert h[1] == h[2] != h[3]


def test_merged_days_are_within_their_error(spark):
    rng = np.random.default_rng(1)
    n = 60_000
    rows = spark.range(n).select(F.lit("a").alias("kind"), (F.col("id") * 10_000_000).alias("us"), (F.col("id") % 9_000).cast("string").alias("who"), F.pow(F.col("id") * 7919 % n, F.lit(1.5)).alias("v"))
    days = baselines.daily(rows, "kind", "us", "who", "v")
    found = baselines.estimates(baselines.merged(days)).first()
    v = np.sort(np.arange(n) ** 1.5)
    assert found.signals == n and abs(found.members - 9_000) <= 3 * 1.04 / 64 * 9_000 and days.count() == 7
    for q, at in (("q50", 0.5), ("q90", 0.9), ("q99", 0.99)):
        assert abs(np.searchsorted(v, found[q]) / n - at) <= 2 * baselines.RANK_ERROR
    halves = [baselines.estimates(baselines.merged(days.where(test))) for test in ("day < 3", "day >= 3")]
    assert baselines.compare(*halves).count() == 0
    other = baselines.estimates(baselines.merged(baselines.daily(rows.withColumn("v", F.col("v") * 5 + 1).unionByName(rows.limit(3).withColumn("kind", F.lit("b"))), "kind", "us", "who", "v")))
    assert {(r.kind, r.reason) for r in baselines.compare(halves[0], other).collect()} == {("a", "slower"), ("b", "unexpected")}
    none = baselines.estimates(baselines.daily(rows.limit(5).withColumn("v", F.lit(None).cast("double")), "kind", "us", "who", "v")).first()
    assert none.q50 is None and none.members == 5 and rng is not None


def test_a_query_goes_once_to_a_slot_of_cells(spark, monkeypatch):
    """Where bounds prune nothing, a query's vector isn't sent once for each cell; what is fitted stays out of the driver."""
    made = {}
    monkeypatch.setattr(neighbours, "written", lambda df, name, *by, put=neighbours.written: made.setdefault(name, put(df, name, *by)))
    rng = np.random.default_rng(2)
    rows = [(k, rng.standard_normal(24).tolist()) for k in range(1_200)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    index = neighbours.Index(df, cells=40, part_rows=400)
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    got = sorted((r.query_id, r.rank, r.vec_id) for r in index.search(asked, 5, 0.1).collect())
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = [(k, r, int(j)) for k in range(0, 1_200, 50) for r, j in enumerate(np.lexsort((np.arange(1_200), -np.round(u @ u[k], 6)))[:5], 1)]
    assert got == want and index.slots < 10
    assert made["further"].count() <= 24 * index.slots


def test_a_scan_of_vectors_is_done_by_products_of_blocks(spark, monkeypatch):
    """No pair of vectors is a row; blocks of any size, lengths that differ, copies, nulls, zeros and NaN."""
    monkeypatch.setattr(recall, "every_pair", None)
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(5).tolist()) for k in range(300)] + [(300 + k, [1.0, 2.0, 3.0, 4.0, 5.0]) for k in range(9)]
    rows += [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0]), (402, [0.0] * 5), (403, [1.0, 2.0]), (404, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    asked = df.where("vec_id % 50 = 0 or vec_id > 304").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    held, want = [(i, unit(v)) for i, v in rows if v and None not in v], []
    for i, q in held:
        if i % 50 == 0 or i > 304:
            found = sorted((-round(float(q @ x), 6), j) for j, x in held if len(x) == len(q) and round(float(q @ x), 6) >= 0.3)[:6]
            want += [(i, r, j) for r, (_, j) in enumerate(found, 1)]
    for block_bytes in (4 << 20, 64 * 8 * 5):
        got = recall.vector_search(asked, df, 6, 0.3, block_bytes)
        assert sorted((r.query_id, r.rank, r.vec_id) for r in got.collect()) == sorted(want)
    odd = spark.createDataFrame([(1, [math.nan, 1.0]), (2, [1.0, 1.0])], "vec_id long, v array<double>")
    assert [(r.vec_id, r.rank, math.isnan(r.similarity)) for r in recall.vector_search(odd.where("vec_id = 2").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), odd, 2, 0.3).orderBy("rank").collect()] == [(1, 1, True), (2, 2, False)]


def test_memories_of_a_profile_are_scored_in_blocks(spark, monkeypatch):
    """Many queries and memories of few profiles: no pair of them is a row, and blocks of any size give the plain rows."""
    rng = random.Random(7)
    side = lambda n, at: [(at + k, rng.choice("ab"), [float(rng.randrange(9)), rng.choice([0.0, 1.0, 2.5])] if rng.random() < 0.9 else rng.choice([None, [1.0], [0.0], [1.0, None]]), rng.choice(["disk full", "disk lost"]), rng.choice([0.2, 0.9, 1.0])) for k in range(n)]
    shape = "id long, t string, f array<double>, x string, s double"
    none = F.array().cast("array<string>")
    m = spark.createDataFrame(side(900, 0), shape).select(F.col("id").alias("memory_id"), F.col("t").alias("signal_type"), none.alias("labels"), F.col("f").alias("features"), recall.trigrams(F.col("x")).alias("grams"), F.col("s").alias("strength"))
    q = spark.createDataFrame(side(200, 5_000), shape).select(F.col("id").alias("query_id"), F.col("t").alias("q_type"), none.alias("q_labels"), F.col("f").alias("q_features"), recall.trigrams(F.col("x")).alias("q_grams"))
    rows = lambda df: sorted((r.query_id, r.rank, r.memory_id, r.score) for r in df.collect())
    want = rows(recall.recall(q, m))
    assert rows(recall.recall_bounded(q, m)) == want and len(want) == 1_000
    monkeypatch.setattr(recall, "_ASKED", 16)
    monkeypatch.setattr(recall, "_STORED", 30)
    assert rows(recall.recall_bounded(q, m)) == want


def test_what_is_asked_twice_is_scored_once_and_the_outdone_are_left_out(spark, monkeypatch):
    """Repeated queries and memories, angles that differ by less than a score shows, texts for trigrams, columns that come along."""
    made, put = {}, recall.written
    monkeypatch.setattr(recall, "written", lambda df, name: made.update({name: (table := put(df, name))}) or table)
    monkeypatch.setattr(recall, "_PAIRS", 64)
    rng = random.Random(11)
    some = [[round(rng.expovariate(0.1), 1), float(rng.randrange(20))] for _ in range(12)] + [[-3.0, 1.0], [0.0, 0.0], [5.0, 1e-4], [5.0, 2e-4]]
    side = lambda n, at: [(at + k, rng.choice("aab"), rng.choice(some), rng.choice(["disk full", "Disk full", "no", None]), rng.choice([0.01, 0.2, 0.9, 1.0, 1.0])) for k in range(n)]
    shape = "id long, t string, f array<double>, x string, s double"
    none = F.array().cast("array<string>")
    m = spark.createDataFrame(side(3_000, 0), shape).select(F.col("id").alias("memory_id"), F.col("t").alias("signal_type"), none.alias("labels"), F.col("f").alias("features"), F.col("x").alias("grams"), F.col("s").alias("strength"), F.concat(F.lit("m"), "id").alias("note"))
    q = spark.createDataFrame(side(3_000, 5_000), shape).select(F.col("id").alias("query_id"), F.col("t").alias("q_type"), none.alias("q_labels"), F.col("f").alias("q_features"), F.col("x").alias("q_grams"))
    rows = lambda df: sorted((r.query_id, r.rank, r.memory_id, r.score) for r in df.collect())
    got = recall.recall_bounded(q, m, carried=("note", "strength")).collect()
    want = rows(recall.recall(q.withColumn("q_grams", recall.trigrams(F.col("q_grams"))), m.withColumn("grams", recall.trigrams(F.col("grams")))))
    assert sorted((r.query_id, r.rank, r.memory_id, r.score) for r in got) == want and len(want) == 15_000
    assert all(r.note == f"m{r.memory_id}" and r.strength >= r.score for r in got)
    assert made["different"].count() <= 8 * 16 and made["memories"].count() < 1_500
