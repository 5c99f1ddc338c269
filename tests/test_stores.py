"""Tables that change, collectors as sources, and keyed state on streams: replays, restarts and any cut into batches."""

import random

import pytest
from pyspark.sql import functions as F

from tamis.operators import stores
from tamis.operators.stores import Ledger, UpsertTable
from tamis.sources.collectors import Collected
from tamis.streaming import stateful


def latest(rows):
    return rows.groupBy("k").agg(F.max(F.struct("at", "v")).alias("x")).select("k", F.col("x.v").alias("v"), F.col("x.at").alias("at"))


def test_upsert_touches_its_buckets_alone_and_replays_alike(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), "k", latest, buckets=8, most=2)
    rng, want, batches = random.Random(1), {}, []
    for at in range(7):
        rows = [(rng.choice(["a", "b", "c", "d", "e", None, "f" * 50]), rng.randrange(100), at) for _ in range(rng.randrange(1, 6))]
        rows = list({r[0]: r for r in rows}.values())
        want |= {k: (v, at) for k, v, at in rows}
        batches.append(spark.createDataFrame(rows, "k string, v int, at int"))
    for at, rows in enumerate(batches):
        before = table.manifest()["files"]
        touched = table.upsert(rows, at)
        now = table.manifest()["files"]
        assert {int(b) for b in now if now[b] != before.get(b)} == set(touched) and len(touched) <= rows.count()
        assert table.upsert(rows, at) == []  # run again
        assert max(len(f) for f in now.values()) <= 2
    assert {r.k: (r.v, r.at) for r in table.read().collect()} == want
    assert table.upsert(batches[0].limit(0), 7) == [] and table.manifest()["batch"] == 7
    again = UpsertTable(spark, str(tmp_path / "u"), "k", latest, buckets=3)
    for at, rows in enumerate(batches):
        again.upsert(rows, at)
    assert sorted(map(str, again.read().collect())) == sorted(map(str, table.read().collect()))


def test_upsert_before_the_first_batch_and_by_two_jobs(spark, tmp_path):
    one, two = (UpsertTable(spark, str(tmp_path / "t"), "k", latest) for _ in range(2))
    assert one.read() is None
    seen = two.manifest()
    one.upsert(spark.createDataFrame([("a", 1, 1)], "k string, v int, at int"), 0)
    with pytest.raises(RuntimeError):
        two.commit(seen)
    assert [tuple(r) for r in two.read().collect()] == [("a", 1, 1)]


def test_ledger_takes_each_record_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), "k", buckets=4, size=256)  # small filters: many are asked in vain
    rows = lambda lo, hi: spark.createDataFrame([(f"k{k}", k) for k in range(lo, hi)] + [(None, 0), (f"k{lo}", lo)], "k string, v int")
    assert ledger.read() is None
    assert ledger.append(rows(0, 60), 0) == 60
    assert ledger.prepare(rows(60, 90), 1)["added"] == 30  # written, and killed before the commit
    assert ledger.read().count() == 60
    assert ledger.append(rows(40, 90), 1) == 30 and ledger.append(rows(40, 90), 1) == 0
    assert ledger.append(rows(0, 95), 2) == 5
    assert ledger.append(rows(0, 1).limit(0), 3) == 0
    assert sorted(r.v for r in ledger.read().collect()) == list(range(95))


def collected(spark, path, **options):
    spark.dataSource.register(Collected)
    return {"collector": "tamis.sources.collectors:Files", "path": str(path), "rows": "7", **options}


def test_collector_reads_parts_and_takes_filters(spark, tmp_path):
    whole = spark.range(100).selectExpr("id", "id % 7 AS g", "CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(id AS STRING) END AS s")
    whole.repartitionByRange(3, "id").write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = spark.read.format("collected").options(**collected(spark, tmp_path / "t")).load()
    assert read.schema == spark.read.parquet(str(tmp_path / "t")).schema
    assert sorted(map(str, read.collect())) == sorted(map(str, whole.collect())) and read.rdd.getNumPartitions() == 15
    for test in ("id >= 40 AND g = 3", "s = '41'", "id < 5 OR g = 1", "s IS NULL AND id > 90", "id > 1000"):
        read = spark.read.format("collected").options(**collected(spark, tmp_path / "t")).load()
        assert sorted(map(str, read.where(test).collect())) == sorted(map(str, whole.where(test).collect()))
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_collector_stream_goes_on_from_its_offset(spark, tmp_path):
    spark.range(20).coalesce(1).write.parquet(str(tmp_path / "t"))
    made = []
    for _ in range(3):
        stream = spark.readStream.format("collected").options(**collected(spark, tmp_path / "t")).load()
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        made.append(sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()))
        n = len(made[-1])
        spark.range(n, n + 15).coalesce(1).write.parquet(str(tmp_path / "next" / str(n)))
        for file in (tmp_path / "next" / str(n)).glob("part-*"):
            file.rename(tmp_path / "t" / f"z{n:05d}.parquet")  # comes after what was there
    assert made == [list(range(20)), list(range(35)), list(range(50))]


SIGNALS = "signal_id long, us long, seq long, source string, a double, b double"


def signals(spark, seed=4, n=160):
    rng, at, rows = random.Random(seed), 1_700_000_000_000_000, []
    for k in range(n):
        at += rng.choice([0, 1, 400_000, 90_000_000])
        rows.append((k, at, k, rng.choice(["x", "x", "y", None]), rng.choice([None, 0.0, *map(float, range(40, 60))]), float(rng.randrange(5))))
    return spark.createDataFrame(rows, SIGNALS).withColumn("ts", F.timestamp_micros("us"))


def folder_stream(spark, df, path, batches, shuffle):
    """df as files that a stream takes one at a time, rows out of order within the delay."""
    rows = sorted(df.collect(), key=lambda r: r.us // 60_000_000 * 10**9 + random.Random(r.seq).randrange(10**9) if shuffle else r.seq)
    step = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * step : (k + 1) * step], df.schema).coalesce(1).write.parquet(str(path / f"b{k}"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path / "b*"))


@pytest.mark.parametrize(("batches", "shuffle"), [(1, False), (4, True)])
def test_streams_with_state_give_the_batch_rows(spark, tmp_path, batches, shuffle):
    from pyspark.sql import Window
    from tamis.operators import agents

    df = signals(spark)
    flat = df.withColumn("label", F.lit("")).withColumn("content_text", F.lit(""))
    ordered = flat.withColumn("seq", F.row_number().over(Window.orderBy("us", "seq")))
    want = {r.signal_id for r in ordered.withColumn("d", agents.trend(("a", "b"), "source", 3, 300).decide(ordered, F.lit(True))).where("d is not null").collect()}
    stream = folder_stream(spark, df, tmp_path, batches, shuffle)
    got = [r.signal_id for r in stateful.trends(stream, "source", ["a", "b"], 3, 300, "2 minutes", str(tmp_path / "out"), end="2100-01-01").collect()]
    assert sorted(got) == sorted(want) and want
    w = Window.partitionBy("source").orderBy("us").rangeBetween(-(300_000_000 - 1), 0)
    want = {r.signal_id for r in df.where("source is not null").withColumn("n", F.count("*").over(w)).where("n > 5").collect()}
    got = [r.signal_id for r in stateful.floods(stream, ["source"], 5, 300, "2 minutes", str(tmp_path / "out2"), end="2100-01-01").collect()]
    assert sorted(got) == sorted(want) and want


def test_stream_with_state_starts_again_where_it_stopped(spark, tmp_path):
    df = signals(spark, 9)
    half = df.where("seq < 80")
    stream = folder_stream(spark, half, tmp_path, 2, True)
    first = {r.signal_id for r in stateful.floods(stream, ["source"], 5, 300, "2 minutes", str(tmp_path / "out")).collect()}
    spark.createDataFrame(df.where("seq >= 80").collect(), df.schema).coalesce(1).write.parquet(str(tmp_path / "b9"))
    got = [r.signal_id for r in stateful.floods(stream, ["source"], 5, 300, "2 minutes", str(tmp_path / "out"), end="2100-01-01").collect()]
    alone = [r.signal_id for r in stateful.floods(stream, ["source"], 5, 300, "2 minutes", str(tmp_path / "out3"), end="2100-01-01").collect()]
    assert sorted(got) == sorted(alone) and first < set(got)


@pytest.mark.parametrize("batches", [1, 3])
def test_anchored_streams_hold_a_state_for_each_bucket(spark, tmp_path, monkeypatch, batches):
    """Rows of a walk, null and hot keys, a job that goes on, rows of one time and without one; few states for many keys."""
    monkeypatch.setattr(stateful, "_HELD", 50)
    rng, at, rows = random.Random(6), 1_700_000_000_000_000, []
    for k in range(600):
        at += rng.choice([0, 1, 400_000, 9_000_000])
        rows.append((k + 2**60, at, k, rng.choice(["hot", None, *(f"s{j}" for j in range(40))]), rng.choice(["a", "b", None]), 0.0))
    df = spark.createDataFrame(rows, SIGNALS.replace("a double", "a string")).withColumn("ts", F.timestamp_micros("us"))
    opened, want = {}, set()
    for i, us, _, *key, _ in rows:
        key = tuple(key)
        if key != (None, None) and (key not in opened or us - opened[key] >= 300_000_000):
            opened[key] = us
            want.add(i)
    half = df.where("seq < 300")
    stream = folder_stream(spark, half.unionByName(half.limit(1).selectExpr("signal_id - 1 AS signal_id", "CAST(NULL AS LONG) AS us", "-1L AS seq", "'hot' AS source", "a", "b", "ts")) if batches == 1 else half, tmp_path, batches, batches > 1)
    run = lambda end=None: {r.signal_id for r in stateful.anchored(stream, ["source", "a"], 300, "2 minutes", str(tmp_path / "out"), end, buckets=6).collect()}
    first = run()
    held = [spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "out" / "checkpoint")).count() for name in ("anchors", "timer")]
    assert all(0 < n <= 6 for n in held)
    spark.createDataFrame(df.where("seq >= 300").collect(), df.schema).coalesce(1).write.parquet(str(tmp_path / "b9"))
    assert run("2100-01-01") == want and first < want


def test_ledger_runs_its_rows_once_and_leaves_nothing_behind(spark, tmp_path):
    """A batch's rows are worked out once however many keys are there already, in blocks of any size; a dead job's files go."""
    ledger, runs = Ledger(spark, str(tmp_path / "l"), "k", buckets=4), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(len(batch))
            yield batch

    rows = lambda lo, hi: spark.range(lo, hi).mapInPandas(counted, "id long").selectExpr("concat('k', id) AS k", "id AS v")
    assert ledger.append(rows(0, 300), 0) == 300 and runs.value == 300
    ledger.prepare(rows(300, 400), 1)  # killed before the commit
    assert ledger.append(rows(200, 400), 1) == 100 and runs.value == 600
    stores._LOOKED_UP, before = 7, stores._LOOKED_UP
    try:
        assert ledger.append(rows(100, 450), 2) == 50
    finally:
        stores._LOOKED_UP = before
    assert sorted(r.v for r in ledger.read().collect()) == list(range(450))
    assert len(list((tmp_path / "l" / "data").iterdir())) == 6  # of each batch its rows and its filters
