"""Files of source records, and sinks."""

import json

from pyspark.sql import functions as F

from tamis.sources import mappings, readers


def test_transactions_are_typed(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,amount,is_recurring,velocity_1h,merchant\n1,12.5,Yes,3,shop\n2,oops,,x,\n")
    rows = readers.transactions_csv(spark, str(tmp_path / "t.csv")).orderBy("id").collect()
    assert (rows[0].amount, rows[0].is_recurring, rows[0].velocity_1h, rows[0].country) == (12.5, True, 3, None)
    assert (rows[1].amount, rows[1].is_recurring, rows[1].velocity_1h, rows[1].merchant) == (None, None, None, None)


def test_json_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    (tmp_path / "b.json").write_text(json.dumps({"transactions": [{"x": 3}, {"x": 4}]}))
    (tmp_path / "c.jsonl").write_text('{"x": 5}\nnot json\n{"x": 6}\n')
    (tmp_path / "m1.json").write_text(json.dumps({"matrix": [{"model": "a", "v": 1}]}))
    assert [r.x for r in readers.json_records(spark, str(tmp_path / "a.json")).collect()] == [1, 2]
    assert [r.x for r in readers.json_records(spark, str(tmp_path / "b.json"), "transactions").collect()] == [3, 4]
    assert [r.x for r in readers.json_lines(spark, str(tmp_path / "c.jsonl"), "x int").collect()] == [5, 6]
    assert [tuple(r) for r in readers.matrix_results(spark, str(tmp_path / "m*.json")).collect()] == [("m1.json", "a", 1)]


def test_metrics_text(spark, tmp_path):
    (tmp_path / "m.txt").write_text('# HELP x\nup 1\nslots{cluster="a",zone="b"} 12.5\nbad value\n\n')
    rows = {r.name: (r.labels, r.value) for r in readers.metrics_text(spark, str(tmp_path / "m.txt")).collect()}
    assert rows == {"up": ({}, 1.0), "slots": ({"cluster": "a", "zone": "b"}, 12.5)}


def test_markdown_sections(spark, tmp_path):
    (tmp_path / "n.md").write_text("---\nname: x\n---\nintro\n## One\nbody one\n## Two\nbody two\n")
    assert [(r.title, r.body) for r in readers.markdown_sections(spark, str(tmp_path / "n.md")).orderBy("pos").collect()] == [("", "intro"), ("One", "body one"), ("Two", "body two")]


def test_state_is_read_back_only_if_its_form_is_known(spark, tmp_path):
    state = {"rules": spark.createDataFrame([("a", 1)], "name string, n int")}
    readers.save_state(state, str(tmp_path / "s"))
    assert readers.load_state(spark, str(tmp_path / "s"), ["rules"])["rules"].collect() == state["rules"].collect()
    readers.save_state(state, str(tmp_path / "s"), version=1)
    assert readers.load_state(spark, str(tmp_path / "s"), ["rules"]) is None


def test_names_and_polls(spark):
    df = spark.createDataFrame([("prod-a",), ("prod-test",), ("dev",)], "ns string")
    assert [r.ns for r in df.where(readers.allowed(F.col("ns"), ["prod-*"], ["*-test"])).collect()] == ["prod-a"]
    now, before = spark.createDataFrame([("a",), ("b",)], "f string"), spark.createDataFrame([("a",)], "f string")
    assert [r.f for r in readers.new_rows(now, before, "f").collect()] == ["b"]
    log = spark.createDataFrame([(k,) for k in range(5)], "seq int")
    assert sorted(r.seq for r in readers.append_latest(log, spark.createDataFrame([(9,)], "seq int"), "seq", 3).collect()) == [3, 4, 9]


def test_claims_and_alerts(spark):
    df = spark.createDataFrame([("provision-failed", "started"), ("started", "started"), ("stopping", "started"), ("", "started")], "current_state string, desired_state string")
    assert [(r.signal_type, r.severity) for r in mappings.claims(df).collect()] == [("claim_provision_failed", "high"), ("claim_stopping", "medium")]
    levels = spark.createDataFrame([("warning",), ("none",), (None,), ("critical",)], "severity string")
    assert [r.severity for r in mappings.alerts(levels).collect()] == ["medium", "info", "info", "critical"]


def test_slices_of_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": k, "name": f"n{k}"} for k in range(10)]))
    (tmp_path / "b.json").write_text(json.dumps({"rows": [{"id": k} for k in range(10)]}))
    assert [r.id for r in readers.array_slice(spark, str(tmp_path / "a.json"), 3, 2).collect()] == [3, 4]
    assert [r.id for r in readers.array_slice(spark, str(tmp_path / "b.json"), 8, 5, "rows").collect()] == [8, 9]


def test_front_matter_of_notes(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nname: First\ntype: feedback\nname: again\n---\nBody here\n")
    (tmp_path / "b.md").write_text("No front matter\n---\nkey: value\n")
    rows = sorted(readers.front_matter(spark, str(tmp_path)).collect(), key=lambda r: r.file)
    assert rows[0].fields == {"name": "First", "type": "feedback"} and rows[0].body == "Body here\n"
    assert rows[1].fields == {} and rows[1].body.startswith("No front")


def test_items_of_cluster_lists(spark, tmp_path):
    pods = [{"metadata": {"name": f"p{k}", "namespace": "a" if k < 3 else "b"}, "status": {"phase": "Running", "containerStatuses": [{"restartCount": k, "state": {"waiting": {"reason": "CrashLoopBackOff"}} if k == 4 else {}}, {"restartCount": 1, "state": {}}]}} for k in range(5)]
    (tmp_path / "pods.json").write_text(json.dumps({"items": pods}))
    nodes = [{"metadata": {"name": "n"}, "status": {"conditions": [{"type": "Ready", "status": "False"}, {"type": "DiskPressure", "status": "True"}]}}]
    (tmp_path / "nodes.json").write_text(json.dumps({"items": nodes}))
    rows = {r.name: r for r in mappings.kubernetes(readers.cluster_items(spark, str(tmp_path / "pods.json"), "pods")).collect()}
    assert rows["p4"].signal_type == "pod_crashloop" and rows["p4"].restarts == 5 and rows["p1"].signal_type == "pod_running"
    assert readers.cluster_items(spark, str(tmp_path / "pods.json"), "pods", 2).count() == 4
    assert [r.signal_type for r in mappings.kubernetes(readers.cluster_items(spark, str(tmp_path / "nodes.json"), "nodes")).collect()] == ["node_notready"]


def test_run_and_replay(spark, tmp_path):
    from tamis import cli

    rows = [(k, k, f"2026-01-01T00:00:{k:02d}Z", "pod_restart" if k % 2 else "odd", "info" if k % 3 else "unheard", "s", "m") for k in range(12)]
    spark.createDataFrame(rows, "signal_id long, seq long, ts string, signal_type string, severity string, source string, message string").write.json(str(tmp_path / "in"))
    cli.main(["run", str(tmp_path / "in"), str(tmp_path / "out"), "--format", "json"])
    whole = spark.read.parquet(str(tmp_path / "out/summary")).first()
    assert whole.total == 12 and whole.remaining == spark.read.parquet(str(tmp_path / "out/survivors")).count()
    cli.main(["replay", str(tmp_path / "in"), str(tmp_path / "out"), "--format", "json", "--slices", "3"])
    assert sorted(r.total for r in spark.read.parquet(str(tmp_path / "out/summaries")).collect()) == [4, 4, 4]


def derby(spark, name, statements):
    """An in-memory database of the JVM that the session runs in."""
    url = f"jdbc:derby:memory:{name};create=true"
    spark._jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    at = spark._jvm.java.sql.DriverManager.getConnection(url)
    for text in statements:
        at.createStatement().execute(text)
    at.close()
    return url


def test_database_table_is_read_by_ranges_of_its_key(spark):
    n = 100_000
    url = derby(spark, "jobs", ["CREATE TABLE JOBS (ID BIGINT, NAME VARCHAR(20), STATUS VARCHAR(10))"])
    rows = spark.range(n).selectExpr("id * 3 AS ID", "concat('job', id) AS NAME", "CASE WHEN id % 10 = 0 THEN 'failed' ELSE 'ok' END AS STATUS")
    rows.coalesce(2).write.mode("append").option("batchsize", 10_000).jdbc(url, "JOBS")
    every = readers.table_after(spark, url, "JOBS", "ID", rows=10_000)
    assert every.rdd.getNumPartitions() == 10 and every.count() == n
    sizes = [r["count"] for r in every.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 10_001
    failed = every.where("STATUS = 'failed'").select("ID")
    plan = failed._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(STATUS,failed)" in plan.replace("*", "") and "NAME" not in plan.split("ReadSchema")[1]
    assert failed.count() == n // 10
    # a poll goes on where the one before stopped
    page = readers.table_after(spark, url, "JOBS", "ID", 299_000, most=50, rows=20)
    mark = readers.last_key(page, "ID", 299_000)
    assert [r.ID for r in page.orderBy("ID").collect()] == list(range(299_001, 299_150, 3)) and mark == 299_148
    rest = readers.table_after(spark, url, "JOBS", "ID", mark)
    assert rest.count() == (n * 3 - 3 - mark) // 3
    end = readers.last_key(rest, "ID", mark)
    assert readers.table_after(spark, url, "JOBS", "ID", end).count() == 0 and readers.last_key(rest.limit(0), "ID", end) == end
    derby(spark, "jobs", ["INSERT INTO JOBS VALUES (300001, 'late', 'ok'), (NULL, 'none', 'ok')"])
    assert [tuple(r) for r in readers.table_after(spark, url, "JOBS", "ID", end).collect()] == [(300_001, "late", "ok")]
