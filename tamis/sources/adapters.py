"""Source records as signals: one schema for every kind of event.

A signal has signal_id, seq (a total order), ts, signal_type, severity, source, namespace, cluster, content (text by field),
features (number by field), content_text (what text patterns search: fields and values) and labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.schema import SEVERITIES

#: The events table as signals, as SQL that Spark and DuckDB both read; k is the number in props.
EVENT_COLUMNS = {
    "signal_id": "event_id",
    "seq": "event_id",
    "ts": "ts",
    "signal_type": "CASE event_type WHEN 'view' THEN 'probe_failure' WHEN 'error' THEN 'pod_crashloop' WHEN 'signup' THEN 'event_unhealthy' WHEN 'click' THEN 'heartbeat' ELSE 'txn_purchase' END",
    "severity": "CASE WHEN event_type = 'click' THEN CASE WHEN value < 200 THEN 'low' ELSE 'medium' END WHEN value < 15 THEN 'info' WHEN value < 35 THEN 'low' WHEN value < 70 THEN 'medium' WHEN value < 150 THEN 'high' ELSE 'critical' END",
    "source": "concat('user_', CAST(user_id AS STRING))",
    "namespace": "concat('ns_', CAST(user_id % 10 AS STRING))",
    "cluster": "concat('c', CAST(user_id % 3 AS STRING))",
    "message": "CASE k % 10 WHEN 0 THEN 'container OOMKilled' WHEN 1 THEN 'disk full on volume' WHEN 2 THEN 'cpu throttling' WHEN 3 THEN 'connection refused' WHEN 4 THEN 'crashloop backoff' WHEN 5 THEN '403 forbidden' WHEN 6 THEN 'hpa max replicas' WHEN 7 THEN 'data loss suspected' WHEN 8 THEN 'kernel panic' ELSE 'heartbeat ok' END",
    "label": "CASE WHEN k % 25 = 0 THEN 'compliance' WHEN k % 25 = 1 THEN 'fraud' ELSE '' END",
    "cpu_percent": "CAST(k AS DOUBLE)",
    "latency_ms": "value",
    "answer": "CASE WHEN event_type = 'click' THEN 'routine_noise' WHEN event_type = 'view' THEN CASE WHEN k = 7 THEN 'real_incident' ELSE 'known_pattern' END WHEN event_type = 'signup' THEN CASE WHEN user_id % 10 < 4 THEN 'routine_noise' ELSE 'needs_attention' END WHEN value < 35 THEN 'routine_noise' ELSE 'real_incident' END",
}
K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
#: The same for DuckDB, as a common table expression.
SIGNALS_SQL = "signals AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in EVENT_COLUMNS.items()) + f", epoch_us(ts) AS us FROM (SELECT *, {K} AS k FROM events))"
SIGNALS_SQL = SIGNALS_SQL.replace("AS STRING", "AS VARCHAR")


def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as flat signals; us is the time in microseconds, content_text what text patterns search."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.expr(K))
    flat = events.selectExpr(*(f"{sql} AS {name}" for name, sql in EVENT_COLUMNS.items()))
    return flat.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("content_text", content_text("message", "cpu_percent"))


def content_text(*fields: str) -> Column:
    """Fields and their values in one text, as text patterns search them."""
    return F.concat_ws(", ", *(F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields))


def normal_severity(severity: str = "severity") -> Column:
    """Unknown and missing severities count as medium."""
    return F.when(F.col(severity).isin(*SEVERITIES), F.col(severity)).otherwise("medium")


def severity_rank(severity: str = "severity") -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(severity)) - 1


def first_of(columns: dict[str, Column]) -> Column:
    """name=value of the first column with a value: the key of the thing that a reading is about."""
    return F.coalesce(*(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{n}="), c)) for n, c in columns.items()))


def seconds_of(text: str) -> Column:
    """An ISO time as seconds since 1970 (UTC where it names no zone); 0 where it is none, so that such rows come first."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(F.col(text))) / 1_000_000, F.lit(0.0))
