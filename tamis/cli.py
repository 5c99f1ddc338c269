"""Runs the cascade over files of signals: python -m tamis.cli run INPUT OUTPUT [--format json] [--slices N].

INPUT holds signals (signal_id, seq, ts, signal_type, severity, source, namespace, cluster, label, message and fields) as
Parquet or JSON lines. OUTPUT gets decisions, survivors and summary as Parquet; with --slices, a summary for each of N
stretches of equal width in time, as a replay would meet them.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators import pipeline
from tamis.sources.adapters import content_text, normal_severity

TEXTS = ("signal_type", "severity", "source", "namespace", "cluster", "label", "message")


def read_signals(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Signals with every column that the cascade reads; missing texts are empty, unknown severities medium."""
    rows = spark.read.format(form).load(path)
    for name in TEXTS:
        rows = rows.withColumn(name, F.coalesce(F.col(name).cast("string"), F.lit("")) if name in rows.columns else F.lit(""))
    for name in ("cpu_percent", "latency_ms"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("double"))
    rows = rows.withColumn("severity", normal_severity()).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.withColumn("content_text", content_text("message", "cpu_percent"))


def replay(signals: DataFrame, slices: int) -> DataFrame:
    """A summary for each of so many stretches of time, each run on its own; stretches without signals have none."""
    ends = signals.agg(F.min("us").alias("lo"), F.max("us").alias("hi")).first()
    if ends is None or ends.lo is None:
        return pipeline.summary(pipeline.annotate(signals)).withColumn("slice", F.lit(0)).limit(0)
    width = max(1, -(-(ends.hi - ends.lo + 1) // slices))
    out = None
    for k in range(slices):
        part = signals.where((F.col("us") >= ends.lo + k * width) & (F.col("us") < ends.lo + (k + 1) * width))
        made = pipeline.summary(pipeline.annotate(part)).where("total > 0").withColumn("slice", F.lit(k))
        out = made if out is None else out.unionByName(made)
    return out


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tamis", description=__doc__.splitlines()[0])
    parser.add_argument("command", choices=("run", "replay"))
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--format", default="parquet", choices=("parquet", "json"))
    parser.add_argument("--slices", type=int, default=4, help="stretches of time of a replay")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("tamis").getOrCreate()
    signals = read_signals(spark, given.input, given.format)
    if given.command == "replay":
        replay(signals, given.slices).write.mode("overwrite").parquet(f"{given.output}/summaries")
        return
    annotated = pipeline.annotate(signals)
    pipeline.decisions(annotated).write.mode("overwrite").parquet(f"{given.output}/decisions")
    pipeline.survivors(annotated).write.mode("overwrite").parquet(f"{given.output}/survivors")
    pipeline.summary(annotated).write.mode("overwrite").parquet(f"{given.output}/summary")


if __name__ == "__main__":
    main()
