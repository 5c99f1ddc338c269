"""The stateful agents on streams: event time, watermarks and keyed state.

A stream is read from a folder of Parquet files; available() runs what is there and stops, start with a processing-time
trigger for a service. Tables and checkpoints lie in the folder that spark.checkpoint.dir names.
"""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators import memory
from tamis.operators.stores import UpsertTable
from tamis.operators.tables import shared_folder
from tamis.sources.adapters import EVENT_COLUMNS, K, content_text


def signals(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """The events at a path (a folder or one file) as a stream of signals; at most so many files a batch."""
    schema = spark.read.parquet(path).schema
    # a stream takes a single file only by a pattern
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("k", F.expr(K))
    flat = events.selectExpr(*(f"{sql} AS {name}" for name, sql in EVENT_COLUMNS.items()))
    return flat.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts")).withColumn("content_text", content_text("message", "cpu_percent"))


def available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into a table of its own, and reads that."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start(f"{path}/table").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def deduplicated(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """The first signal of a key within a delay; state goes once the watermark is past it."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def flood_counts(stream: DataFrame, window: str, slide: str, delay: str, most: int) -> DataFrame:
    """Windows in which a type, source and namespace repeat more than `most` times."""
    counts = stream.withWatermark("ts", delay).groupBy(F.window("ts", window, slide), "signal_type", "source", "namespace").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > most).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "signal_type", "source", "namespace", "n")


def sessions(stream: DataFrame, gap: str, delay: str, *by: str) -> DataFrame:
    found = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), *by).agg(F.count("*").alias("members"), F.size(F.collect_set("signal_type")).alias("types"))
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "members", "types")


def remember(stream: DataFrame, normalized: list[str], kept: list[str], path: str | None = None, buckets: int = 16) -> DataFrame:
    """Memories of a stream: each batch's are formed and merged into a table by content hash.

    The table lies in buckets under path: a batch writes those it has memories of, one that is run again is left out by its
    number, and a job that starts again at the same path goes on where it stopped (None: a path of its own). Before the
    first batch the table is empty.
    """
    spark = stream.sparkSession
    path = path or f"{shared_folder(spark)}/streams/memories-{uuid.uuid4().hex}"
    empty = memory.form(spark.createDataFrame([], stream.schema), normalized, kept)
    table = UpsertTable(spark, f"{path}/memories", "content_hash", memory.united, buckets)

    def merge(batch: DataFrame, number: int) -> None:
        table.upsert(memory.form(batch, normalized, kept), number)

    job = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    job.start().awaitTermination()
    found = table.read()
    return empty if found is None else found
