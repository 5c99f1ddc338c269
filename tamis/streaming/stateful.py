"""Agents with state of their own for each key, on streams: list and map state in RocksDB, timers in event time.

What comes is held until the watermark has passed it, and then looked at in order of time and number. So the rows don't
depend on how a stream is cut into batches, nor on rows that come out of order within the delay, and are those of the batch
form. A key's state goes by a timer once nothing that may still come could look back at it. A key is one state on one task;
anchored windows hold a bucket of keys in one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tamis.operators.tables import shared_folder

PARTS = "spark.sql.shuffle.partitions"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Rows of a key in order of (us, seq), each once the watermark has passed it.

    Subclasses keep state of their own and implement look (rows that are due, in order; gives the signal_ids to report) and
    forget (microseconds after the last row at which the key's state can go).
    """

    def __init__(self, fields: list[str]):
        self.fields = fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        values = "".join(f", f{k} double" for k in range(len(self.fields)))
        self.pending = handle.getListState("pending", f"us bigint, seq bigint, signal_id bigint{values}")
        self.last = handle.getValueState("last", "us bigint")
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came: list[tuple] = []
        for part in rows:
            kept = part.loc[part["signal_id"].notna(), ["us", "seq", "signal_id", *self.fields]]  # others are marks
            kept = kept.astype({c: "int64" for c in ("us", "seq", "signal_id")})
            came += [tuple(None if x != x else x for x in row) for row in kept.astype(object).itertuples(index=False, name=None)]
        if came:
            self.pending.appendList(came)
            self.handle.registerTimer(self._due(min(r[0] for r in came)))
        yield pd.DataFrame({"signal_id": pd.Series([], dtype="int64"), "us": pd.Series([], dtype="int64")})

    @staticmethod
    def _due(us: int) -> int:
        return -(-us // 1000)  # the first millisecond by which it has passed

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.pending.get()) if self.pending.exists() else []
        due, later = [r for r in held if r[0] <= passed], [r for r in held if r[0] > passed]
        found = self.look(due) if due else []
        if due:
            self.last.update((due[-1][0],))
            if later:
                self.pending.put(later)
            else:
                self.pending.clear()
        if later:
            self.handle.registerTimer(self._due(later[0][0]))
        elif self.last.exists():
            ends = self._due(self.last.get()[0] + self.forget())
            if ends <= timerValues.getCurrentWatermarkInMs():
                self.drop()
                self.last.clear()
            else:
                self.handle.registerTimer(ends)
        yield pd.DataFrame(found, columns=["signal_id", "us"]).astype({"signal_id": "int64", "us": "int64"})

    def close(self) -> None:
        pass


class Trend(InOrder):
    """The last of `readings` readings of which a field rises or falls throughout, by 5 % in all; else the last of four, or
    of one more than `readings`, of which a field turns back each time. Readings of `seconds` before or more don't count."""

    def __init__(self, fields: list[str], readings: int, seconds: int):
        super().__init__(fields)
        self.readings, self.turns, self.width = readings, max(readings + 1, 4), seconds * 1_000_000

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getListState("readings", "us bigint" + "".join(f", f{k} double" for k in range(len(self.fields))))

    def look(self, due: list[tuple]) -> list[tuple]:
        before = [tuple(r) for r in self.before.get()] if self.before.exists() else []
        found = []
        for us, _, signal, *values in due:
            if all(v is None for v in values):
                continue
            before = [*before, (us, *values)][-self.turns :]
            fresh = [r if us - r[0] < self.width else None for r in before]
            if any(self._moves([r and r[k + 1] for r in fresh]) for k in range(len(values))):
                found.append((signal, us))
        if before:
            self.before.put(before)
        return found

    def _moves(self, v: list) -> bool:
        last = v[-self.readings :]
        if len(last) == self.readings and None not in last:
            steps = [b - a for a, b in zip(last, last[1:], strict=False)]
            if (all(s > 0 for s in steps) or all(s < 0 for s in steps)) and (last[0] == 0 or abs((last[-1] - last[0]) / last[0]) * 100 >= 5):
                return True
        last = v[-self.turns :]
        if len(last) == self.turns and None not in last:
            steps = [b - a for a, b in zip(last, last[1:], strict=False)]
            return all(a * b < 0 for a, b in zip(steps, steps[1:], strict=False))
        return False

    def forget(self) -> int:
        return self.width

    def drop(self) -> None:
        self.before.clear()


class Flood(InOrder):
    """What exceeds `most` rows of its key within `seconds` up to it, rows of the same time included."""

    def __init__(self, most: int, seconds: int):
        super().__init__([])
        self.most, self.width = most, seconds * 1_000_000

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "us bigint", "n bigint")

    def look(self, due: list[tuple]) -> list[tuple]:
        held = {k[0]: v[0] for k, v in self.counts.iterator()} if self.counts.exists() else {}
        new: dict[int, int] = {}
        for us, *_ in due:
            new[us] = new.get(us, 0) + 1
        times, found, start, total = sorted({**held, **new}), [], 0, 0
        signals: dict[int, list[int]] = {}
        for us, _, signal in due:
            signals.setdefault(us, []).append(signal)
        for us in times:
            total += held.get(us, 0) + new.get(us, 0)
            while us - times[start] >= self.width:
                total -= held.get(times[start], 0) + new.get(times[start], 0)
                start += 1
            if total > self.most:
                found += [(s, us) for s in signals.get(us, [])]
        for us in times[:start]:
            if us in held:
                self.counts.removeKey((us,))
        for us in new:
            if us >= times[start]:
                self.counts.updateValue((us,), (held.get(us, 0) + new[us],))
        return found

    def forget(self) -> int:
        return self.width

    def drop(self) -> None:
        self.counts.clear()


class Anchored(StatefulProcessor):
    """The first row of each window of `seconds` that opens with the first row no earlier window holds.

    Keys (`key`) come dealt to buckets, of which each is one state: rows that wait and the anchors of its keys as Arrow
    tables, and one timer. So what a state costs is paid for each bucket and batch, not for each key. An anchor goes once
    the watermark is past its window.
    """

    ROWS = ("key", "us", "seq", "signal_id")

    def __init__(self, seconds: int):
        self.width = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "rows binary")
        self.anchors = handle.getValueState("anchors", "rows binary")
        self.timer = handle.getValueState("timer", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, held, size = None, [], 0
        for part in rows:
            kept = part.loc[part["signal_id"].notna(), list(self.ROWS)]  # others are marks
            if len(kept):
                first = min(int(kept["us"].min()), first if first is not None else int(kept["us"].min()))
                held.append(kept)
                size += len(kept)
            if size >= _HELD:
                self.pending.appendValue((_packed(pd.concat(held)),))
                held, size = [], 0
        if held:
            self.pending.appendValue((_packed(pd.concat(held)),))
        if first is not None:
            self._wake(InOrder._due(first))
        yield _NONE

    def _wake(self, ms: int) -> None:
        """Has the bucket looked at by then: its one timer is the earliest."""
        at = self.timer.get()[0] if self.timer.exists() else None
        if at is None or ms < at:
            if at is not None:
                self.handle.deleteTimer(at)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        held = [_unpacked(r[0]) for r in self.pending.get()] if self.pending.exists() else []
        rows = pd.concat(held) if held else pd.DataFrame({c: [] for c in self.ROWS})
        due, later = rows[rows["us"] <= passed], rows[rows["us"] > passed]
        known = _unpacked(self.anchors.get()[0]) if self.anchors.exists() else pd.DataFrame({"key": [], "us": []})
        anchors = dict(zip(known["key"], known["us"].tolist(), strict=True))
        found = self.look(due, anchors)
        anchors = {k: us for k, us in anchors.items() if us + self.width > passed}
        if len(due):
            if len(later):
                self.pending.put([(_packed(later.iloc[at : at + _HELD]),) for at in range(0, len(later), _HELD)])
            else:
                self.pending.clear()
        if anchors:
            self.anchors.update((_packed(pd.DataFrame({"key": list(anchors), "us": list(anchors.values())})),))
        else:
            self.anchors.clear()
        if len(later) or anchors:
            ends = max(anchors.values()) + self.width if anchors else None
            self._wake(InOrder._due(int(later["us"].min()) if len(later) else ends))
        yield pd.DataFrame(found, columns=["signal_id", "us"]).astype({"signal_id": "int64", "us": "int64"}) if found else _NONE

    def look(self, due: pd.DataFrame, anchors: dict) -> list[tuple]:
        """The rows that open windows after the anchors of their keys, which move along."""
        found, width = [], self.width
        codes, names = pd.factorize(due["key"])
        us, seq, signal = (due[c].to_numpy("int64") for c in ("us", "seq", "signal_id"))
        order = np.lexsort((signal, seq, us, codes))
        last, anchor = -1, None
        for code, at, row in zip(codes[order].tolist(), us[order].tolist(), signal[order].tolist(), strict=True):
            if code != last:
                if last >= 0:
                    anchors[names[last]] = anchor
                last, anchor = code, anchors.get(names[code])
            if anchor is None or at - anchor >= width:
                anchor = at
                found.append((row, at))
        if last >= 0:
            anchors[names[last]] = anchor
        return found

    def close(self) -> None:
        pass


#: Rows of one value in a bucket's state.
_HELD = 65_536
_NONE = pd.DataFrame({"signal_id": pd.Series([], dtype="int64"), "us": pd.Series([], dtype="int64")})


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(value: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(value)).read_all().to_pandas()


@contextmanager
def rocks(spark: SparkSession, **more: str):
    """Streams that start within it keep their state in RocksDB, and take the latest of their sources' watermarks."""
    wanted = {PROVIDER: ROCKS, "spark.sql.streaming.multipleWatermarkPolicy": "max", **more}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def closing(spark: SparkSession, like: DataFrame, folder: str) -> DataFrame:
    """A stream of the marks that close() writes to a folder: they only move the watermark."""
    empty = spark.createDataFrame([], like.schema)
    empty.write.mode("append").parquet(folder)
    return spark.readStream.schema(like.schema).parquet(folder)


def close(spark: SparkSession, like: DataFrame, folder: str, at: str) -> None:
    """Writes a row of nulls but for its time: once it is read, all that came before it is due."""
    row = [F.lit(at).cast("timestamp").alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema.fields]
    spark.range(1).select(*row).write.mode("append").parquet(folder)


def run(stream: DataFrame, keys: list[str], processor: StatefulProcessor, delay: str, path: str | None = None, end: str | None = None, tasks: int | None = None) -> DataFrame:
    """Runs a stream (ts, us, seq, signal_id, the keys and the processor's fields) over what is there: the signal_id and us
    that the processor reports.

    path: where its table and checkpoint lie; run again with it, it goes on where it stopped. end: a time after which nothing
    comes; what the watermark hasn't passed is looked at as well then, in a second run of the same job. None: it waits in
    state for what may come within `delay`. Rows without a signal_id are marks and no rows. tasks: the most that a new job's
    state is dealt to.
    """
    spark = stream.sparkSession
    path = path or f"{shared_folder(spark)}/streams/state-{uuid.uuid4().hex}"
    # a mark is due at once
    marks = closing(spark, stream, f"{path}/marks").withWatermark("ts", "0 seconds")
    both = stream.withWatermark("ts", delay).unionByName(marks)
    made = both.groupBy(*keys).transformWithStateInPandas(processor, "signal_id bigint, us bigint", "append", "EventTime")

    def go() -> None:
        job = made.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True)
        job.start(f"{path}/table").awaitTermination()

    parts = {} if tasks is None else {PARTS: str(min(tasks, int(spark.conf.get(PARTS))))}
    # what is due after the last rows is looked at with the rest
    with rocks(spark, **parts, **({} if end is None else {"spark.sql.streaming.noDataMicroBatches.enabled": "false"})):
        go()
    if end is not None:
        close(spark, stream, f"{path}/marks", end)
        with rocks(spark, **parts):
            go()
    return spark.read.schema(made.schema).parquet(f"{path}/table")


def trends(stream: DataFrame, key: str, fields: list[str], readings: int = 3, seconds: int = 3_600, delay: str = "1 hour", path: str | None = None, end: str | None = None) -> DataFrame:
    """Trends of a stream, as the trend agent finds them in a batch in order of time."""
    rows = stream.where(F.col(key).isNotNull() & F.coalesce(*fields).isNotNull()).select("ts", "us", "seq", "signal_id", key, *(F.col(f).cast("double").alias(f) for f in fields))
    return run(rows, [key], Trend(fields, readings, seconds), delay, path, end)


def floods(stream: DataFrame, keys: list[str], most: int = 3, seconds: int = 300, delay: str = "1 hour", path: str | None = None, end: str | None = None) -> DataFrame:
    """What floods: more than `most` of a key within a window that slides with each row."""
    rows = stream.where(F.coalesce(*keys).isNotNull()).select("ts", "us", "seq", "signal_id", *keys)
    return run(rows, keys, Flood(most, seconds), delay, path, end)


def anchored(stream: DataFrame, keys: list[str], seconds: int, delay: str = "1 hour", path: str | None = None, end: str | None = None, buckets: int = 256) -> DataFrame:
    """Signals that open a window of their key; rows without a time open none. Keys are dealt to `buckets`, of which each
    is one state: as many whenever a job goes on. A task has four buckets or more, as starting one costs more than a bucket."""
    key = F.to_json(F.struct(*keys))
    rows = stream.where(F.coalesce(*keys).isNotNull() & F.col("us").isNotNull()).select("ts", "us", "seq", "signal_id", key.alias("key"))
    return run(rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")), ["bucket"], Anchored(seconds), delay, path, end, max(1, buckets // 4))
