"""Tables that change without being rewritten, in a folder that all executors share.

A table is a row of numbered manifests; a manifest names the files that hold the table as of then. Files are written first,
under names of their own, and belong to the table from the moment their manifest is renamed to its number, which fails where
that number is taken. So a job that dies before that leaves files that nothing names, and the batch can be run again; one that
is run twice finds its number in the manifest and does nothing. One job writes a table at a time.

The folder's file system has to rename atomically and refuse to overwrite, as HDFS and local ones do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tamis.operators.tables import discard, written

_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession):
    """Within it, what an action has shuffled is deleted at its end, not once the driver collects its garbage."""
    before = spark.conf.get(_CLEANED, None)
    spark.conf.set(_CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANED) if before is None else spark.conf.set(_CLEANED, before)


class _Folder:
    """What the driver does in a folder: small files, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, name: str) -> list[str]:
        at = self._at(f"{self.path}/{name}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(f"{self.path}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Writes a file under its name at once and whole; False where the name is taken."""
        to, part = self._at(f"{self.path}/{name}"), self._at(f"{self.path}/{name}.{uuid.uuid4().hex}.part")
        stream = self._fs.create(part)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self._fs.exists(to) or not self._fs.rename(part, to):
            self._fs.delete(part, False)
            return False
        return True

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(f"{self.path}/{name}"), True)


class _Table:
    """Manifests m<number>.json under path/manifests: {"batch": the last batch, "schema": ..., and what kinds of tables add}."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.buckets, self.folder = spark, buckets, _Folder(spark, path)

    def manifest(self) -> dict:
        found = [n for n in self.folder.names("manifests") if n.endswith(".json")]
        return json.loads(self.folder.read(f"manifests/{found[-1]}")) if found else {"number": 0, "batch": None, "schema": None, "files": {}}

    def commit(self, manifest: dict) -> None:
        number = manifest["number"] + 1
        if not self.folder.put(f"manifests/m{number:012d}.json", json.dumps(manifest | {"number": number})):
            raise RuntimeError(f"another job has written version {number} of {self.folder.path}")

    def bucket(self, *key: str):
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, name: str, dealt: bool = False) -> list[int]:
        """rows by their column _bucket, a folder each; the buckets that have rows. dealt: they are dealt by it already."""
        (rows if dealt else rows.repartition("_bucket")).write.partitionBy("_bucket").parquet(f"{self.folder.path}/{name}")
        return sorted(int(n.split("=")[1]) for n in self.folder.names(name) if n.startswith("_bucket="))

    def read_files(self, files: list[str], schema: StructType) -> DataFrame:
        """The rows of some buckets' folders, with the columns of schema."""
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder.path}/{f}" for f in files))


class UpsertTable(_Table):
    """Rows by key, in buckets: a base each and the changes since. A batch writes the buckets it has rows of alone; a bucket
    with `most` changes is merged into a new base then.

    merge: of rows with equal keys in any number and order, one each; applied to its own results it has to give the same as
    to all rows at once (sums, least and greatest values, the row with the greatest of a column).
    """

    def __init__(self, spark: SparkSession, path: str, key: str, merge: Callable[[DataFrame], DataFrame], buckets: int = 64, most: int = 4):
        super().__init__(spark, path, buckets)
        self.key, self.merge, self.most = key, merge, most

    def upsert(self, rows: DataFrame, batch: int) -> list[int]:
        """Merges a batch, by its number; batches come in order, and one that has been merged is left out. The buckets that
        were written. Rows with a null key are one key; an empty batch is only noted."""
        now = self.manifest()
        if now["batch"] is not None and batch <= now["batch"]:
            return []
        schema = rows.schema if now["schema"] is None else StructType.fromJson(now["schema"])
        name = f"data/{batch:012d}-{uuid.uuid4().hex}"
        touched = self.write(self.merge(rows.select(*schema.names)).withColumn("_bucket", self.bucket(self.key)), name)
        files = {k: list(v) for k, v in now["files"].items()}
        for b in touched:
            files.setdefault(str(b), []).append(f"{name}/_bucket={b}")
        full = {b: f for b, f in files.items() if len(f) > self.most}
        if full:
            base = f"data/{batch:012d}-{uuid.uuid4().hex}-base"
            whole = self.merge(self.read_files([f for fs in full.values() for f in fs], schema))
            for b in self.write(whole.withColumn("_bucket", self.bucket(self.key)), base):
                files[str(b)] = [f"{base}/_bucket={b}"]
        self.commit(now | {"batch": batch, "schema": schema.jsonValue(), "files": files})
        return touched

    def read(self) -> DataFrame | None:
        """The table as of the last batch; None before the first."""
        now = self.manifest()
        if now["schema"] is None:
            return None
        return self.merge(self.read_files([f for fs in now["files"].values() for f in fs], StructType.fromJson(now["schema"])))


#: Bits that each key sets in a filter.
_PROBES = 4
#: Keys of a bucket that a task looks up at once, and bits that a filter has at most.
_LOOKED_UP, _MOST_BITS = 200_000, 1 << 26


def _bits(keys: pa.Array, size: int) -> np.ndarray:
    """Places in a filter of `size` bits, _PROBES for each key (a 64-bit hash)."""
    h = np.asarray(keys, np.int64).view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return ((low[:, None] + high[:, None] * np.arange(_PROBES, dtype=np.uint64)) % np.uint64(size)).astype(np.int64)


class Ledger(_Table):
    """Records that are added once each, by key, in batches that are committed whole or not at all.

    A batch's keys are checked against what is there: first against Bloom filters, one for each commit and bucket, and where
    a filter has all bits of a key, against that commit's own keys. So a batch of new records reads few of the old keys.
    size: bits of a filter; None for ten for each key of the commit's largest bucket.

    A batch is dealt to its buckets once, and what its keys are checked by is stored while it is needed; shuffled files go
    with the action that made them. Files of a job that died go when its batch is committed.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16, size: int | None = None):
        super().__init__(spark, path, buckets)
        self.key, self.size = key, size

    def append(self, rows: DataFrame, batch: int) -> int:
        """Adds the records of a batch whose key isn't there yet, the first of each key by all columns; how many there are.
        A batch that has been committed adds nothing. Records with a null key have none and go."""
        return self.commit_batch(self.prepare(rows, batch))

    def prepare(self, rows: DataFrame, batch: int) -> dict | None:
        """Writes a batch's files, which are no part of the ledger yet."""
        now = self.manifest()
        if now["batch"] is not None and batch <= now["batch"]:
            return None
        schema = rows.schema if now["schema"] is None else StructType.fromJson(now["schema"])
        others = [c for c in schema.names if c != self.key]
        with shuffles_go(self.spark):
            one = rows.where(F.col(self.key).isNotNull()).select(*schema.names, self.bucket(self.key).alias("_bucket")).repartition("_bucket")
            one = one.groupBy("_bucket", self.key).agg(F.min(F.struct(*others)).alias("_r")).select(self.key, "_r.*", "_bucket") if others else one.distinct()
            name = f"data/{batch:012d}-{uuid.uuid4().hex}"
            buckets = self.write(one.select(*schema.names, "_bucket"), name, dealt=True)
            held = self._keyed(name, buckets, schema)
            counts = self._counts(held)
            known, looked = self._known(held, now, counts)
            if known is not None:
                kept = f"{name}-new"
                buckets = self.write(held.drop("_h").join(known, self.key, "left_anti").select(*schema.names, "_bucket"), kept)
                self.folder.remove(name)
                discard(looked)
                name, held = kept, self._keyed(kept, buckets, schema)
                counts = self._counts(held)
            size = self.size or min(_MOST_BITS, max(1 << 10, 1 << (10 * max(counts.values(), default=1)).bit_length()))
            self._filters(held.select("_bucket", "_h"), size).write.parquet(f"{self.folder.path}/{name}-filters")
        return now | {"batch": batch, "schema": schema.jsonValue(), "files": now["files"] | {name: buckets}, "added": sum(counts.values())}

    def _keyed(self, name: str, buckets: list[int], schema: StructType) -> DataFrame:
        rows = self.read_files([f"{name}/_bucket={b}" for b in buckets], schema)
        return rows.withColumns({"_bucket": self.bucket(self.key), "_h": F.xxhash64(self.key, F.lit(1))})

    @staticmethod
    def _counts(held: DataFrame) -> dict[int, int]:
        return {r["_bucket"]: r["count"] for r in held.groupBy("_bucket").count().collect()}  # a row for each bucket

    def commit_batch(self, prepared: dict | None) -> int:
        if prepared is None:
            return 0
        added = prepared.pop("added")
        self.commit(prepared)
        for name in self.folder.names("data"):  # of jobs that died
            if name.startswith(f"{prepared['batch']:012d}-") and f"data/{name.removesuffix('-filters')}" not in prepared["files"]:
                self.folder.remove(f"data/{name}")
        return added

    def _filters(self, keys: DataFrame, size: int) -> DataFrame:
        """A filter for each bucket: the bits of its keys, as bytes."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                bucket, places = np.asarray(batch.column(0)), _bits(batch.column(1), size)
                for b in np.unique(bucket):
                    held.setdefault(int(b), np.zeros(size, bool))[places[bucket == b].ravel()] = True
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], ["_bucket", "bits"])

        def whole(rows: pd.DataFrame) -> pd.DataFrame:
            bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows["bits"]])
            return rows.head(1).assign(bits=[bits.tobytes()])

        shape = "_bucket int, bits binary"
        return keys.mapInArrow(part, shape).groupBy("_bucket").applyInPandas(whole, shape)

    def _known(self, new: DataFrame, now: dict, counts: dict[int, int]) -> tuple[DataFrame | None, DataFrame | None]:
        """Keys of a batch that earlier commits have, None if none; and the stored table that they are read by."""
        if not now["files"] or not counts:
            return None, None
        schema = "_bucket int, bits binary"
        filters = self.spark.read.schema(schema).parquet(*(f"{self.folder.path}/{n}-filters" for n in now["files"]))
        filters = filters.withColumn("name", F.regexp_extract(F.input_file_name(), r"data/([^/]+)-filters/", 1))
        shares = -(-max(counts.values()) // _LOOKED_UP)

        def test(keys: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            out = []
            for name, bits in zip(held["name"], held["bits"], strict=True):
                bits = np.frombuffer(bits, np.uint8)
                places = _bits(pa.array(keys["_h"]), 8 * len(bits))
                hit = (bits[places >> 3] >> (7 - (places & 7)) & 1).all(1)
                out.append(keys.loc[hit, [key, "_bucket"]].assign(name=name))
            return pd.concat(out) if out else keys.head(0)[[key, "_bucket"]].assign(name="")

        key, kind = self.key, dict(new.dtypes)[self.key]
        asked = new.select(key, "_bucket", "_h", F.pmod(F.xxhash64("_h"), F.lit(shares)).cast("int").alias("_share"))
        filters = filters.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        by = ("_bucket", "_share")
        maybe = written(asked.groupBy(*by).cogroup(filters.groupBy(*by)).applyInPandas(test, f"`{key}` {kind}, _bucket int, name string"), "maybe")
        read = {(r.name, r._bucket) for r in maybe.select("name", "_bucket").distinct().collect()}  # commits and buckets to look into
        if not read:
            discard(maybe)
            return None, None
        held = self.read_files([f"data/{n}/_bucket={b}" for n, b in sorted(read)], StructType([f for f in new.schema if f.name == key]))
        return held.join(maybe.select(key), key, "left_semi"), maybe

    def read(self) -> DataFrame | None:
        """All records; None before the first commit."""
        now = self.manifest()
        if now["schema"] is None:
            return None
        return self.read_files([f"{n}/_bucket={b}" for n, buckets in now["files"].items() for b in buckets], StructType.fromJson(now["schema"]))
