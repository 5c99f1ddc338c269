"""What several operators share: words and hashes over Arrow buffers, tables in the shared folder, components."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that separate words: space and 0x09 to 0x0D.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are taken through numpy in runs of about this many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 20


# ---------------------------------------------------------------- shared folder


_unset: dict[str, str] = {}  # folders of applications that name none


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one, but only in local
    mode: elsewhere each machine would write to a folder of its own and reads would find less than was written."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _unset:
            _unset[app] = f"file://{tempfile.mkdtemp(prefix='tamis-')}"
        named = _unset[app]
    return named.rstrip("/")


def bounded_batches(spark: SparkSession, rows: int = 1_000, size: int = 16 << 20) -> None:
    """Rows and bytes that go to a Python worker at a time: texts can be long, and a worker holds a batch as it comes and as
    it goes. A row larger than that goes alone. Settings of the session, as plans read them when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table of its own in the shared folder and reads it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tamis/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    _written[made] = path
    return made


_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()  # where materialize wrote them


def discard(df: DataFrame) -> None:
    """Deletes the table that materialize wrote for df, once nothing that is still to run reads it; others stay."""
    path = _written.pop(df, None)
    if path is not None:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


# ---------------------------------------------------------------- hashes


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on a copy."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(_BASE) + U64(salt))


_BYTE_VALUES = seeds(256, 7)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(max(n, RUN_BYTES + 1), base, U64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def window_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of `length` values, by the run's start."""
    n = len(values) - length + 1
    if n <= 0:
        return np.empty(0, U64)
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[length:] - total[:n]) * down[:n] + U64(length))


# ---------------------------------------------------------------- words


@dataclass
class Run:
    """Some consecutive texts: rows lo..hi of a batch, the words' hashes and where they lie."""

    lo: int
    hi: int
    data: np.ndarray  # the texts' bytes, end to end
    offsets: np.ndarray  # of the texts in data
    starts: np.ndarray  # of the words in data
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # of the words of each text; one longer than the texts

    def word_text(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))


_SPACE = np.zeros(256, bool)
_SPACE[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column, null as empty, without a copy where possible."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = column.buffers()[2]
    return (np.frombuffer(held, np.uint8) if held is not None and held.size else np.empty(0, np.uint8)), offsets


def word_runs(column: pa.Array, lower: bool = False) -> Iterator[Run]:
    """Words of every whole text, as 64-bit hashes."""
    data, offsets = text_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + RUN_BYTES, "right")) - 1)
        part = data[offsets[lo] : offsets[hi]]
        own = offsets[lo : hi + 1] - offsets[lo]
        if lower:
            part = _LOWER[part]
        yield _words(part, own, lo, hi)
        lo = hi


def _words(part: np.ndarray, own: np.ndarray, lo: int, hi: int) -> Run:
    n = len(part)
    if not n:
        none = np.empty(0, np.int64)
        return Run(lo, hi, part, own, none, none, np.empty(0, U64), np.zeros(hi - lo + 1, np.int64))
    inside = ~_SPACE[part]
    edge = np.zeros(n + 1, bool)
    edge[own] = True
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1] | edge[1:n])))
    ends = np.flatnonzero(inside & np.concatenate((~inside[1:] | edge[1:n], [True]))) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(_BYTE_VALUES[part] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))
    return Run(lo, hi, part, own, starts, ends, hashes, np.searchsorted(starts, own))


# ---------------------------------------------------------------- components


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Alternates large and small stars (Kiveris et al., 2014), each a grouped minimum and a join, written between rounds,
    until a round changes nothing; rounds grow with the logarithm of the longest chain.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    for step in count():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = materialize(least, f"{name}-least{step}")  # a join of plain tables is one whose hot nodes Spark splits
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = materialize(small, f"{name}{step}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
