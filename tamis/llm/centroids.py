"""Centroid clustering (Lloyd's rounds) with adaptive distance bounds (Drake and Hamerly, 2012), exact in whole numbers.

A vector keeps its centroid, an upper bound of the distance to it, the next nearest centroids in order with a lower bound
each, and one lower bound for all others. A round moves the bounds by as much as the centroids have moved. Where the upper
bound stays under all lower ones, nothing is computed; where it reaches listed centroids only, these are measured and put
in order anew; where it reaches the bound of the rest, all are measured. As many centroids are listed as any vector of the
round before has needed, between an eighth and a quarter of all.

Vectors lie in blocks, which carry their bounds and, of each centroid, the sum of its vectors. A round reads the blocks of
the one before and writes its own; the driver sees the centroids' sums alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import discard, materialize
from tamis.llm.vectors import blocks_of, inner, matrix, whole_numbers

#: Bounds are doubles of whole-number distances; they certify where they differ by more than this share.
SLACK = 1e-9


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each vector to each centroid, in longs."""
    x, centroids = x.astype(np.int64), centroids.astype(np.int64)
    return (x * x).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * inner(x, centroids).astype(np.int64)


class Bounds:
    """Bounds of a block's vectors: assigned (n), upper (n), order (n x listed), lower (n x listed + 1, the rest's last)."""

    def __init__(self, assigned: np.ndarray, upper: np.ndarray, order: np.ndarray, lower: np.ndarray):
        self.assigned, self.upper, self.order, self.lower = assigned, upper, order, lower
        self.needed = 0  # listed centroids that some vector had to look at
        self.measured = 0  # distances computed

    @classmethod
    def of(cls, x: np.ndarray, centroids: np.ndarray, listed: int) -> Bounds:
        n = len(x)
        made = cls(np.zeros(n, np.int32), np.zeros(n), np.zeros((n, listed), np.int32), np.full((n, listed + 1), np.inf))
        made._scan(np.arange(n), x, centroids)
        return made

    def _scan(self, at: np.ndarray, x: np.ndarray, centroids: np.ndarray) -> None:
        """All centroids of the vectors `at`; ties go to the smaller number."""
        listed = self.order.shape[1]
        d = squares(x[at], centroids)
        order = np.argsort(d, axis=1, kind="stable")
        d = np.sqrt(np.take_along_axis(d, order, 1))
        self.assigned[at], self.upper[at] = order[:, 0], d[:, 0]
        self.order[at], self.lower[at, :listed] = order[:, 1 : listed + 1], d[:, 1 : listed + 1]
        self.lower[at, listed] = d[:, listed + 1] if d.shape[1] > listed + 1 else np.inf
        self.needed = max(self.needed, listed)
        self.measured += d.size

    def keep(self, listed: int) -> None:
        """Lists fewer centroids; the rest's bound is the least of those that go."""
        if listed < self.order.shape[1]:
            self.lower = np.concatenate((self.lower[:, :listed], self.lower[:, listed:].min(1, keepdims=True)), 1)
            self.order = np.ascontiguousarray(self.order[:, :listed])

    def move(self, x: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> None:
        """The bounds and assignments for centroids that have moved so far from those of the round before."""
        listed = self.order.shape[1]
        self.needed = 0
        self.upper = self.upper + moved[self.assigned]
        self.lower[:, :listed] -= moved[self.order]
        self.lower[:, listed] -= moved.max(initial=0)
        slack = lambda at: SLACK * (1 + self.upper[at])[:, None]
        every = np.arange(len(x))
        open_ = every[(self.upper[:, None] + slack(every) >= self.lower).any(1)]
        gap = x[open_].astype(np.int64) - centroids[self.assigned[open_]]
        self.upper[open_] = np.sqrt((gap * gap).sum(1))
        self.measured += len(open_)
        reach = self.upper[open_][:, None] + slack(open_) >= self.lower[open_]
        far = reach[:, listed]
        near = reach.any(1) & ~far
        if near.any():
            self.needed = max(self.needed, int((reach[near, :listed] * np.arange(1, listed + 1)).max()))
            self._reorder(open_[near], x, centroids)
        if far.any():
            self._scan(open_[far], x, centroids)

    def _reorder(self, at: np.ndarray, x: np.ndarray, centroids: np.ndarray) -> None:
        """Only the assigned and the listed centroids of the vectors `at`: the rest's bound is above the assigned one."""
        own = np.sort(np.concatenate((self.assigned[at, None], self.order[at]), 1), 1)
        gap = x[at, None].astype(np.int64) - centroids[own]
        d = (gap * gap).sum(2)
        order = np.argsort(d, axis=1, kind="stable")
        own, d = np.take_along_axis(own, order, 1), np.sqrt(np.take_along_axis(d, order, 1))
        self.assigned[at], self.upper[at] = own[:, 0], d[:, 0]
        self.order[at], self.lower[at, :-1] = own[:, 1:], d[:, 1:]
        self.measured += d.size

    def cells(self) -> list[pa.Array]:
        return [pa.array([a.tobytes()], pa.binary()) for a in (self.assigned, self.upper, self.order, self.lower)]

    @classmethod
    def read(cls, cells: list[pa.Scalar], n: int, listed: int) -> Bounds:
        assigned, upper, order, lower = (np.frombuffer(c.as_buffer(), t).copy() for c, t in zip(cells, (np.int32, float, np.int32, float), strict=True))
        return cls(assigned, upper, order.reshape(n, listed), lower.reshape(n, listed + 1))


_STATE = ["assigned", "upper", "order", "lower"]
_NAMES = ["n", "vec_id", "m", *_STATE, "sums", "needed", "measured"]
_SHAPE = "n int, vec_id array<bigint>, m binary, assigned binary, upper binary, order binary, lower binary, sums array<bigint>, needed int, measured bigint"


def _round(centroids: np.ndarray, moved: np.ndarray | None, was: int, listed: int):
    """A block's next bounds, and the sums and counts of each centroid's vectors, one after the other."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cell = {c: batch.column(j)[r] for j, c in enumerate(batch.schema.names)}
                n = cell["n"].as_py()
                x = matrix(cell["m"], dims, n)
                if moved is None:
                    bounds = Bounds.of(x, centroids, listed)
                else:
                    bounds = Bounds.read([cell[c] for c in _STATE], n, was)
                    bounds.keep(listed)
                    bounds.move(x, centroids, moved)
                sums = np.zeros((k, dims + 1), np.int64)
                for c in np.unique(bounds.assigned):
                    own = x[bounds.assigned == c]
                    sums[c, :dims], sums[c, dims] = own.sum(0, dtype=np.int64), len(own)
                fixed = [batch.column(batch.schema.get_field_index(c)).slice(r, 1) for c in ("n", "vec_id", "m")]
                yield pa.RecordBatch.from_arrays([*fixed, *bounds.cells(), pa.array([sums.ravel().tolist()], pa.list_(pa.int64())), pa.array([bounds.needed], pa.int32()), pa.array([bounds.measured])], _NAMES)

    return run


def _members(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cell = {c: batch.column(j)[r] for j, c in enumerate(batch.schema.names)}
                assigned = np.frombuffer(cell["assigned"].as_buffer(), np.int32)
                gap = matrix(cell["m"], centroids.shape[1], len(assigned)).astype(np.int64) - centroids[assigned]
                yield pa.RecordBatch.from_arrays([cell["vec_id"].values, pa.array(assigned), pa.array((gap * gap).sum(1))], ["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1_024, seed: str = "3") -> DataFrame:
    """Per vector of vectors (vec_id, embedding) with exactly `dims` components, none null or not finite: vec_id, cluster,
    distance (squared), cluster_inertia, inertia, centroid_sha256. Others have no row.

    Components become floor(scale * x), x as a double, and saturate at 2 ** 26. Centroids start as the k vectors with the
    least sha256 of `seed:vec_id` (null last, ties by components; all, if fewer). A round assigns every vector to the
    nearest centroid, ties to the smaller number, then replaces each centroid that has vectors by the floor of their mean;
    at last vectors are assigned once more. Rounds end early where no centroid moves. Repeated rows are vectors of their
    own; other columns aren't read; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers("embedding", scale).alias("v")).where(F.size("v") == dims)
    first = rows.orderBy(F.asc_nulls_last(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)), "v").limit(k).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.v for r in first], np.int64)
    k = len(centroids)
    now, moved = blocks_of(rows, "blocks"), None
    least = min(-(-k // 8), k - 1)
    was = listed = min(max(1, k // 4), k - 1)
    for step in range(rounds + 1):
        before = now
        now = materialize(before.mapInArrow(_round(centroids, moved, was, listed), _SHAPE), f"bounds{step}")
        discard(before)
        if step == rounds:
            break
        sums = now.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # k * (dims + 1) rows
        total = [0] * (k * (dims + 1))
        for r in sums:
            total[r["at"]] = int(r["x"])
        new = centroids.copy()
        for c in range(k):
            *own, n = total[c * (dims + 1) : (c + 1) * (dims + 1)]
            if n:
                new[c] = [s // n for s in own]
        was, listed = listed, max(least, min(listed, now.agg(F.max("needed")).first()[0]))
        moved = np.sqrt(((new - centroids) ** 2).sum(1)) * (1 + SLACK)
        if not moved.any():
            break
        centroids = new
    members = materialize(now.mapInArrow(_members(centroids), "vec_id long, cluster int, distance long"), "members")
    inertia = members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()  # k rows
    whole = sum(int(r.inertia) for r in inertia)
    digest = {c: hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for c, row in enumerate(centroids.tolist())}
    facts = [(r.cluster, int(r.inertia), whole, digest[r.cluster]) for r in inertia]
    facts = members.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
