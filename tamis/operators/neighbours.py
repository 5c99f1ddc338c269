"""Nearest vectors by cosine over an index of cells: each vector is stored with the centre that is nearest to it, and a query
looks into the cells whose centres are nearest to itself.

A number of probes gives an approximate result, whose recall is measured to choose that number. Without one, the search goes
on where it has to: angles obey the triangle inequality, so a cell can't hold a nearer vector than the k-th found where the
angle to its centre, less the cell's radius, is larger. What is left is certified, and the result is that of a full scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators.tables import written

#: Angles are widened by this much: arccosines of doubles near 1 are no more exact.
SLACK = 1e-6
#: Numbers of a matrix that a task holds at once (32 MB of doubles).
HELD = 1 << 22


def padded(v: str, dims: int) -> Column:
    """A vector of exactly `dims` components: zeros follow a shorter one, a longer one is cut."""
    x = F.col(v).cast("array<double>")
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), dims - F.size(x)))), 1, dims)


def _sound(v: str) -> Column:
    return F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)


def rows_of(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """A matrix of a column of arrays of `dims` numbers."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.zeros((0, dims)), *(np.asarray(p.flatten(), float).reshape(len(p), dims) for p in parts)])


def _arrays(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def _units(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    m = rows_of(column, dims)
    m /= np.abs(m).max(1, keepdims=True)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m


def _angles(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ centres.T, -1, 1))


def _places(m: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles of queries to the centres, and each centre's place among them."""
    angle = _angles(m, centres)
    return angle, np.argsort(np.argsort(angle, axis=1, kind="stable"), axis=1)


def _cut(n: int, width: int) -> Iterator[slice]:
    """n rows in runs of which a matrix of `width` columns is held at once."""
    step = max(1, HELD // max(1, width))
    return (slice(at, at + step) for at in range(0, n, step))


def first_k(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k highest scores, ties to the smaller column; -inf is none."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
        tie = (scores == least) & (np.cumsum(scores == least, 1) <= k - (scores > least).sum(1, keepdims=True))
        return np.nonzero(((scores > least) | tie) & (scores > -np.inf))
    return np.nonzero(scores > -np.inf)


def best(asked: np.ndarray, stored: np.ndarray, k: int, least: float, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and products (to six places) of each asked vector's k highest products with stored ones, of those with at
    least `least`; NaN counts as highest. allowed: which pairs count. Ties go to the smaller column."""
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for cut in _cut(len(asked), len(stored)):
        scores = asked[cut] @ stored.T
        np.round(scores, 6, out=scores)
        height = np.where((scores >= least) | np.isnan(scores), scores, -np.inf)
        height[np.isnan(height)] = np.inf
        if allowed is not None:
            height[~allowed[cut]] = -np.inf
        row, column = first_k(height, k)
        found.append((row + cut.start, column, scores[row, column]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def fit(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centres of unit vectors: rounds of nearest centre and normed mean, from evenly spaced rows. A centre that loses all
    its vectors stays."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[cut] @ centres.T).argmax(1) for cut in _cut(len(sample), len(centres))])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


class Index:
    """An index of vectors (vec_id, v): table (vec_id, cell, slot, u), stored by slots of about `part_rows` rows: a large cell
    has slots of its own, small ones share one.

    Vectors have as many components as the longest (shorter ones are padded); null and zero vectors and those with null or
    non-finite components are near to nothing and not stored. Centres are fitted to at most `sample` vectors, those with the
    least hashes, in a task; the driver gets the centres alone. Every vector is stored. cells: None for the root of the number of vectors, 4,096 at most.
    """

    def __init__(self, vectors: DataFrame, cells: int | None = None, sample: int = 20_000, part_rows: int = 10_000, dims: int | None = None):
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
        self.spark, self.part_rows = vectors.sparkSession, part_rows
        n, widest = rows.where(_sound("v")).agg(F.count("*"), F.max(F.size("v"))).first()
        self.n, self.dims = n, dims or widest or 1
        rows = rows.where(_sound("v")).select("vec_id", padded("v", self.dims).alias("v")).where(_sound("v"))
        share = min(1.0, 2 * sample / max(1, n))
        few = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < math.ceil(share * 1_000_000)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").coalesce(1)
        held = few.mapInArrow(self._fit(cells or max(1, min(4_096, math.isqrt(max(1, n))))), "v array<double>").toArrow().column("v")
        self.centres = rows_of(held, self.dims) if n else np.ones((1, self.dims)) / math.sqrt(self.dims)
        placed = written(rows.mapInArrow(self._place(), "vec_id long, cell int, angle double, u array<double>"), "placed")
        facts = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()  # a row for each cell
        self.radius = np.full(len(self.centres), -np.inf)
        self.first, self.parts = np.zeros(len(self.centres), int), np.zeros(len(self.centres), int)  # a cell's slots
        self.slots, room = 0, 0
        for r in sorted(facts):
            self.radius[r.cell], self.parts[r.cell] = r.radius, -(-r.n // part_rows)
            if r.n > room:
                self.slots, room = self.slots + self.parts[r.cell], part_rows if r.n <= part_rows else 0
            self.first[r.cell] = self.slots - self.parts[r.cell]
            room = max(0, room - r.n)
        slots = self.spark.createDataFrame([(c, int(f), int(p)) for c, (f, p) in enumerate(zip(self.first, self.parts, strict=True)) if p], "cell int, first int, parts int")
        dealt = placed.join(slots, "cell").withColumn("slot", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts").cast("long"))).cast("int")).select("vec_id", "cell", "slot", "u")
        self.table = written(dealt.repartition("slot"), "slots", "slot")

    def _fit(self, cells: int):
        dims = self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            units = np.concatenate([np.zeros((0, dims)), *(_units(batch.column(0), dims) for batch in batches)])
            if len(units):
                yield pa.RecordBatch.from_arrays([_arrays(fit(units, cells))], ["v"])

        return run

    def _place(self):
        centres, dims = self.centres, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cut in _cut(len(batch), len(centres)):
                    part = batch.slice(cut.start, cut.stop - cut.start)
                    m = _units(part.column(1), dims)
                    angle = _angles(m, centres)
                    cell = angle.argmin(1)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cell, pa.int32()), pa.array(angle[np.arange(len(m)), cell]), _arrays(m)], ["vec_id", "cell", "angle", "u"])

        return run

    def _in_order(self):
        """Each query's cells with their places."""
        centres, dims = self.centres, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cut in _cut(len(batch), 4 * len(centres)):
                    part = batch.slice(cut.start, cut.stop - cut.start)
                    _, place = _places(_units(part.column(1), dims), centres)
                    ids = part.column(0).take(pa.array(np.repeat(np.arange(len(part)), len(centres))))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(len(centres)), len(part)), pa.int32()), pa.array(place.ravel(), pa.int32())], ["query_id", "cell", "place"])

        return run

    def _near_slots(self, at_least: int | None, most: int | None):
        """Slots of each query with the cells to look into there: by angle the ones from place `at_least` on that may hold what
        the query still lacks, or the first `most` ones. A query's vector goes once to a slot, however many cells it has."""
        centres, radius, first, parts, slots, dims = self.centres, self.radius, self.first, self.parts, self.slots, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cut in _cut(len(batch), max(4 * len(centres), slots * dims)):
                    part = batch.slice(cut.start, cut.stop - cut.start)
                    m = _units(part.column(1), dims)
                    angle, place = _places(m, centres)
                    wanted = np.isfinite(radius)[None, :] & np.ones_like(angle, bool)
                    if most is not None:
                        wanted &= place < most
                    else:
                        reach = np.asarray(part.column(2), float)[:, None]
                        wanted &= (place >= at_least) & (angle - radius - SLACK <= reach)
                    row, cell = np.nonzero(wanted)
                    n = parts[cell]
                    row, cell, at = np.repeat(row, n), np.repeat(cell, n), np.repeat(first[cell], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    order = np.lexsort((cell, at, row))
                    row, cell, at = row[order], cell[order], at[order]
                    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1])][: len(row)])
                    cells = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)], pa.int32()), pa.array(cell, pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[starts])), pa.array(at[starts], pa.int32()), cells, _arrays(m[row[starts]])], ["query_id", "slot", "cells", "u"])

        return run

    def _queries(self, queries: DataFrame) -> DataFrame:
        q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q")).where(_sound("q"))
        return q.select("query_id", padded("q", self.dims).alias("q")).where(_sound("q"))

    def _look(self, probes: DataFrame, k: int, least: float) -> DataFrame:
        """The k best of each query within the probed cells of each slot, and where they lie."""
        counts = {r.slot: r["count"] for r in probes.groupBy("slot").count().collect()}  # a row for each slot
        block = max(64, HELD // self.dims)
        blocks = self.spark.createDataFrame([(s, -(-n // block)) for s, n in counts.items()], "slot int, blocks int")
        asked = probes.join(blocks, "slot").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks").cast("long")).cast("int")).select("slot", "block", "query_id", "cells", "u")
        stored = self.table.where(F.col("slot").isin(list(counts))).join(blocks, "slot").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("slot", "block", "vec_id", "cell", "u")
        dims, shape = self.dims, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("similarity", pa.float64()), ("cell", pa.int32())])

        def run(asked: pa.Table, stored: pa.Table) -> pa.Table:
            if not len(asked) or not len(stored):
                return shape.empty_table()
            cells = asked.column("cells").combine_chunks()
            number = np.unique(np.concatenate([cells.flatten().to_numpy(), stored.column("cell").to_numpy()]))
            wanted = np.zeros((len(asked), len(number)), bool)
            wanted[np.repeat(np.arange(len(asked)), pc.list_value_length(cells).to_numpy()), np.searchsorted(number, cells.flatten().to_numpy())] = True
            cell = np.searchsorted(number, stored.column("cell").to_numpy())
            stored = stored.filter(pa.array(wanted.any(0)[cell])).sort_by("vec_id")  # the cells that any query asks for
            cell = np.searchsorted(number, stored.column("cell").to_numpy())
            q, v, found = rows_of(asked.column("u"), dims), rows_of(stored.column("u"), dims), []
            for cut in _cut(len(q), len(v)):
                row, column, similarity = best(q[cut], v, k, least, wanted[cut][:, cell])
                found.append(pa.table([asked.column("query_id").take(pa.array(row + cut.start)), stored.column("vec_id").take(pa.array(column)), pa.array(similarity), stored.column("cell").take(pa.array(column))], schema=shape))
            return pa.concat_tables(found)

        by = ("slot", "block")
        return asked.groupBy(*by).cogroup(stored.groupBy(*by)).applyInArrow(run, "query_id long, vec_id long, similarity double, cell int")

    def search(self, queries: DataFrame, k: int = 10, least: float = 0.5, probes: int | None = None) -> DataFrame:
        """The k stored vectors nearest by cosine (rounded to six places) to each query (query_id, q), of those with at least
        `least` (above 0): query_id, vec_id, similarity, rank. Ties go to the smaller vec_id. probes: cells looked into; None
        for a result equal to a full scan's. Null and zero queries find nothing."""
        asked = written(self._queries(queries), "queries")
        shape = "query_id long, slot int, cells array<int>, u array<double>"
        first = probes if probes is not None else max(1, len(self.centres) // 10)
        near = written(asked.mapInArrow(self._near_slots(None, first), shape), "probes")
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
        top = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = top(self._look(near, k, least))
        if probes is None:
            found = written(found, "found")
            # up to this angle lies what may still be better
            reach = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("similarity").alias("worst"))
            limit = F.when(F.col("n") >= k, F.greatest(F.col("worst"), F.lit(least))).otherwise(F.lit(least)) - 1e-6
            bounds = asked.join(reach, "query_id", "left").select("query_id", "q", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(limit, F.lit(least - 1e-6))))).alias("reach"))
            more = written(bounds.mapInArrow(self._near_slots(first, None), shape), "further")
            found = top(self._look(more, k, least).unionByName(found.drop("rank")))
        return found.select("query_id", "vec_id", "similarity", "rank")

    def probes_for(self, queries: DataFrame, recall: float = 0.97, k: int = 10, least: float = 0.5, sample: int = 200) -> int:
        """Probes after which `recall` of the true neighbours are found, measured on at most `sample` of the queries (those
        with the least hashes), each against all stored vectors."""
        few = self._queries(queries).orderBy(F.xxhash64("query_id"), "query_id").limit(sample).select("query_id", "q")
        few = written(few, "sample")
        every = written(few.mapInArrow(self._near_slots(None, len(self.centres)), "query_id long, slot int, cells array<int>, u array<double>"), "every")
        order_of = few.mapInArrow(self._in_order(), "query_id long, cell int, place int")
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
        true = self._look(every, k, least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        places = true.join(order_of, ["query_id", "cell"]).groupBy("place").count().orderBy("place").collect()  # a row for each place
        total, seen = sum(r["count"] for r in places), 0
        for r in places:
            seen += r["count"]
            if seen >= recall * total:
                return r.place + 1
        return len(self.centres)


def merged(searches: dict[str, DataFrame], k: int) -> DataFrame:
    """The k best of each query over the results of several tables, by name: query_id, source_table, vec_id, similarity, rank.
    Ties go by the table's name, then to the smaller vec_id."""
    both = None
    for name, found in searches.items():
        own = found.select("query_id", F.lit(name).alias("source_table"), "vec_id", "similarity")
        both = own if both is None else both.unionByName(own)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "source_table", "vec_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
