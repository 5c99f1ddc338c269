"""Hard negatives by one-dimensional distance keys: the index of iDistance (Jagadish et al., 2005), exact.

A vector x gets one more component, sqrt(M * M - x * x) with M the largest length, and a query a zero: then the distance of
the two falls as their inner product rises, so the highest product is the nearest neighbour. Each augmented vector belongs to
its nearest pivot, and the table is stored sorted by (pivot, distance to it), in blocks that know their interval of keys.

What lies within a distance r of a query has a key within r of the query's own distance to the pivot. So a search scans the
blocks that meet such an annulus of each pivot, and widens it: up to a first width, then a larger one, at last as far as the
k-th best found so far is away. There the remaining distance bound certifies the result, however well the keys prune.
Queries next to each other in the index are a group and scan blocks together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import materialize
from tamis.llm.vectors import SHIFT, TILE, best, blocks_of, inner, matrix, none_of, picked, whole_numbers

#: Scores no product reaches.
MOST = 1 << 62
#: Bounds are widened by this share of the largest length: more than doubles round.
SLACK = 1e-6


def _pivots_for(pivots: list[list[int]], dims: int) -> np.ndarray:
    """The pivots cut or filled with zeros to so many components: what they are decides on speed, not on results."""
    made = np.zeros((len(pivots), dims))
    for row, p in zip(made, pivots, strict=True):
        row[: len(p)] = p[:dims]
    return made


def _distances(x: np.ndarray, pivots: list[list[int]], largest: float, query: bool) -> np.ndarray:
    """Of each vector, augmented or a query, to each pivot, augmented."""
    p, x = _pivots_for(pivots, x.shape[1]), x.astype(float)
    extra = lambda m: np.sqrt(np.maximum(largest**2 - (m * m).sum(1), 0))
    own = np.zeros(len(x)) if query else extra(x)
    square = (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T + (own[:, None] - extra(p)) ** 2
    return np.sqrt(np.maximum(square, 0))


def _keys(pivots: list[list[int]], largest: float):
    """Adds each vector's pivot and its distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(batch.schema.get_field_index("v"))
            pivot, key = np.zeros(len(v), np.int32), np.zeros(len(v))
            lists = v.to_pylist()
            size = np.array([len(x) for x in lists])
            for dims in np.unique(size):
                at = np.flatnonzero(size == dims)
                d = _distances(np.array([lists[k] for k in at], float).reshape(len(at), dims), pivots, largest, False)
                pivot[at] = d.argmin(1)
                key[at] = d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(key)], [*batch.schema.names, "pivot", "key"])

    return run


def _reaches(pivots: list[list[int]], largest: float, names: list[str]):
    """Adds a group's least and greatest distance to each pivot, and its queries' squared lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cell = {c: batch.column(j)[r] for j, c in enumerate(batch.schema.names)}
                q = matrix(cell["m"], cell["dims"].as_py(), cell["n"].as_py()).astype(float)
                d = _distances(q, pivots, largest, True)
                made = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (d.min(0), d.max(0), (q * q).sum(1))]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).slice(r, 1) for c in names), *made], [*names, "from", "to", "square"])

    return run


def _scan(k: int, same: bool):
    """Of each want, the k highest scores within a block: those of a query with rows of its own label, or of others, from its
    bar up to its top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cell = {c: batch.column(j)[r] for j, c in enumerate(batch.schema.names)}
                dims, block = cell["dims"].as_py(), cell["block"].as_py()
                q, x = matrix(cell["m"], dims, cell["n"].as_py()), matrix(cell["b_m"], dims, cell["b_n"].as_py())
                wants = cell["wants"].values.flatten()
                at, want, bar, top = (np.asarray(w) for w in wants)
                label, labels = np.asarray(cell["label"].values), np.asarray(cell["b_label"].values)
                place = np.asarray(cell["place"].values)
                step = max(1, TILE // max(len(at), len(q)))
                for first in range(0, len(x), step):
                    scores = inner(q, x[first : first + step])
                    none = none_of(scores)
                    scores[(label[:, None] == labels[first : first + step]) != same] = none
                    here = np.flatnonzero(place >> SHIFT == block)
                    there = (place[here] & ((1 << SHIFT) - 1)) - first
                    inside = (there >= 0) & (there < scores.shape[1])
                    scores[here[inside], there[inside]] = none
                    scores = scores[at]
                    scores[(scores < bar[:, None]) | (scores > top[:, None])] = none
                    row, column = best(scores, k)
                    if len(row):
                        ids = cell["b_vec_id"].values.take(pa.array(column + first))
                        where = (block << SHIFT) + column + first
                        out = [pa.array(np.full(len(row), cell["group"].as_py(), np.int64)), pa.array(at[row].astype(np.int32)), pa.array(want[row].astype(np.int32)), ids, pa.array(where), pa.array(scores[row, column].astype(np.int64))]
                        yield pa.RecordBatch.from_arrays(out, ["group", "at", "want", "vec_id", "where", "score"])

    return run


class Index:
    """Vectors (vec_id, label, v, asked; all not null but vec_id) sorted by (pivot, distance), and the asked ones in groups."""

    def __init__(self, rows: DataFrame, pivots: int = 32):
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        self.largest = float(np.sqrt(rows.agg(F.max(square)).first()[0] or 0))
        chosen = [list(r.v) for r in rows.select("v").orderBy(F.xxhash64("v"), "v").limit(pivots).collect()] or [[]]
        keyed = rows.select("vec_id", "label", "asked", "v").mapInArrow(_keys(chosen, self.largest), "vec_id long, label long, asked long, v array<int>, pivot int, key double")
        # by id too, so that a key that many rows share is divided
        stored = keyed.repartitionByRange("pivot", "key", "vec_id").sortWithinPartitions("pivot", "key", "vec_id")
        blocks = blocks_of(stored, "index", keys=("pivot",))
        self.blocks = blocks.select("block", "dims", "n", "pivot", F.array_min("key").alias("low"), F.array_max("key").alias("high"), "vec_id", "label", "asked", "m")
        asked = picked(self.blocks, "asked").select("dims", "n", "pivot", "vec_id", "label", "m", "place")
        names = asked.columns
        shape = ", ".join(f"{c} {t}" for c, t in asked.dtypes)
        groups = asked.mapInArrow(_reaches(chosen, self.largest, names), f"{shape}, from array<double>, to array<double>, square array<double>")
        self.groups = materialize(groups.withColumn("group", F.monotonically_increasing_id()), "groups")
        self.widths = [self.largest / 4, self.largest, float("inf")]

    def search(self, wants: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best of each want (group, at, want, low, top): rows of the query's own label or of others whose score is
        from low to top; ties to the smaller vec_id. group, at, want, rank, vec_id, score."""
        order = Window.partitionBy("group", "at", "want").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "where")
        squares = self.groups.select("group", F.posexplode("square").alias("at", "square"))
        wants = materialize(wants.join(squares, ["group", "at"]), "wants").withColumn("bar", F.col("low"))
        found, slack = None, SLACK * self.largest
        reached = self.groups.select("group", F.lit(float("-inf")).alias("before"))
        span = self.groups.select("group", "dims", F.posexplode(F.arrays_zip(F.col("from").alias("a"), F.col("to").alias("b"))).alias("pivot", "d"))
        keys = self.blocks.select("block", "dims", "pivot", "low", "high")
        for width in self.widths:
            away = F.sqrt(F.greatest(F.lit(0.0), F.col("square") + self.largest**2 - 2 * F.col("bar").cast("double"))) + slack
            needed = wants.groupBy("group").agg(F.max(away).alias("away"))
            now = materialize(reached.join(needed, "group").select("group", "before", F.greatest("before", F.least("away", F.lit(width))).alias("after")), "widths")
            meets = lambda w: (F.col("high") >= F.col("d.a") - F.col(w)) & (F.col("low") <= F.col("d.b") + F.col(w))
            pairs = materialize(span.join(now, "group").join(keys, ["dims", "pivot"]).where(meets("after") & ~meets("before")).select("group", "block"), "pairs")
            reached = now.select("group", F.col("after").alias("before"))
            if pairs.isEmpty():
                continue
            own = wants.groupBy("group").agg(F.collect_list(F.struct(F.col("at").cast("long"), F.col("want").cast("long"), "bar", "top")).alias("wants"))
            sent = self.groups.select("group", "dims", "n", "label", "m", "place").join(own, "group").join(pairs, "group")
            held = self.blocks.select("block", *(F.col(c).alias(f"b_{c}") for c in ("n", "vec_id", "label", "m")))
            hits = sent.join(held.hint("merge"), "block").mapInArrow(_scan(k, same), "group long, at int, want int, vec_id long, where long, score long")
            hits = hits if found is None else hits.unionByName(found.drop("rank"))
            found = materialize(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "found")
            bars = found.groupBy("group", "at", "want").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            wants = wants.drop("bar", "n", "least").join(bars, ["group", "at", "want"], "left").withColumn("bar", F.when(F.col("n") >= k, F.col("least")).otherwise(F.col("low")))
            wants = materialize(wants, "bars")
        if found is None:
            return self.groups.sparkSession.createDataFrame([], "group long, at int, want int, rank int, vec_id long, score long")
        return found.select("group", "at", "want", "rank", "vec_id", "score")


def hard_negatives(vectors: DataFrame, asked: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, pivots: int = 32) -> DataFrame:
    """For each anchor (a row of vectors (vec_id, embedding, label) where `asked`, a condition on vec_id, holds) and each of
    its first `positives` other rows of the same label, the first `negatives` rows of other labels whose score is from low to
    high percent of the positive's: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components become floor(scale * x), x as a double, and saturate at 2 ** 26; a score is the exact inner product, higher
    ones come first, ties by the smaller vec_id (null last). Fewer rows give fewer results, a positive of a negative score
    none. Rows with a null label or vector or a null or non-finite component take no part; vectors of different lengths don't
    meet; a row whose vec_id is null is no anchor. Rows of one vec_id are rows of their own, copies are positives and
    negatives like others. Other columns aren't read; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole_numbers("embedding", scale).alias("v")).where("v is not null and label is not null")
    rows = materialize(rows.withColumn("asked", F.coalesce(asked, F.lit(False)).cast("long")), "rows")
    index = Index(rows, pivots)
    every = index.groups.select("group", F.posexplode("vec_id").alias("at", "anchor_id"))
    found = index.search(every.select("group", "at", F.lit(0).alias("want"), F.lit(-MOST).cast("long").alias("low"), F.lit(MOST).cast("long").alias("top")), positives, same=True)
    found = materialize(found.select("group", "at", F.col("rank").alias("want"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # the least whole number from low percent up, the greatest up to high percent
    bound = lambda percent, up: F.expr(f"(positive_score * {percent} {'+ pmod(-positive_score * ' if up else '- pmod(positive_score * '}{percent}, 100)) div 100")
    wants = found.select("group", "at", "want", bound(low, True).alias("low"), bound(high, False).alias("top")).where("low <= top")
    mined = index.search(wants, negatives, same=False).withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
    return mined.join(found, ["group", "at", "want"]).join(every, ["group", "at"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
