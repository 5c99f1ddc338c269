"""Exact top-k search by distributed histogram selection.

Queries lie in groups, candidates in blocks, and each group meets each block: every pair is scored, by one exact matrix
product a pair of group and block. Which score is a query's k-th highest is found without keeping scores:

1. A query's scores lie in an interval whose width is a power of two. Each block counts the scores that fall into each of
   `bins` equal parts of it; the counts of all blocks are added up, and the part that holds the k-th value is the next
   interval. A block sends its parts from the top down until they hold as many scores as are looked for: the k-th value of
   all isn't below. Rounds go on until the interval is one whole number, two of them for vectors of about unit length.
2. Then each block gives the scores at or above that value, ties by vec_id, and the k first are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import materialize
from tamis.llm.vectors import SHIFT, TILE, best, blocks_of, inner, matrix, none_of, picked, whole_numbers


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each pair of group and block: the pair's cells, places of queries in the group, and scores (none for a query's
    own row) against some of the block's vectors, from the first one on."""
    for batch in batches:
        for r in range(batch.num_rows):
            cell = {c: batch.column(k)[r] for k, c in enumerate(batch.schema.names)}
            if cell["dims"].as_py() != cell["b_dims"].as_py():
                continue
            q, x = matrix(cell["m"], cell["dims"].as_py(), cell["n"].as_py()), matrix(cell["b_m"], cell["dims"].as_py(), cell["b_n"].as_py())
            at = np.asarray([s["at"] for s in cell["state"].as_py()])
            own = np.asarray(cell["place"].values)[at]
            step = max(1, TILE // len(at))
            for first in range(0, len(x), step):
                scores = inner(q[at], x[first : first + step])
                here = np.flatnonzero(own >> SHIFT == cell["block"].as_py())
                there = (own[here] & ((1 << SHIFT) - 1)) - first
                inside = (there >= 0) & (there < scores.shape[1])
                scores[here[inside], there[inside]] = none_of(scores)
                yield cell, at, scores, first


def _counts(shift: int, bins: int):
    """Counts of scores by part of each query's interval, from the top down until they hold as many as are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, at, scores, _ in _tiles(batches):
            low = np.asarray([s["low"] for s in cell["state"].as_py()], np.int64)
            need = np.asarray([s["need"] for s in cell["state"].as_py()], np.int64)
            seen = scores > none_of(scores)
            part = np.where(seen, scores, 0).astype(np.int64) - low[:, None] >> shift
            seen &= (part >= 0) & (part < bins)
            row, _ = np.nonzero(seen)
            held = np.bincount(row * bins + part[seen], minlength=len(at) * bins).reshape(len(at), bins)
            above = np.cumsum(held[:, ::-1], 1)[:, ::-1] - held
            row, part = np.nonzero((held > 0) & (above < need[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), cell["group"].as_py(), np.int64)), pa.array(at[row].astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(held[row, part])], ["group", "at", "part", "n"])

    return run


def _at_least(k: int):
    """Each block's k first scores, among those that are a query's k-th value at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, at, scores, first in _tiles(batches):
            low = np.asarray([s["low"] for s in cell["state"].as_py()], np.int64)
            scores[scores < low[:, None]] = none_of(scores)
            row, column = best(scores, k)
            ids = cell["b_vec_id"].values.take(pa.array(column + first))
            place = (cell["block"].as_py() << SHIFT) + column + first
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), cell["group"].as_py(), np.int64)), pa.array(at[row].astype(np.int32)), ids, pa.array(place), pa.array(scores[row, column].astype(np.int64))], ["group", "at", "vec_id", "place", "score"])

    return run


def top_k(vectors: DataFrame, query, k: int = 10, scale: int = 1_024, bins: int = 4_096) -> DataFrame:
    """The k rows of vectors (vec_id, embedding) with the highest inner product, for each row where `query`, a condition on
    vec_id, holds: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x), x as a double, and saturate at 2 ** 26; products are exact. Every row but the
    query's own is a candidate; ties go to the smaller vec_id, null last. A query with fewer candidates gets all. Null
    vectors and those with null or non-finite components take no part; vectors of different lengths don't meet; a row whose
    vec_id is null is a candidate, and no query. Rows of one vec_id are candidates, and queries, of their own. Other columns
    aren't read; an empty table gives no rows.
    bins: parts that an interval is cut into, a power of two; a task holds that many counts for each query of a group.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers("embedding", scale).alias("v")).where("v is not null")
    rows = rows.withColumn("asked", F.coalesce(query, F.lit(False)).cast("long"))
    blocks = blocks_of(rows, "blocks")
    groups = materialize(picked(blocks, "asked").withColumn("group", F.monotonically_increasing_id()).drop("block"), "queries")
    many, widest = blocks.agg(F.count("*"), F.max("dims")).first()
    # no sum of products passes the square of the largest component, taken as often as there are components
    most = F.expr("greatest(abs(array_min(v)), abs(array_max(v)))")
    largest = rows.agg(F.max(most)).first()[0] or 0
    reach = max(1, int(largest) ** 2 * (widest or 0)).bit_length()
    step = bins.bit_length() - 1

    state = groups.select("group", F.posexplode("place").alias("at", "place")).select("group", "at", F.lit(-(1 << reach)).cast("long").alias("low"), F.lit(k).cast("long").alias("need"))
    held = blocks.drop("asked").select("block", *(F.col(c).alias(f"b_{c}") for c in ("dims", "n", "vec_id", "m")))

    def met(state: DataFrame) -> DataFrame:
        """Each group of queries with its state, once for each block, beside the block."""
        own = state.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("at", "low", "need"))).alias("state"))
        sent = groups.select("group", "dims", "n", "place", "m").join(own, "group").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(many - 1)).cast("array<bigint>")))
        return sent.join(held.hint("merge"), "block")

    if not many:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    down = Window.partitionBy("group", "at").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    left = reach + 1
    while left:
        shift = max(0, left - step)
        parts = met(state).mapInArrow(_counts(shift, 1 << (left - shift)), "group long, at int, part int, n long")
        parts = parts.groupBy("group", "at", "part").agg(F.sum("n").alias("n")).withColumn("above", F.coalesce(F.sum("n").over(down), F.lit(0)))
        found = parts.join(state, ["group", "at"]).where("above < need").groupBy("group", "at", "low", "need").agg(F.min(F.struct("part", "above")).alias("p"))
        state = materialize(found.select("group", "at", (F.col("low") + F.col("p.part").cast("long") * (1 << shift)).alias("low"), (F.col("need") - F.col("p.above")).alias("need")), "intervals")
        left = shift
    hits = met(state).mapInArrow(_at_least(k), "group long, at int, vec_id long, place long, score long")
    order = Window.partitionBy("group", "at").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "place")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = groups.select("group", F.posexplode("vec_id").alias("at", "query_id"))
    return ranked.join(ids, ["group", "at"]).select("query_id", "rank", "vec_id", "score")
