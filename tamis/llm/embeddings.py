"""Near-duplicate vectors by sorted projection passes.

Each pass orders the vectors of a label by one long string of hash bits, the signs of random projections, and compares each
vector with the ones that follow it in a bounded window. Passes use other projections; their verified pairs are united.
Equal vectors become one class before that, so that copies don't fill the windows. Projections are of what a vector has
besides its label's mean, as vectors that crowd in one direction would else share most bits. A pair is split by every bit
that it differs in before the window reaches over what is left, so a label with more vectors, or with vectors that crowd,
gets more passes: measured on a sample of the label with a partner planted at the threshold for each vector
(measured_passes), and not fewer than even halving would ask for (passes_for). A label that fits in a window is compared
whole.

Components of the pairs found are families. A family larger than a window holds links that no window has met, so links are
counted over whole families, block against block: exact within a family whatever its size, and no pair leaves its task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import components, materialize


def projections(passes: int, bits: int, dims: int, seed: int) -> np.ndarray:
    """The first passes are the same however many there are."""
    return np.random.default_rng(seed).standard_normal((passes, bits, dims))


def passes_for(n: int, threshold: float, window: int, recall: float) -> int:
    """Passes after which a pair whose cosine is the threshold has met with probability `recall`, among n vectors that
    hash bits halve evenly.

    The pair agrees in its first d bits and differs in the next with probability p * (1 - p) ** d. Then it lies in the two
    halves of a run of n / 2 ** d vectors, and its distance is the sum of two uniform ones of half that run.
    """
    if n <= window + 1:
        return 1
    p, met, agree, half = math.acos(max(-1.0, min(1.0, threshold))) / math.pi, 0.0, 1.0, n / 2
    while window < 2 * half:
        reach = window / half
        met += agree * p * (1 - (2 - reach) ** 2 / 2 if reach > 1 else reach**2 / 2)
        agree, half = agree * (1 - p), half / 2
    met += agree
    return 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - met))


def keys_of(m: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The signs of projections (bits x components) of each row, as a number, the first bit highest; 64 bits at most."""
    return (m @ planes.T > 0).astype(np.uint64) @ (np.uint64(1) << np.arange(len(planes), dtype=np.uint64)[::-1])


def measured_passes(sample: np.ndarray, n: int, planes: np.ndarray, threshold: float, window: int, recall: float, most: int, seed: int) -> int:
    """Passes after which a pair at the threshold has met with probability `recall`, in a label of n unit vectors of which
    `sample` is a part: each has a partner planted at the threshold in a random direction, and what lies between the two in a
    pass's order is counted in the sample. planes: of the passes to measure. `most` at most, where pairs hardly meet."""
    if n <= window + 1 or len(sample) < 2:
        return 1
    rng = np.random.default_rng(seed)
    w = rng.standard_normal(sample.shape)
    w -= (w * sample).sum(1, keepdims=True) * sample
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)
    partner = threshold * sample + math.sqrt(max(0.0, 1 - threshold**2)) * w
    mean, met = sample.mean(0), []
    for plane in planes:
        own, other = keys_of(sample - mean, plane), keys_of(partner - mean, plane)
        order = np.sort(own)
        between = np.searchsorted(order, np.maximum(own, other), "left") - np.searchsorted(order, np.minimum(own, other), "right")
        gap = (np.maximum(between, 0) + 0.5) * n / len(sample)
        met.append(np.where(between <= 0, min(1.0, window * len(sample) / n), gap <= window).mean())
    share = float(np.mean(met))
    return 1 if share >= recall else most if share <= 0 else min(most, math.ceil(math.log(1 - recall) / math.log(1 - share)))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def near_vectors(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.95, bits: int = 48, window: int = 512, segment: int = 4_000, block: int = 1_024, broadcast_rows: int = 50_000, seed: int = 6, sample: int = 2_000, most_passes: int = 64) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label): n_links, component_id, kept.

    Vectors link when their labels are equal and not null, they have as many components, and their cosine in double
    precision is at least `threshold`. Null, empty and zero vectors and those with null or non-finite components link with
    nothing. n_links: other vectors linked directly, copies counted; component_id: the smallest vec_id reachable; kept: it
    is the own one. Rows of one vec_id count as vectors of their own when links are counted. A null vec_id links with
    nothing. Other columns aren't read; an empty table gives no rows.
    recall: share of isolated pairs at the threshold itself that are to be met (nearer ones are met more often), which sets
    the passes of each label, measured on about `sample` of its vectors (those with the least hashes), up to most_passes. segment: vectors sorted by a task at a time, with the window's width of the next segment's.
    broadcast_rows: sizes of up to so many labels are broadcast, more are joined.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    kinds = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    # copies: equal components, negative zero as zero
    alike = F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + F.lit(0.0)).cast("string"))), 256)
    kinds = materialize(kinds.withColumn("alike", F.when(F.col("sound"), F.concat_ws(":", F.length("label"), "label", alike))).select("vec_id", "label", "alike", F.when(F.col("sound"), F.col("v")).alias("v")), "vectors")
    classes = kinds.where("alike is not null").groupBy("alike").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    members = materialize(kinds.join(classes, "alike", "left"), "classes")
    heads = members.where("vec_id = rep").dropDuplicates(["vec_id", "alike"]).select("rep", "copies", "alike", F.col("label").alias("_label"), "v")
    sizes = materialize(members.where("vec_id = rep").select("alike", F.col("label").alias("_label")).distinct().groupBy("_label").agg(F.count("*").alias("_size")), "sizes")
    few = sizes.limit(broadcast_rows + 1).count() <= broadcast_rows
    heads = heads.join(F.broadcast(sizes) if few else sizes, "_label").select("rep", "copies", "_size", "_label", "v", F.size("v").alias("_dims"))
    some = heads.where((F.col("_size") > window + 1) & (F.pmod(F.xxhash64("rep", "v"), F.lit(1 << 40)) < F.lit(float(sample)) / F.col("_size") * float(1 << 40)))
    frames = some.groupBy("_label", "_dims").applyInPandas(_frame(threshold, window, recall, bits, seed, most_passes), "_label string, _dims int, _mean array<double>, _passes int")
    frames = materialize(frames, "frames")
    heads = heads.join(frames, ["_label", "_dims"], "left").select("rep", "copies", "_size", "_label", "v", "_mean", "_passes")
    heads = materialize(heads.mapInArrow(_hashed(threshold, window, recall, bits, seed), "rep long, copies long, space string, v binary, hashes array<binary>"), "hashes")

    found = _window_pairs(heads, threshold, window, segment)
    families = materialize(components(materialize(found, "pairs").distinct(), "vectors").select(F.col("node").alias("rep"), "component"), "families")

    # all links of a family, in blocks
    placed = heads.join(families, "rep").select("rep", "copies", "v", "component")
    blocks = families.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = placed.join(blocks, "component").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("component", "rep", "copies", "v", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    links = sent.groupBy("component", "x", "y").applyInPandas(_count(threshold), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    out = members.select("vec_id", "rep", "copies").join(families, "rep", "left").join(links, "rep", "left")
    component = F.coalesce("component", "rep", "vec_id")
    n = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    return out.select("vec_id", n.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _frame(threshold: float, window: int, recall: float, bits: int, seed: int, most: int):
    """Of a label's sample: the mean of unit vectors, and the passes that its pairs ask for."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(rows["v"])
        m /= np.abs(m).max(1, keepdims=True)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        n = int(rows["_size"].iloc[0])
        passes = measured_passes(m, n, projections(4, bits, m.shape[1], seed), threshold, window, recall, most, seed)
        return pd.DataFrame({"_label": rows["_label"].iloc[:1], "_dims": [m.shape[1]], "_mean": [m.mean(0)], "_passes": [max(passes, passes_for(n, threshold, window, recall))]})

    return run


def _hashed(threshold: float, window: int, recall: float, bits: int, seed: int):
    """Unit vectors as bytes and a string of sign bits for each pass of their label; vectors of other lengths are another
    space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        passes: dict[int, int] = {}
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            vectors = [np.array(x, float) for x in batch.column(4).to_pylist()]
            fitted, means = batch.column(6).to_pylist(), batch.column(5)
            own = [p or (passes[x] if x in passes else passes.setdefault(x, passes_for(x, threshold, window, recall))) for x, p in zip(batch.column(2).to_pylist(), fitted, strict=True)]
            for n, count in {(len(x), c) for x, c in zip(vectors, own, strict=True)}:
                at = [k for k, x in enumerate(vectors) if (len(x), own[k]) == (n, count)]
                m = np.stack([vectors[k] for k in at])
                m /= np.abs(m).max(1, keepdims=True)
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                if (n, count) not in planes:
                    planes[n, count] = projections(count, bits, n, seed).reshape(-1, n)
                apart = m - np.stack([np.zeros(n) if means[k].as_py() is None else np.array(means[k].as_py()) for k in at])
                signs = np.packbits((apart @ planes[n, count].T > 0).reshape(len(at), count, bits), axis=2)
                for k, v, s in zip(at, m, signs, strict=True):
                    label = batch.column(3)[k].as_py()
                    for to, x in zip(out, (batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), f"{n}:{label}", v.tobytes(), [b.tobytes() for b in s]), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.binary())), strict=True)], ["rep", "copies", "space", "v", "hashes"])

    return run


def _window_pairs(heads: DataFrame, threshold: float, window: int, segment: int, slice_rows: int = 100_000) -> DataFrame:
    """Pairs (a, b) that join all that verified pairs join: those among each vector's `window` successors in its pass's order.

    The orders of all passes are range-sorted into slices by hash and id, which bounds a slice by its rows whatever the
    hashes are; ranks in a slice and the counts of the slices before it give a place. Places are cut into segments of
    bounded size, and each segment's last vectors also go to the next one. Vectors join once they have a segment.
    """
    keyed = heads.select("rep", "space", F.posexplode("hashes").alias("pass", "hash"))
    number = int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(number, -(-keyed.count() // slice_rows))
    slices = keyed.repartitionByRange(n, "space", "pass", "hash", "rep").withColumn("slice", F.spark_partition_id())
    slices = materialize(slices, "order")
    order = Window.partitionBy("space", "pass", "slice").orderBy("hash", "rep")
    counts = slices.groupBy("space", "pass", "slice").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("space", "pass").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    ranked = slices.withColumn("r", F.row_number().over(order)).join(starts, ["space", "pass", "slice"])
    ranked = ranked.withColumn("r", F.col("r") + F.col("before") - 1)
    own = F.floor(F.col("r") / segment)
    into = F.when(F.col("r") % segment >= segment - window, F.array(own, own + 1)).otherwise(F.array(own))
    placed = ranked.select("space", "pass", "r", "rep", F.explode(into).alias("segment"))
    dealt = placed.join(heads.select("rep", "space", "v"), ["rep", "space"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("r")
        m = np.stack([np.frombuffer(x, np.float64) for x in rows["v"]])
        ids, root = rows["rep"].to_numpy(), np.arange(len(m))
        for at in range(0, len(m), window):  # a stretch of the window's width against itself and the next one
            x, y = np.nonzero(m[at : at + window] @ m[at : at + 2 * window].T >= threshold)
            _unite(root, x[x < y] + at, y[x < y] + at)
        far = np.flatnonzero(root != np.arange(len(m)))
        one, two = ids[far], ids[root[far]]
        return pd.DataFrame({"a": np.maximum(one, two), "b": np.minimum(one, two)}, dtype="int64")

    return dealt.groupBy("space", "pass", "segment").applyInPandas(run, "a long, b long")


def _unite(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the sets of x and y, pair by pair; root: of each place the least one of its set."""
    while len(x):
        a, b = root[x], root[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up


def _count(threshold: float):
    """Links between two blocks of a family, or within one; a copy counts as a vector."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        m = np.stack([np.frombuffer(x, np.float64) for x in rows["v"]])
        first = (rows["own"] == rows["x"]).to_numpy()
        copies, ids = rows["copies"].to_numpy(), rows["rep"].to_numpy()
        if rows["x"].iloc[0] == rows["y"].iloc[0]:
            hit = m @ m.T >= threshold
            np.fill_diagonal(hit, False)
            return pd.DataFrame({"rep": ids, "links": hit @ copies})
        hit = m[first] @ m[~first].T >= threshold
        return pd.DataFrame({"rep": np.concatenate((ids[first], ids[~first])), "links": np.concatenate((hit @ copies[~first], copies[first] @ hit))})

    return run
