"""What the exact vector operators share: whole-number components, blocks of vectors, exact products, the best of a row."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import materialize

#: Components saturate here, so that sums over up to 2,048 of their products fit a long.
LIMIT = 1 << 26
#: A block's vectors take about this many bytes at most.
BLOCK_BYTES = 2 << 20
#: Scores that a task holds at a time.
TILE = 1 << 21
#: A row's place is its block's number, shifted, and its place there.
SHIFT = 20


def whole_numbers(column: str, scale: int) -> Column:
    """floor(scale * x) of each component x as a double; null where the vector or a component is null or not finite."""
    v = F.col(column).cast("array<double>")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    bounded = lambda x: F.greatest(F.least(x * float(scale), F.lit(float(LIMIT))), F.lit(-float(LIMIT)))
    return F.when(sound, F.transform(v, lambda x: F.floor(bounded(x)).cast("int")))


def matrix(cell: pa.Scalar, dims: int, rows: int) -> np.ndarray:
    held = cell.as_buffer()
    return np.frombuffer(held, np.int32).reshape(rows, dims) if held.size else np.zeros((rows, dims), np.int32)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exact: in doubles where no sum passes 2 ** 53, else in longs."""
    most = [int(np.abs(m.astype(np.int64)).max(initial=0)) for m in (a, b)]
    if a.shape[1] * most[0] * most[1] < 1 << 53:
        return a.astype(float) @ b.astype(float).T
    return a.astype(np.int64) @ b.astype(np.int64).T


def none_of(scores: np.ndarray):
    """The value of `scores`' type that stands for no score."""
    return -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k highest scores, ties to the smaller column, without the ones that are none."""
    none = none_of(scores)
    if scores.shape[1] <= k:
        return np.nonzero(scores > none)
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    hit = (scores >= least) & (scores > none)
    over = np.flatnonzero(hit.sum(1) > k)
    if len(over):
        above, tie = scores[over] > least[over], scores[over] == least[over]
        room = k - above.sum(1, keepdims=True)
        hit[over] = above | tie & (np.cumsum(tie, 1, dtype=np.int32) <= room)
    return np.nonzero(hit)


def blocks_of(rows: DataFrame, name: str, keys: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rows (vec_id, v and other long or double columns) as a written table of blocks, numbered from 0 without a gap.

    A block's vectors have equal keys and as many components, and are in the order of their vec_id (null last). It has the
    columns block, dims, n, the keys, m (the vectors as 32-bit numbers), and every other column as a list. Blocks are made
    where rows lie, nothing is shuffled; what a task holds back is bounded by block_bytes.
    """
    lists = [c for c in rows.columns if c not in (*keys, "v")]
    kinds = dict(rows.dtypes)
    rows = rows.select(*keys, *lists, "v")

    def block(key: tuple, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts)
        whole = whole.take(pc.sort_indices(whole, sort_keys=[("vec_id", "ascending")], null_placement="at_end")).combine_chunks()
        dims = key[0]
        most = min(max(1, block_bytes // (4 * max(1, dims))), 1 << SHIFT)
        for lo in range(0, whole.num_rows, most):
            part = whole.slice(lo, most).combine_chunks()
            m = np.asarray(part.column("v").chunk(0).flatten(), np.int32) if dims else np.empty(0, np.int32)
            columns = [pa.array([dims], pa.int32()), pa.array([part.num_rows], pa.int32())]
            columns += [part.column(c).chunk(0)[:1] for c in keys]
            columns += [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c).chunk(0)) for c in lists]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([m.tobytes()], pa.binary())], ["dims", "n", *keys, *lists, "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[pa.RecordBatch]] = defaultdict(list)
        size: dict[tuple, int] = defaultdict(int)
        for batch in batches:
            dims = np.asarray(pc.list_value_length(batch.column(batch.num_columns - 1)))
            own = list(zip(dims.tolist(), *(batch.column(k).to_pylist() for k in range(len(keys))), strict=True))
            places = defaultdict(list)
            for k, key in enumerate(own):
                places[key].append(k)
            for key, at in places.items():
                held[key].append(batch if len(at) == batch.num_rows else batch.take(pa.array(at)))
                size[key] += len(at) * 4 * max(1, key[0])
            while sum(size.values()) >= block_bytes:
                key = max(size, key=size.__getitem__)
                yield from block(key, held.pop(key))
                del size[key]
        for key, parts in held.items():
            yield from block(key, parts)

    shape = ["dims int", "n int", *(f"{c} {kinds[c]}" for c in keys), *(f"{c} array<{kinds[c]}>" for c in lists), "m binary"]
    made = rows.mapInArrow(run, ", ".join(shape)).withColumn("_made", F.monotonically_increasing_id())
    made = materialize(made, name)
    # the tasks' numbers of blocks, one row for each task
    tasks = made.groupBy(F.shiftright("_made", 33).alias("task")).count().collect()
    starts, n = [], 0
    for task, count in sorted(tasks):
        starts.append((task, n - (task << 33)))
        n += count
    first = F.broadcast(made.sparkSession.createDataFrame(starts, "_task long, _first long"))
    made = made.withColumn("_task", F.shiftright("_made", 33)).join(first, "_task")
    return made.withColumn("block", F.col("_made") + F.col("_first")).drop("_made", "_task", "_first")


def picked(blocks: DataFrame, flag: str, per_group: int = 512) -> Iterator:
    """What takes the flagged rows of blocks, in groups of up to per_group rows of a block: for mapInArrow over all columns.

    Gives the block's columns, lists and m of the flagged rows alone, and place, where each of them lies.
    """
    names = [c for c in blocks.columns if c != flag]
    kinds = dict(blocks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cell = {c: batch.column(batch.schema.get_field_index(c))[r] for c in batch.schema.names}
                at = np.flatnonzero(np.asarray(cell[flag].values.to_pylist(), bool)) if len(cell[flag]) else np.empty(0, np.int64)
                m = matrix(cell["m"], cell["dims"].as_py(), cell["n"].as_py())
                for lo in range(0, len(at), per_group):
                    own = at[lo : lo + per_group]
                    out = []
                    for c in names:
                        if c == "m":
                            out.append(pa.array([m[own].tobytes()], pa.binary()))
                        elif c == "n":
                            out.append(pa.array([len(own)], pa.int32()))
                        elif kinds[c].startswith("array"):
                            taken = cell[c].values.take(pa.array(own))
                            out.append(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), taken))
                        else:
                            out.append(pa.array([cell[c].as_py()], cell[c].type))
                    place = pa.array((cell["block"].as_py() << SHIFT) + own)
                    out.append(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), place))
                    yield pa.RecordBatch.from_arrays(out, [*names, "place"])

    return blocks.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in names), "place array<bigint>"]))
