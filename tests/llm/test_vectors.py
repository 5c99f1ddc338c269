"""Exact search, clustering and hard negatives against plain loops, on vectors with every oddity."""

import hashlib
import math
import os
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tamis.llm.vectors")

from tamis.llm import centroids, negatives, topk, vectors  # noqa: E402

SHAPE = "vec_id long, embedding array<double>, label int, block string, place string, score string, group string"


def odd_rows(dims=6, n=240, seed=5):
    """Ties, copies (a third of all rows), repeated and null ids, nulls, non-finite values, other lengths, large values."""
    rng = np.random.default_rng(seed)
    rows = [(k, np.round(rng.standard_normal(dims), 1).tolist(), int(k % 5)) for k in range(n)]
    rows += [(1000 + k, [0.5] * dims, int(k % 3)) for k in range(n // 2)]
    rows += [(50, rows[3][1], 1), (50, rows[3][1], 1), (100, [0.0] * dims, 2), (None, rows[7][1], 2), (None, None, None)]
    rows += [(200, None, 1), (300, [None] * dims, 1), (400, [math.nan] * dims, 0), (500, [math.inf] + [0.0] * (dims - 1), 0), (600, [], 1), (700, [], 2), (800, [1.0, 2.0], 1), (850, [1.0, 3.0], 1), (900, [1.0, -2.0], 2), (950, [1e4] * dims, 3), (1000, rows[1][1], None)]
    return rows


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "b", "p", "s", "g") for r in rows], SHAPE).repartition(parts)


def whole(v, scale):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(scale * x) for x in v]


def first(candidates, k):
    """Highest scores first, ties by id, null last; candidates are (score, id)."""
    return sorted(candidates, key=lambda c: (-c[0], c[1] is None, c[1] or 0))[:k]


def plain_top(rows, every, k, scale):
    held = [(i, v) for i, v in ((i, whole(v, scale)) for i, v, *_ in rows) if v is not None]
    out = []
    for a, (i, q) in enumerate(held):
        if i is not None and i % every == 0:
            best = first([(sum(map(int.__mul__, q, x)), j) for b, (j, x) in enumerate(held) if a != b and len(x) == len(q)], k)
            out += [(i, rank, j, s) for rank, (s, j) in enumerate(best, 1)]
    return out


def in_order(rows):
    return sorted(tuple((x is None, x) if x is None or isinstance(x, (int, str)) else x for x in r) for r in rows)


@pytest.mark.parametrize(("size", "bins"), [(1 << 20, 4_096), (24 * 16, 64)])
def test_top_k_is_the_plain_loop_s(spark, monkeypatch, size, bins):
    """Whole blocks and small ones, few rounds and many; a third of all rows are copies, so ties pass every block."""
    monkeypatch.setattr(topk, "blocks_of", partial(vectors.blocks_of, block_bytes=size))
    monkeypatch.setattr(topk, "picked", partial(vectors.picked, per_group=3))
    rows = odd_rows()
    got = topk.top_k(table(spark, rows), F.col("vec_id") % 50 == 0, k=7, bins=bins).collect()
    assert in_order(got) == in_order(plain_top(rows, 50, 7, 1_024))


def test_top_k_without_rows_or_candidates(spark):
    shape = "vec_id long, embedding array<float>, label int"
    asked = F.col("vec_id") % 100 == 0
    assert not topk.top_k(spark.createDataFrame([], shape), asked).collect()
    assert not topk.top_k(spark.createDataFrame([(100, [1.0], 1)], shape), asked).collect()
    assert not topk.top_k(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 1)], shape), asked).collect()
    assert [tuple(r) for r in topk.top_k(spark.createDataFrame([(0, [], 1), (4, [], 1)], shape), asked).collect()] == [(0, 1, 4, 0)]


def test_products_and_the_best_of_rows_are_exact():
    rng = np.random.default_rng(0)
    for most in (100, 1 << 26):
        a, b = (rng.integers(-most, most + 1, (n, 7)).astype(np.int32) for n in (5, 300))
        scores = vectors.inner(a, b)
        assert all(int(scores[i, j]) == sum(int(x) * int(y) for x, y in zip(a[i], b[j], strict=True)) for i in range(5) for j in range(300))
        scores = scores // max(1, int(np.abs(scores).max()) // 5)  # many ties
        scores[:, ::7] = vectors.none_of(scores)
        row, column = vectors.best(scores, 4)
        for i in range(5):
            own = sorted(((-scores[i, j], j) for j in range(300) if j % 7), key=tuple)[:4]
            assert sorted(column[row == i].tolist()) == sorted(j for _, j in own)


def plain_clusters(rows, dims, k, rounds, scale, seed):
    held = [(i, v) for i, v in ((i, whole(v, scale)) for i, v, *_ in rows) if v is not None and len(v) == dims]
    start = sorted(held, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    middle = [v for _, v in start[:k]]
    square = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    for step in range(rounds + 1):
        own = [min(range(len(middle)), key=lambda c: (square(x, middle[c]), c)) for _, x in held]
        if step < rounds:
            for c in range(len(middle)):
                part = [x for (_, x), o in zip(held, own, strict=True) if o == c]
                if part:
                    middle[c] = [sum(column) // len(part) for column in zip(*part, strict=True)]
    far = [square(x, middle[c]) for (_, x), c in zip(held, own, strict=True)]
    return [(i, c, d, sum(e for e, o in zip(far, own, strict=True) if o == c), sum(far), hashlib.sha256(",".join(map(str, middle[c])).encode()).hexdigest()) for (i, _), c, d in zip(held, own, far, strict=True)]


@pytest.mark.parametrize(("k", "rounds", "size"), [(20, 6, 24 * 16), (1, 2, 24 * 16), (2, 0, 1), (1000, 2, 1 << 20)])
def test_clusters_are_the_plain_loop_s(spark, monkeypatch, k, rounds, size):
    monkeypatch.setattr(centroids, "blocks_of", partial(vectors.blocks_of, block_bytes=size))
    rows = odd_rows() if size > 1 and k < 1000 else odd_rows(n=30)
    got = centroids.cluster(table(spark, rows), dims=6, k=k, rounds=rounds).collect()
    assert in_order(got) == in_order(plain_clusters(rows, 6, k, rounds, 1_024, "3"))


def test_clusters_of_no_rows(spark):
    shape = "vec_id long, embedding array<float>"
    assert not centroids.cluster(spark.createDataFrame([], shape)).collect()
    assert not centroids.cluster(spark.createDataFrame([(1, [1.0] * 63), (2, None)], shape)).collect()
    assert [r.cluster for r in centroids.cluster(spark.createDataFrame([(1, [1.0] * 64)], shape)).collect()] == [0]


def test_bounds_save_distances_and_hold():
    """Assignments equal a full scan each round, lower bounds never pass a distance, and most distances aren't computed."""
    rng = np.random.default_rng(3)
    k, dims, n = 32, 8, 3_000
    means = rng.integers(-1_000, 1_000, (k, dims))
    x = (means[rng.integers(0, k, n)] + rng.normal(0, 60, (n, dims))).astype(np.int64)
    x[: n // 3] = x[0]
    now = x[rng.choice(np.arange(n // 3, n), k, replace=False)]
    bounds = centroids.Bounds.of(x, now, k // 4)
    assert bounds.measured == n * k
    computed, listed = 0, k // 4
    for step in range(12):
        new = np.array([x[bounds.assigned == c].sum(0) // max(1, (bounds.assigned == c).sum()) if (bounds.assigned == c).any() else now[c] for c in range(k)])
        moved = np.sqrt(((new - now) ** 2).sum(1)) * (1 + centroids.SLACK)
        bounds.measured, now = 0, new
        if step:
            listed = max(k // 8, min(listed, bounds.needed))
        bounds.keep(listed)
        bounds.move(x, now, moved)
        full = centroids.squares(x, now)
        assert (bounds.assigned == full.argmin(1)).all()
        far = np.sqrt(full)
        assert (np.take_along_axis(far, bounds.assigned[:, None], 1)[:, 0] <= bounds.upper * (1 + 1e-9) + 1e-6).all()
        rest = far.copy()
        np.put_along_axis(rest, bounds.assigned[:, None], np.inf, 1)
        assert (np.take_along_axis(rest, bounds.order, 1) >= bounds.lower[:, :-1] - 1e-6).all()
        np.put_along_axis(rest, bounds.order, np.inf, 1)
        assert (rest.min(1) >= bounds.lower[:, -1] - 1e-6).all()
        computed += bounds.measured
    assert computed < 12 * n * k / 4


def plain_negatives(rows, every, positives, count, low, high, scale):
    held = [(i, v, y) for i, v, y in ((i, whole(v, scale), y) for i, v, y in rows) if v is not None and y is not None]
    out = []
    for a, (i, q, y) in enumerate(held):
        if i is None or i % every:
            continue
        scored = [(sum(map(int.__mul__, q, x)), j, z == y) for b, (j, x, z) in enumerate(held) if a != b and len(x) == len(q)]
        for p, j in first([(s, j) for s, j, same in scored if same], positives):
            found = first([(s, n) for s, n, same in scored if not same and low * p <= 100 * s <= high * p], count)
            out += [(i, j, rank, n, p, s) for rank, (s, n) in enumerate(found, 1)]
    return out


@pytest.mark.parametrize(("size", "pivots", "per_group"), [(24 * 16, 4, 2), (24 * 40, 1, 512)])
def test_negatives_are_the_plain_loop_s(spark, monkeypatch, size, pivots, per_group):
    monkeypatch.setattr(negatives, "blocks_of", partial(vectors.blocks_of, block_bytes=size))
    monkeypatch.setattr(negatives, "picked", partial(vectors.picked, per_group=per_group))
    rows = odd_rows()
    got = negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 50 == 0, pivots=pivots).collect()
    assert in_order(got) == in_order(plain_negatives(rows, 50, 5, 3, 50, 95, 256))


def test_keys_spare_blocks_where_vectors_crowd(spark, monkeypatch):
    """Far groups of vectors: the pairs of group and block that are scanned are few of all, and nothing is lost."""
    monkeypatch.setattr(negatives, "blocks_of", partial(vectors.blocks_of, block_bytes=4 * 4 * 20))
    rng = np.random.default_rng(1)
    means = rng.normal(0, 4, (40, 4))
    rows = [(k, (means[k % 40] + rng.normal(0, 0.05, 4)).tolist(), k // 40 % 2) for k in range(1_600)]
    made = []
    monkeypatch.setattr(negatives, "materialize", lambda df, name, put=negatives.materialize: made.append((name, put(df, name))) or made[-1][1])
    got = negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 50 == 0, pivots=40).collect()
    assert in_order(got) == in_order(plain_negatives(rows, 50, 5, 3, 50, 95, 256))
    tables = dict(made)
    blocks = 1_600 // 20
    scanned = sum(t.count() for name, t in made if name == "pairs")
    assert scanned < 2 * tables["groups"].count() * blocks * 0.6


def test_negatives_of_no_rows(spark):
    shape = "vec_id long, embedding array<double>, label int"
    asked = F.col("vec_id") % 50 == 0
    assert not negatives.hard_negatives(spark.createDataFrame([], shape), asked).collect()
    assert not negatives.hard_negatives(spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 2)], shape), asked).collect()
    rows = [(50, [1.0], 1), (51, [1.0], 1), (52, [0.7], 2), (53, [0.7], 2), (54, [1.0], 2)]
    assert [tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(rows, shape), asked, scale=10).collect()] == [(50, 51, 1, 52, 100, 70), (50, 51, 2, 53, 100, 70)]


@pytest.mark.parametrize("crowd", [0.0, 0.5, 0.7])
def test_measured_passes_meet_pairs_where_vectors_crowd(crowd):
    """Pairs planted at the threshold among 20,000 vectors whose mean cosine is `crowd`: nine in ten meet in some pass."""
    from tamis.llm import embeddings

    n, dims, window = int(os.environ.get("CROWD_ROWS", 20_000)), 64, 512
    rng = np.random.default_rng(int(100 * crowd))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    x = unit(math.sqrt(crowd) * unit(rng.standard_normal((1, dims))) + math.sqrt(1 - crowd) * unit(rng.standard_normal((n, dims))))
    own, t = x[:1_000], 0.9305
    w = rng.standard_normal(own.shape)
    w = unit(w - (w * own).sum(1, keepdims=True) * own)
    x = np.concatenate((x, t * own + math.sqrt(1 - t * t) * w))
    sample = x[rng.choice(len(x), 2_000, replace=False)]
    planes = embeddings.projections(64, 48, dims, 6)
    passes = max(embeddings.measured_passes(sample, len(x), planes[:4], 0.93, window, 0.95, 64, 6), embeddings.passes_for(len(x), 0.93, window, 0.95))
    met = np.zeros(len(own), bool)
    for plane in planes[:passes]:
        order = np.argsort(embeddings.keys_of(x - sample.mean(0), plane), kind="stable")
        rank = np.empty(len(x), int)
        rank[order] = np.arange(len(x))
        met |= np.abs(rank[: len(own)] - rank[n:]) <= window
    assert met.mean() >= 0.9 and passes < 40
