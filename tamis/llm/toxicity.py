"""Toxicity: a linear model over character n-grams, each scaled by its naive Bayes log-count ratio (Wang & Manning, 2012).

Learning reads a bounded sample of labelled documents in two passes: document counts of hashed n-grams for each label give
the ratios and which n-grams tell the labels apart; a logistic model is then fitted to those n-grams' scaled presences.
Scoring reads every whole text once and looks each n-gram's weight up in a table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import U64, column_or_null, mix
from tamis.llm.quality import fit_logistic

_STEP = U64(0x100000001B3)
#: Characters of texts that are hashed at a time; a longer text is hashed alone.
RUN_CHARACTERS = 1 << 18


@dataclass
class Model:
    """Weight of each hashed n-gram (zero: not used) and intercept."""

    weights: np.ndarray
    intercept: float
    sizes: tuple[int, ...]
    bits: int


def runs(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    at, held, n = 0, [], 0
    for k, text in enumerate(texts):
        text = " ".join((text or "").lower().split())
        if held and n + len(text) > RUN_CHARACTERS:
            yield at, held
            at, held, n = k, [], 0
        held.append(text)
        n += len(text)
    if held:
        yield at, held


def ngrams(texts: list[str], sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: hashed n-grams within the texts (white space as one space, one at both ends), and their texts."""
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)
    length = np.array([len(t) + 2 for t in texts])
    owner, ends = np.repeat(np.arange(len(texts)), length), np.repeat(np.cumsum(length), length)
    h = np.zeros(len(points), U64)
    for n in range(1, max(sizes) + 1):
        if len(points) < n:
            return
        h = h[: len(points) - n + 1] * _STEP + points[n - 1 :] + U64(n)
        if n in sizes:
            inside = np.arange(len(h)) + n <= ends[: len(h)]
            yield (mix(h[inside]) >> U64(64 - bits)).astype(np.int64), owner[: len(h)][inside]


def _present(texts: list[str], sizes: tuple[int, ...], bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, n-gram) of the texts, of wanted n-grams only; ordered by text."""
    found = []
    for grams, owner in ngrams(texts, sizes, bits):
        if wanted is not None:
            keep = wanted[grams]
            grams, owner = grams[keep], owner[keep]
        found.append(owner.astype(np.int64) << bits | grams)
    both = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return both >> bits, both & ((1 << bits) - 1)


def learn(labelled: DataFrame, sizes: tuple[int, ...] = (3, 4, 5, 6), bits: int = 20, evidence: float = 14.0, tasks: int = 16) -> Model:
    """A model of labelled (text, toxic 0 or 1), a bounded sample, over all n-grams whose log-likelihood ratio of label and
    presence is at least `evidence`."""
    labelled = labelled.select(column_or_null(labelled, "text", "string").alias("text"), F.col("toxic").cast("int").alias("toxic")).repartition(tasks)
    slices = 64
    width = (1 << bits) // slices

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((2, 1 << bits), np.int32), [0, 0]
        for batch in batches:
            y = np.array(batch.column(1).to_pylist())
            for at, texts in runs(batch.column(0).to_pylist()):
                owner, gram = _present(texts, sizes, bits)
                for label in (0, 1):
                    seen[label] += int((y[at : at + len(texts)] == label).sum())
                    total[label] += np.bincount(gram[y[at + owner] == label], minlength=1 << bits).astype(np.int32)
        if sum(seen):
            rows = [(s, total[:, s * width : (s + 1) * width].tobytes(), *(seen if s == 0 else (0, 0))) for s in range(slices)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["slice", "counts", "clean", "toxic"])

    def summed(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary()), "clean": pa.array([sum(table.column("clean").to_pylist())]), "toxic": pa.array([sum(table.column("toxic").to_pylist())])})

    kinds = "slice int, counts binary, clean long, toxic long"
    got = sorted(tuple(r) for r in labelled.mapInArrow(count, kinds).groupBy("slice").applyInArrow(summed, kinds).collect())  # 2 counts for each hashed n-gram
    if not got or not sum(r[2] for r in got) or not sum(r[3] for r in got):
        share = float(bool(got) and sum(r[3] for r in got) > 0)
        return Model(np.zeros(1 << bits, np.float32), 4.0 if share else -4.0, sizes, bits)
    n0, n1 = sum(r[2] for r in got), sum(r[3] for r in got)
    clean, toxic = (np.concatenate([np.frombuffer(r[1], np.int64).reshape(2, width)[k] for r in got]).astype(float) for k in (0, 1))
    ratio = np.log((toxic + 1) / (toxic + 1).sum()) - np.log((clean + 1) / (clean + 1).sum())
    expected = (clean + toxic) / (n0 + n1)
    xlog = lambda a, b: np.where(a > 0, a * np.log(np.maximum(a, 1e-9) / np.maximum(b, 1e-9)), 0)
    gain = 2 * (xlog(toxic, n1 * expected) + xlog(clean, n0 * expected) + xlog(n1 - toxic, n1 * (1 - expected)) + xlog(n0 - clean, n0 * (1 - expected)))
    wanted = gain >= evidence

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in runs(batch.column(0).to_pylist()):
                owner, gram = _present(texts, sizes, bits, wanted)
                cut = np.searchsorted(owner, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(texts)), pa.array([gram[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], ["toxic", "grams"])

    sample = sorted(tuple(r) for r in labelled.mapInArrow(rows, "toxic int, grams binary").collect())  # of the bounded sample
    grams = [np.frombuffer(g, np.int32) for _, g in sample]
    w, b = fit_logistic([(g, ratio[g]) for g in grams], np.array([y for y, _ in sample], float), 1 << bits, rounds=300, rate=0.05, ridge=1e-4)
    return Model((w * ratio).astype(np.float32), b, sizes, bits)


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    out = np.full(len(texts), model.intercept)
    used = model.weights != 0
    for at, part in runs(texts):
        owner, gram = _present(part, model.sizes, model.bits, used)
        out[at : at + len(part)] += np.bincount(owner, model.weights[gram], len(part))
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = 10_000, threshold: float = 0.5, **how) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score (0 to 1), predicted.

    A row is held out where crc32 of its doc_id as text is divisible by `folds`; labels (doc_id, toxic) of others are learned
    from: about `sample` of them, those with the least hashes of doc_id. Null labels aren't learned from; of several labels
    of a doc_id the highest counts. Null and empty texts get the score of a text without any n-gram known; a null doc_id is
    never learned from nor held out; repeated rows score alike. With one label only, everything gets that label.
    """
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(key % folds != 0)
    part = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000) + 1).limit(2 * sample)
    texts = docs.select(F.col("doc_id").cast("long"), column_or_null(docs, "text", "string").alias("text"))
    model = learn(texts.join(F.broadcast(chosen), "doc_id"), **how)  # at most 2 * sample rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(batch.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return texts.withColumn("held_out", F.coalesce(key % folds == 0, F.lit(False))).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
