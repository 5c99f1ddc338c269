"""Near-duplicate documents by MinHash with tensored banding, checked on full shingle sets.

Tensored banding: `collections` small collections of `rows` minimum hashes each. A table's key combines a pair of
collections, so collections * (collections - 1) / 2 tables of 2 * rows hashes cost only collections * rows hashes, about
the square root of what as many tables of their own would.

1. Documents with equal shingle sets become one class (hot groups of copies end here, by a grouped minimum).
2. Classes that share a table's key are candidates; a star from each key's smallest member joins them, so a key costs as
   many links as it has members. Components of these links are families.
3. Within a family, links are found on full sets, in blocks: members are dealt by size class (a factor of 1 / threshold
   each, so links join equal or neighbouring classes) and by hash into blocks of bounded weight, and each pair of blocks
   is one task that returns only links that join what it hasn't joined yet.
4. Components of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import U64, Run, column_or_null, components, materialize, mix, seeds, window_hashes, word_runs

_ONE_WORD = U64(0xA5A5A5A5DEADBEEF)


def shingle_sets(run: Run, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts of a run, end to end and sorted within a text, and where each text's begin.

    A text with fewer words than a shingle has its whole sequence as one shingle; one without words has none.
    """
    hashes = window_hashes(run.hashes, words)
    count = np.diff(run.first)
    sets = []
    for k, n in enumerate(count):
        at = run.first[k]
        if n >= words:
            sets.append(np.unique(hashes[at : at + n - words + 1]))
        elif n:
            sets.append(window_hashes(run.hashes[at : at + n], int(n)) ^ _ONE_WORD)
        else:
            sets.append(np.empty(0, U64))
    bounds = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=bounds[1:])
    return (np.concatenate(sets) if sets else np.empty(0, U64)), bounds


def signatures(docs: DataFrame, words: int = 5, collections: int = 16, rows: int = 3) -> DataFrame:
    """doc_id, n_shingles, two fingerprints of the set, and a hash of each collection of minimum hashes."""
    scale, shift = seeds(collections * rows, 1) | U64(1), seeds(collections * rows, 2)
    names = ["doc_id", "n_shingles", "fp1", "fp2", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in word_runs(batch.column(1), lower=True):
                values, bounds = shingle_sets(part, words)
                size = np.diff(bounds)
                n, full = len(size), np.flatnonzero(size)
                fp1, fp2, sig = np.zeros(n, U64), np.zeros(n, U64), np.zeros((n, collections), U64)
                if len(full):
                    at = bounds[:-1][full]
                    fp1[full] = np.add.reduceat(values, at)
                    fp2[full] = np.bitwise_xor.reduceat(mix(values + U64(11)), at)
                    for c in range(collections):
                        own = np.full(len(full), U64(c))
                        for r in range(c * rows, (c + 1) * rows):
                            least = np.minimum.reduceat((values * scale[r]) ^ shift[r], at)
                            own = mix(own * U64(31) + least)
                        sig[full, c] = own
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * collections), pa.array(sig.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, n), pa.array(size), pa.array(fp1.view(np.int64)), pa.array(fp2.view(np.int64)), lists], names)

    wanted = docs.select(F.col("doc_id").cast("long"), column_or_null(docs, "text", "string").alias("text"))
    return wanted.mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, sig array<long>")


def _roots(parent: np.ndarray, k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return k


def links_between(sets: list[np.ndarray], split: int, percent: int) -> list[tuple[int, int]]:
    """Links (100 * intersection >= percent * union) that join all that such links join: among the first `split` sets, and
    from them to the others; with split = len(sets), among all. Overlaps are counted over posting lists."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    edge = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True])))
    first, last = edge[:-1], edge[1:]
    places = np.empty(len(order), np.int64)
    places[order] = np.repeat(np.arange(len(first)), last - first)  # each set's shingles as lists of owners
    bounds = np.concatenate(([0], np.cumsum(size)))
    parent, found = np.arange(n), []
    within = split == n
    for k in range(split):
        own = places[bounds[k] : bounds[k + 1]]
        starts, counts = first[own], last[own] - first[own]
        counts_total = int(counts.sum())
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts_total)
        shared = np.bincount(owner[at], minlength=n)
        hit = 100 * shared >= percent * (size + size[k] - shared)
        hit[: k + 1 if within else split] = False
        for j in np.flatnonzero(hit & (size > 0)):
            a, b = _roots(parent, k), _roots(parent, int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((k, int(j)))
    return found


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    collections: int = 16,
    rows: int = 3,
    block_shingles: int = 400_000,
    salts: int = 32,
) -> DataFrame:
    """Per document of docs (doc_id, text): n_shingles, component_id, kept.

    A text is lower-cased (A-Z), its words are runs of bytes other than space and 0x09-0x0D, its set the distinct
    shingles of `words` words (fewer words: the whole sequence). Documents link where 100 * intersection >= percent *
    union; component_id is the smallest doc_id reachable, kept whether it is the own one. Null and empty texts have no
    shingles and link with nothing; repeated rows are rows of their own; a null doc_id links with nothing and has null
    component_id. Other columns aren't read; an empty table gives no rows. A pair at the threshold itself meets in some
    table with probability 0.9998, and in any case where others join its family.
    salts: shares in which the copies of one set look up their class.
    """
    signed = materialize(signatures(docs, words, collections, rows), "signatures")
    alike = ["fp1", "fp2", "n_shingles"]
    sound = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    # only sets of several documents have a class to look up
    heads = signed.where(sound).groupBy(*alike).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top"))
    heads = materialize(heads.where("rep <> top").drop("top"), "heads")
    # sorted, not broadcast: Spark would go by the table's size before its rows are repeated
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    salted = signed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    members = salted.join(heads, [*alike, "salt"], "left")
    members = members.withColumn("rep", F.when(sound, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    own = F.when(F.col("doc_id") == F.col("rep"), F.col("sig")).alias("sig")
    members = materialize(members.select("doc_id", "n_shingles", "rep", own), "members")
    classes = members.where("doc_id = rep and n_shingles > 0")

    pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in range(collections) for i in range(j)))
    at = lambda p, k: F.element_at("sig", p[k] + 1)
    keys = F.transform(pairs, lambda p: F.xxhash64(p["i"], p["j"], at(p, "i"), at(p, "j")))
    # a row becomes many here, so a task should have few
    few = classes.select("rep", "sig").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = few.select("rep", F.explode(keys).alias("key"))
    tables = keyed.groupBy("key").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b <> top")
    tables = materialize(tables.select("key", "b"), "tables")  # a join of plain tables is one whose hot keys Spark splits
    stars = keyed.join(tables, "key").where("rep <> b").select(F.col("rep").alias("a"), "b")
    families = materialize(components(stars, "families"), "families")

    # sets of families' members, by family, size class and block
    step = -math.log(percent / 100)
    found = families.join(classes.select(F.col("rep").alias("node"), "n_shingles").distinct(), "node").withColumn("size_class", F.floor(F.log("n_shingles") / step).cast("int"))
    weight = found.groupBy("component", "size_class").agg(F.sum("n_shingles").alias("w")).select("component", "size_class", F.ceil(F.col("w") / block_shingles).cast("int").alias("blocks"))
    around = weight.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("size_class", "blocks"))).alias("blocks"))
    placed = found.join(around, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.element_at("blocks", F.col("size_class")).cast("long")).cast("int"))
    placed = placed.select(F.col("node").alias("doc_id"), "component", "size_class", "block", F.element_at("blocks", F.col("size_class")).alias("here"), F.coalesce(F.element_at("blocks", F.col("size_class") + 1), F.lit(0)).alias("above"), F.coalesce(F.element_at("blocks", F.col("size_class") - 1), F.lit(0)).alias("below"))
    texts = docs.select(F.col("doc_id").cast("long"), column_or_null(docs, "text", "string").alias("text"))
    sets = _sets_of(texts.join(placed, "doc_id"), words)
    edges = sets.groupBy("component", "task").applyInPandas(_links(percent), "a long, b long")
    joined = components(materialize(edges, "edges"), "links").select(F.col("node").alias("rep"), "component")
    out = members.join(joined, "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _sets_of(placed: DataFrame, words: int) -> DataFrame:
    """Each member's set, once for each pair of blocks that it takes part in (task: the pair; side: 0 or 1 of it)."""
    names = ["component", "task", "side", "doc_id", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {f: batch.column(k).to_pylist() for k, f in enumerate(batch.schema.names) if f != "text"}
            for part in word_runs(batch.column(1), lower=True):
                values, bounds = shingle_sets(part, words)
                out: list[list] = [[] for _ in names]
                for k in range(part.lo, part.hi):
                    c, b, held = column["size_class"][k], column["block"][k], values[bounds[k - part.lo] : bounds[k - part.lo + 1]].tobytes()
                    tasks = [(f"{c}:{min(b, o)}:{c}:{max(b, o)}", int(o < b)) for o in range(column["here"][k])]
                    tasks += [(f"{c}:{b}:{c + 1}:{o}", 0) for o in range(column["above"][k])]
                    tasks += [(f"{c - 1}:{o}:{c}:{b}", 1) for o in range(column["below"][k])]
                    for task, side in tasks:
                        for to, x in zip(out, (column["component"][k], task, side, column["doc_id"][k], held), strict=True):
                            to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names)

    return placed.select("doc_id", "text", "component", "size_class", "block", "here", "above", "below").mapInArrow(run, "component long, task string, side int, doc_id long, shingles binary")


def _links(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "doc_id"])
        sets, ids = [np.frombuffer(x, U64) for x in rows["shingles"]], rows["doc_id"].tolist()
        split = int((rows["side"] == 0).sum())
        c, b, d, e = rows["task"].iloc[0].split(":")
        links = links_between(sets, len(sets) if (c, b) == (d, e) else split, percent)
        return pd.DataFrame([(ids[i], ids[j]) for i, j in links], columns=["a", "b"], dtype="int64")

    return run
