"""Removing passages that an earlier document holds: level-wise doubling of repeated word windows.

A window of `length` words can repeat only if every shorter window inside it does. So windows are found from short to long
(3, 6 and 13 words for 13): each full window has one window of each level, content decides which. The first level's is the
one with the least hash of all inside, so that neighbouring full windows mostly share theirs; a level's holds the level's
before it and is about twice as long. At each level

1. documents, dealt to groups of bounded size, give the windows of this level, but only those of full windows whose window
   of the level before repeats;
2. hashes are counted over all documents, and a group gets back those of its own that stand in two documents.

At the last level a group also learns the least document of each hash: full windows that start in a smaller document go.
longest_repeats doubles on, beyond `length`, until no window repeats.

Hashes travel packed, as arrays for a bucket of hashes or a group of documents. A group names a hash once, with its least
document, however many of its documents hold it: a passage of a third of all documents costs a bucket one entry a group.
Groups and buckets follow the text's size, so a task's memory doesn't depend on the table's size or on how many partitions
there are. Hashes have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import U64, Run, column_or_null, materialize, window_hashes, word_runs

#: Words of the shortest windows at least, where full windows have twice as many.
SHORTEST = 3
#: Bytes of text in a group of documents; a bucket holds about as many hashes as a group has words.
GROUP_BYTES = 16 << 20
SENT = "bucket int, grp int, hashes binary, docs binary, again binary"
BACK = "grp int, hashes binary, docs binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def levels(length: int) -> list[int]:
    """Lengths of windows from the first level to full windows."""
    out = [length]
    while out[0] // 2 >= SHORTEST:
        out.insert(0, out[0] // 2)
    return out


def _least_at(values: np.ndarray, reach: int) -> np.ndarray:
    """Where the least of each `reach` consecutive values stands, the first of equal ones."""
    at, width = np.arange(len(values)), 1
    while width < reach:
        step = min(width, reach - width)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        width += step
    return at


def level_windows(run: Run, steps: list[int], level: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each full window within a text of the run: its first word, its text, and the hashes of its windows of the levels
    up to `level`."""
    length, n = steps[-1], len(run.hashes)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), [np.empty(0, U64)] * (level + 1)
    starts, text = np.arange(n - length + 1), run.word_text()[: n - length + 1]
    inside = starts + length <= run.first[text + 1]
    starts, text = starts[inside], text[inside]
    hashes = window_hashes(run.hashes, steps[0])
    at = _least_at(hashes, length - steps[0] + 1)[starts]
    found = [hashes[at]]
    for shorter, width in zip(steps, steps[1 : level + 1], strict=False):
        hashes = window_hashes(run.hashes, width)
        lo, hi = np.maximum(starts, at + shorter - width), np.minimum(starts + length - width, at)
        at = lo
        for k in range(1, int((hi - lo).max(initial=0)) + 1):
            other = np.minimum(lo + k, hi)
            at = np.where(hashes[other] < hashes[at], other, at)
        found.append(hashes[at])
    return starts, text, found


# ---------------------------------------------------------------- hashes on their way


def _cuts(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of equal values of a sorted array."""
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return zip(at.tolist(), [*at[1:].tolist(), len(key)], strict=True)


def _sent(hashes: list[np.ndarray], docs: list[np.ndarray], group: int, buckets: int) -> pa.Table:
    """Rows of SENT: each hash of a group once, with its least document and whether the group has it in another one."""
    h = np.concatenate(hashes) if hashes else np.empty(0, U64)
    d = np.concatenate(docs) if docs else np.empty(0, np.int64)
    rows: list[tuple] = []
    if len(h):
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        again = d[np.append(at[1:], len(h)) - 1] > d[at]
        h, d = h[at], d[at]
        bucket = (h % U64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, h, d, again = bucket[order], h[order], d[order], again[order]
        rows = [(int(bucket[a]), group, h[a:b].tobytes(), d[a:b].tobytes(), again[a:b].tobytes()) for a, b in _cuts(bucket)]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, kinds, strict=True)]
    return pa.table(columns, ["bucket", "grp", "hashes", "docs", "again"])


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _repeated(last: bool):
    """Of a bucket of SENT, the hashes that stand in two documents, for each group that sent one, with their least document;
    last: only for groups that hold a later one."""

    def run(table: pa.Table) -> pa.Table:
        h, d, again = _joined(table, "hashes", U64), _joined(table, "docs", np.int64), _joined(table, "again", bool)
        sizes = [len(x) // 8 for x in table.column("hashes").to_pylist()]
        group = np.repeat(np.array(table.column("grp").to_pylist(), np.int32), sizes)
        order = np.argsort(h, kind="stable")
        h, d, again, group = h[order], d[order], again[order], group[order]
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        count = np.diff(np.append(at, len(h)))
        least = np.repeat(np.minimum.reduceat(d, at), count)
        later = again | (d > least)
        keep = later if last else np.repeat(np.logical_or.reduceat(later, at), count)
        h, least, group = h[keep], least[keep], group[keep]
        order = np.argsort(group, kind="stable")
        h, least, group = h[order], least[order], group[order]
        rows = [(int(group[a]), h[a:b].tobytes(), least[a:b].tobytes() if last else b"") for a, b in _cuts(group)]
        columns = zip(list(zip(*rows, strict=True)) or [[]] * 3, (pa.int32(), pa.binary(), pa.binary()), strict=True)
        return pa.table([pa.array(c, t) for c, t in columns], ["grp", "hashes", "docs"])

    return run


def _known(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that a group got back, sorted, and their least documents (none but at the last level)."""
    h, d = _joined(table, "hashes", U64), _joined(table, "docs", np.int64)
    order = np.argsort(h, kind="stable")
    return h[order], d[order] if len(d) else d


def _among(hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each hash is among sorted ones, and where."""
    if not len(known):
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return known[at] == hashes, at


def _texts(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, Run]]:
    """The runs of a group's texts, with their documents' ids and whether these are known (null ids take part in nothing)."""
    for batch in table.to_batches(max_chunksize=2048):
        column = batch.column("doc_id")
        ids, known = column.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
        for part in word_runs(batch.column("text")):
            yield ids[part.lo : part.hi], known[part.lo : part.hi], part


def _first_level(steps: list[int], buckets: int):
    def run(table: pa.Table) -> pa.Table:
        h, d = [], []
        for ids, known, part in _texts(table):
            _, text, found = level_windows(part, steps, 0)
            keep = known[text]
            h.append(found[0][keep])
            d.append(ids[text[keep]])
        return _sent(h, d, table.column("grp")[0].as_py() if len(table) else 0, buckets)

    return run


def _next_level(steps: list[int], level: int, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        survive, h, d = _known(right)[0], [], []
        if len(survive):
            for ids, known, part in _texts(left):
                _, text, found = level_windows(part, steps, level)
                keep = known[text] & _among(found[level - 1], survive)[0]
                h.append(found[level][keep])
                d.append(ids[text[keep]])
        return _sent(h, d, left.column("grp")[0].as_py() if len(left) else 0, buckets)

    return run


def _doubled(width: int, buckets: int):
    """Windows of twice `width` words of which both halves repeat."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        survive, h, d = _known(right)[0], [], []
        if len(survive):
            for ids, known, part in _texts(left):
                starts, text, _ = level_windows(part, [2 * width], 0)
                halves = _among(window_hashes(part.hashes, width), survive)[0]
                keep = known[text] & halves[starts] & halves[starts + width]
                h.append(window_hashes(part.hashes, 2 * width)[starts[keep]])
                d.append(ids[text[keep]])
        return _sent(h, d, left.column("grp")[0].as_py() if len(left) else 0, buckets)

    return run


# ---------------------------------------------------------------- tables


def _grouped(docs: DataFrame, groups: int | None) -> tuple[DataFrame, int]:
    """Texts with the group that each document belongs to (null ids are spread by text), and how many there are."""
    texts = docs.select(F.col("doc_id").cast("long"), column_or_null(docs, "text", "string").alias("text"))
    if groups is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // GROUP_BYTES))
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text"))
    return texts.withColumn("grp", F.pmod(key, F.lit(groups)).cast("int")), groups


def _repeats(texts: DataFrame, groups: int, length: int, last: bool) -> DataFrame:
    """BACK rows of full windows."""
    steps, dealt = levels(length), texts.groupBy("grp")
    sent = dealt.applyInArrow(_first_level(steps, groups), SENT)
    back = sent.groupBy("bucket").applyInArrow(_repeated(last and len(steps) == 1), BACK)
    for k in range(1, len(steps)):
        sent = dealt.cogroup(back.groupBy("grp")).applyInArrow(_next_level(steps, k, groups), SENT)
        back = sent.groupBy("bucket").applyInArrow(_repeated(last and k == len(steps) - 1), BACK)
    return back


def longest_repeats(docs: DataFrame, length: int = 13, groups: int | None = None) -> DataFrame:
    """doc_id and longest: of the window lengths length, 2 * length, 4 * length and so on, the greatest at which a window of
    the document also stands in another one. Documents without any aren't listed; null ids and texts have none."""
    texts, n = _grouped(docs, groups)
    dealt, found, width = texts.groupBy("grp"), None, length
    back = materialize(_repeats(texts, n, length, False), f"windows-{width}")
    while True:
        here = dealt.cogroup(back.groupBy("grp")).applyInArrow(_holders(width), "doc_id long")
        here = here.withColumn("longest", F.lit(width).cast("long"))
        if back.isEmpty():
            break
        found = here if found is None else found.unionByName(here)
        sent = dealt.cogroup(back.groupBy("grp")).applyInArrow(_doubled(width, n), SENT)
        width *= 2
        back = materialize(sent.groupBy("bucket").applyInArrow(_repeated(False), BACK), f"windows-{width}")
    return (here if found is None else found).groupBy("doc_id").agg(F.max("longest").alias("longest"))


def _holders(width: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        survive, out = _known(right)[0], [np.empty(0, np.int64)]
        for ids, known, part in _texts(left) if len(survive) else ():
            _, text, found = level_windows(part, [width], 0)
            out.append(ids[text[known[text] & _among(found[0], survive)[0]]])
        return pa.table({"doc_id": pa.array(np.unique(np.concatenate(out)))})

    return run


def remove_repeats(docs: DataFrame, length: int = 13, keep_text: bool = False, groups: int | None = None) -> DataFrame:
    """Per document of docs (doc_id, text): n_words, n_removed, kept_sha256 and, with keep_text, kept_text.

    Words are runs of bytes other than space and 0x09-0x0D, unchanged. A word goes if a window of `length` words of its
    document covers it whose words also start in a document with a smaller doc_id, as the input has them. kept_sha256 is
    of the kept words joined by one space. Null and empty texts have no words (the digest of nothing), as have texts of
    white space; rows with the same doc_id count as one document when windows are compared; a null doc_id keeps its words
    and takes none from others. Other columns aren't read; an empty table gives no rows.
    groups: of documents, each held by a task at a time, and buckets of hashes (None: by the size of the texts).
    """
    texts, n = _grouped(docs, groups)

    def cleaned(left: pa.Table, right: pa.Table) -> pa.Table:
        (gone, least), rows = _known(right), []
        for ids, known, run in _texts(left):
            cover = np.zeros(len(run.hashes) + 1, np.int64)
            if len(gone):
                starts, text, found = level_windows(run, [length], 0)
                hit, at = _among(found[0], gone)
                hit = starts[hit & known[text] & (ids[text] > least[at])]
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + length, -1)
            kept = np.cumsum(cover[:-1]) == 0
            for k, i in enumerate(ids.tolist()):
                a, b = run.first[k], run.first[k + 1]
                words = run.data[run.offsets[k] : run.offsets[k + 1]].tobytes().split()
                removed = int(b - a - np.count_nonzero(kept[a:b]))
                text_kept = b" ".join(compress(words, kept[a:b].tolist()) if removed else words)
                digest = hashlib.sha256(text_kept).hexdigest()
                rows.append((i if known[k] else None, int(b - a), removed, digest, text_kept.decode() if keep_text else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, kinds, strict=True)]
        return pa.table(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    later = _repeats(texts, n, length, True)
    out = texts.groupBy("grp").cogroup(later.groupBy("grp")).applyInArrow(cleaned, RESULT)
    return out if keep_text else out.drop("kept_text")
