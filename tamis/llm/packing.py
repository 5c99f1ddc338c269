"""Packing documents into token sequences: vector bin packing under limits on tokens, segments and loss-bearing tokens.

A sequence is a bin with three capacities. What goes into an open bin next is the waiting document whose demand has the
largest dot product with what the bin has left, each as a share of the capacity, among those that fit. Documents may be
cut anywhere, so when none fits, the head of the largest fills the bin. Packing happens where the documents are read, in
blocks of bounded size, so nothing is shuffled; what a block can't fill is carried into the next one, and what is left at
the end of a partition is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import column_or_null
from tamis.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
END_ID = 1


class Packer:
    """Packs (document, ids) into sequences; `pieces` gets (doc, start, length, sequence, offset, loss tokens)."""

    def __init__(self, tokens: int, segments: int, loss: int, block: int):
        self.limits = np.array([tokens, segments, loss], float)
        self.tokens, self.segments, self.loss, self.block = tokens, segments, loss, block
        self.sequence, self.waiting, self.pieces = 0, [], []

    def add(self, doc: int, n: int, loss_from: int) -> None:
        """Whole sequences of a long document are cut off at once; the rest waits."""
        at = 0
        while n - at >= self.tokens and min(n, at + self.tokens) - max(at, min(loss_from, at + self.tokens)) <= self.loss:
            self._put(doc, at, self.tokens, 0, loss_from)
            self.sequence += 1
            at += self.tokens
        if at < n:
            self.waiting.append([doc, at, n, loss_from])
        if len(self.waiting) >= self.block:
            self.pack()

    def _put(self, doc: int, at: int, length: int, offset: int, loss_from: int) -> int:
        bears = max(0, at + length - max(at, loss_from))
        self.pieces.append((doc, at, length, self.sequence, offset, bears))
        return bears

    def pack(self, last: bool = False) -> None:
        """Fills sequences from the documents that wait, until less than one sequence waits (last: until none does)."""
        items = self.waiting
        if not items:
            return
        where = np.array([(at, n, loss) for _, at, n, loss in items], np.int64)
        size = where[:, 1] - where[:, 0]
        bears = np.maximum(0, where[:, 1] - np.maximum(where[:, 0], where[:, 2]))
        demand = np.stack([size / self.limits[0], np.full(len(items), 1 / self.limits[1]), bears / self.limits[2]], 1)
        total = int(size.sum())
        while total >= self.tokens or last and total:
            if total < self.tokens and total <= self.loss and int((size > 0).sum()) <= self.segments:
                self._powers(items, size)
                total = 0
                break
            room, slots, loss, offset = self.tokens, self.segments, self.loss, 0
            while room and slots and total:
                fits = (size > 0) & (size <= room) & (bears <= loss)
                left = np.array([room, slots, loss]) / self.limits
                if fits.any():
                    k = int(np.where(fits, demand @ left, -1.0).argmax())
                    length = int(size[k])
                else:  # cut the largest
                    k = int(size.argmax())
                    length = min(room, int(size[k]), max(0, items[k][3] - items[k][1]) + loss)
                    if not length:
                        break
                loss -= self._put(items[k][0], items[k][1], length, offset, items[k][3])
                items[k][1] += length
                size[k] -= length
                bears[k] = max(0, items[k][2] - max(items[k][1], items[k][3]))
                demand[k] = size[k] / self.limits[0], 1 / self.limits[1], bears[k] / self.limits[2]
                offset, room, slots, total = offset + length, room - length, slots - 1, total - length
            self.sequence += 1
        self.waiting = [x for x in items if x[1] < x[2]]

    def _powers(self, items: list, size: np.ndarray) -> None:
        """The last documents end to end, in sequences whose lengths are powers of two."""
        total = int(size.sum())
        room, offset = 1 << (total.bit_length() - 1), 0
        for k in np.flatnonzero(size):
            while size[k]:
                length = min(room, int(size[k]))
                self._put(items[k][0], items[k][1], length, offset, items[k][3])
                items[k][1] += length
                size[k] -= length
                offset, room, total = offset + length, room - length, total - length
                if not room:
                    self.sequence += 1
                    room, offset = (1 << (total.bit_length() - 1)) if total else 0, 0


def pack_documents(docs: DataFrame, tokens: int = 2048, segments: int = 256, loss: int | None = None, tokenizer: str | None = None, block: int = 512) -> DataFrame:
    """A row for each piece of each document of docs (doc_id, text, optional loss_from).

    A document is its text's ids and then END_ID; null and empty texts have that id alone. loss_from: its ids before this
    place bear no loss (null or no such column: all bear it). No sequence holds more than `tokens` ids, `segments`
    pieces or `loss` loss-bearing ids (None: as many as `tokens`). start, length: where the piece lies in its document;
    offset: where it lies in its sequence, without gaps from 0; ids_crc32: of its ids as little-endian unsigned 32-bit.
    A sequence's id holds the partition that made it. Null ids and repeated rows are packed like others, other columns
    aren't read, an empty table gives no rows. tokenizer: path of a tokenizers file, on every machine.
    """
    loss = tokens if loss is None else loss

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), Packer(tokens, segments, loss, block)
        base = TaskContext.get().partitionId() << 40
        end = np.array([END_ID], "<u4").tobytes()
        held: dict[int, tuple] = {}  # documents with pieces that wait
        count = 0

        def out() -> pa.RecordBatch:
            rows = [(held[d][0], at, n, zlib.crc32(memoryview(held[d][1])[4 * at : 4 * (at + n)]), len(held[d][1]) // 4, base + s, offset, bears) for d, at, n, s, offset, bears in packer.pieces]
            packer.pieces.clear()
            still = {x[0] for x in packer.waiting}
            for d in [d for d in held if d not in still]:
                del held[d]
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"])

        for batch in batches:
            ids = batch.column(0)
            for k in range(batch.num_rows):
                made = encode(batch.column(1)[k].as_py() or "") + end
                held[count] = ids[k].as_py(), made
                packer.add(count, len(made) // 4, batch.column(2)[k].as_py() or 0)
                count += 1
                if len(packer.pieces) >= 4096:
                    yield out()
        packer.pack(last=True)
        yield out()

    wanted = docs.select(F.col("doc_id").cast("long"), column_or_null(docs, "text", "string").alias("text"), column_or_null(docs, "loss_from", "long").alias("loss_from"))
    return wanted.mapInArrow(run, SCHEMA)
