"""Matroska: files with one 8-bit PCM track per payload, and packet tables of any Matroska file.

Writing: EBML header, segment of known size with info, tracks, cues and clusters; a cluster holds simple blocks, a block up
to eight frames with fixed-size lacing, or EBML lacing where the last frame is shorter. Files depend on the payload alone.

Reading: elements have variable-length ids and sizes, known or unknown; blocks come alone or in groups, with no, Xiph, EBML
or fixed-size lacing. The packet table has each frame's track, timestamp and byte range in the file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import column_or_null

# Element ids of RFC 8794 and RFC 9559; fixed values.
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES, CUE_POINT, CUE_POSITIONS = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B, 0xBB, 0xB7
SCALE, DURATION, NUMBER, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH, TIME, SIMPLE, GROUP, BLOCK = 0x2AD7B1, 0x4489, 0xD7, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0xE7, 0xA3, 0xA0, 0xA1
CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xB3, 0xF7, 0xF1
DOC_TYPE, TRACK_ID, LACING_FLAG, MUXER, WRITER, READ_VERSION, TYPE_VERSION, TYPE_READ = 0x4282, 0x73C5, 0x9C, 0x4D80, 0x5741, 0x42F7, 0x4287, 0x4285
_PARENTS = frozenset((SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, CUES, CUE_POINT, CUE_POSITIONS, GROUP))
_TOP = frozenset((INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367))
SAMPLE_RATE, FRAME, LACED, CLUSTER_FRAMES = 8_000, 1_024, 8, 256


# ---------------------------------------------------------------- writing


def size_bytes(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer, in as few bytes as hold it or in `width`; all ones are kept for unknown."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(track: int, time: int, frames: list[bytes]) -> bytes:
    """A simple block of frames."""
    head = size_bytes(track) + struct.pack(">h", time)
    if len(frames) == 1:
        return element(SIMPLE, head + b"\x80" + frames[0])
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return element(SIMPLE, head + b"\x84" + bytes([len(frames) - 1]) + b"".join(frames))
    lace = size_bytes(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
        lace += size_bytes(b - a + (1 << 7 * width - 1) - 1, width)
    return element(SIMPLE, head + b"\x86" + bytes([len(frames) - 1]) + lace + b"".join(frames))


def write(payload: bytes) -> bytes:
    """A file whose one track is the payload as unsigned 8-bit samples. Timestamps are milliseconds."""
    milliseconds = lambda at: at * 1000 // SAMPLE_RATE
    frames = [payload[k : k + FRAME] for k in range(0, len(payload), FRAME)]
    clusters, times = [], []
    for c in range(0, len(frames), CLUSTER_FRAMES):
        start = milliseconds(c * FRAME)
        body = number(TIME, start)
        for k in range(c, min(c + CLUSTER_FRAMES, len(frames)), LACED):
            body += laced(1, milliseconds(k * FRAME) - start, frames[k : min(k + LACED, c + CLUSTER_FRAMES)])
        clusters.append(element(CLUSTER, body))
        times.append(start)
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLE_RATE)) + element(MUXER, b"tamis") + element(WRITER, b"tamis"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, number(NUMBER, 1) + number(TRACK_ID, 1) + number(KIND, 2) + number(LACING_FLAG, 1) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    before = info + tracks

    def cues(offset: int) -> bytes:
        out, at = b"", offset
        for t, c in zip(times, clusters, strict=True):
            place = CUE_CLUSTER.to_bytes(1, "big") + size_bytes(8) + at.to_bytes(8, "big")
            out += element(CUE_POINT, number(CUE_TIME, t) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + place))
            at += len(c)
        return element(CUES, out)

    index = cues(len(before) + len(cues(0)))  # positions have eight bytes, so the size doesn't change
    head = element(EBML, number(READ_VERSION, 1) + element(DOC_TYPE, b"matroska") + number(TYPE_VERSION, 4) + number(TYPE_READ, 2))
    return head + element(SEGMENT, before + index + b"".join(clusters))


# ---------------------------------------------------------------- reading


def _number(data: bytes, at: int) -> tuple[int, int, bool]:
    """A variable-length integer: value, next place, whether it is the unknown size."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError(f"the file ends within a variable-length integer at {at}")
    value = int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1)
    return value, at + width, value == (1 << 7 * width) - 1


def _id(data: bytes, at: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length()
    if not data[at] or width > 4:
        raise ValueError(f"no element id at {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def elements(data: bytes, at: int = 0, end: int | None = None, parent: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """Elements in file order, parents before what they hold: id, parent's id, first byte of the body, end. An unknown size
    ends where an element begins that can't be inside; a file may end within an element."""
    end = len(data) if end is None else min(end, len(data))
    while at < end:
        start = at
        kind, at = _id(data, at)
        size, at, unknown = _number(data, at)
        if parent == CLUSTER and kind in _TOP or parent not in (0,) and kind == SEGMENT:
            return
        stop = end if unknown else min(end, at + size)
        if kind == CLUSTER and unknown:
            stop = _cluster_end(data, at, end)
        yield kind, parent, at, stop
        if kind in _PARENTS:
            yield from elements(data, at, stop, kind)
        at = stop
        if at <= start:
            return


def _cluster_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        kind, body = _id(data, at)
        if kind in _TOP or kind == SEGMENT:
            return at
        size, body, _ = _number(data, body)
        at = body + size
    return end


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, bool, list[tuple[int, int]]]:
    """A block's track, relative time, key flag, and its frames' byte ranges."""
    track, at, _ = _number(data, at)
    time, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, time, bool(flags & 0x80), [(at, end)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif lacing == 3:
        n, at, _ = _number(data, at)
        sizes.append(n)
        for _ in range(count - 2):
            width = 9 - data[at].bit_length()
            step, at, _ = _number(data, at)
            n += step - ((1 << 7 * width - 1) - 1)
            sizes.append(n)
        sizes = sizes[: count - 1]
    else:
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing is longer than its block")
    bounds = np.cumsum([at, *sizes]).tolist()
    return track, time, bool(flags & 0x80), list(zip(bounds, bounds[1:], strict=False))


def read(data: bytes) -> dict:
    """Tracks, cues and packets (track, timestamp in ns, first byte, length, key, cluster's first byte) of a file."""
    out: dict = {"scale": 1_000_000, "duration": None, "tracks": {}, "cues": [], "packets": []}
    segment = cluster = time = 0
    track: dict = {}
    for kind, parent, at, end in elements(data):
        body = data[at:end] if kind not in _PARENTS and parent != CLUSTER else b""
        if kind == SEGMENT:
            segment = at
        elif kind == CLUSTER:
            cluster, time = at, 0
        elif kind == TIME and parent == CLUSTER:
            time = int.from_bytes(data[at:end], "big")
        elif kind == SIMPLE or kind == BLOCK:
            number_, relative, key, frames = _frames(data, at, end)
            own = out["tracks"].get(number_, {})
            stamp = (time + relative) * out["scale"]
            for a, b in frames:
                out["packets"].append((number_, stamp, a, b - a, key or kind == BLOCK, cluster))
                step = own.get("rate", 0) * own.get("channels", 1) * own.get("depth", 0) // 8
                stamp += (b - a) * 1_000_000_000 // int(step) if step else 0
        elif kind == SCALE:
            out["scale"] = int.from_bytes(body, "big")
        elif kind == DURATION:
            out["duration"] = struct.unpack(">d" if len(body) == 8 else ">f", body)[0]
        elif kind == TRACK:
            track = {}
        elif kind == NUMBER and parent == TRACK:
            out["tracks"][int.from_bytes(body, "big")] = track
        elif kind == CODEC:
            track["codec"] = body.decode("ascii", "replace")
        elif kind == RATE:
            track["rate"] = struct.unpack(">d" if len(body) == 8 else ">f", body)[0]
        elif kind in (CHANNELS, DEPTH):
            track["channels" if kind == CHANNELS else "depth"] = int.from_bytes(body, "big")
        elif kind == CUE_POINT:
            out["cues"].append({})
        elif kind in (CUE_TIME, CUE_TRACK, CUE_CLUSTER) and out["cues"]:
            n = int.from_bytes(body, "big")
            out["cues"][-1][{CUE_TIME: "time", CUE_TRACK: "track"}.get(kind, "cluster")] = n if kind != CUE_CLUSTER else n + segment
    return out


def features(samples: bytes, found: dict) -> str:
    """Of a track's samples and packets: packets, cues, milliseconds, mean, deviation, mean step and share of zeros."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    n = max(1, len(x))
    mean = int(x.sum()) / n
    spread = max(0.0, int((x * x).sum()) / n - mean * mean) ** 0.5
    step = int(np.abs(np.diff(x)).sum()) / n
    return f"packets={len(found['packets'])};cues={len(found['cues'])};ms={found['duration'] or 0:.3f};mean={mean:.4f};deviation={spread:.4f};step={step:.4f};zeros={np.count_nonzero(x == 0) / n:.6f}"


# ---------------------------------------------------------------- columns


def padded(text: str | None, unit: int = 64) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes((-len(raw)) % unit or (0 if raw else unit)), len(raw)


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: a file for each text (null: empty) of docs, padded by zeros to a positive multiple of 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                made = [padded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([write(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    wanted = docs.select(F.col("doc_id").cast("long"), column_or_null(docs, "text", "string").alias("text"))
    return wanted.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _parts(batch: pa.RecordBatch, rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def packets(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each frame of each file in the column media: key, track, timestamp_ns, byte_offset, byte_length, key_frame,
    cluster_offset. Null and empty files have no frames; a file that isn't Matroska fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *p) for k, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if m for p in read(m)["packets"]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 7, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], [key, "track", "timestamp_ns", "byte_offset", "byte_length", "key_frame", "cluster_offset"])

    return media.select(F.col(key).cast("long").alias(key), "media").mapInArrow(run, f"{key} long, track long, timestamp_ns long, byte_offset long, byte_length long, key_frame boolean, cluster_offset long")


def digests(media: DataFrame) -> DataFrame:
    """What the files in media (doc_id, n_bytes, media) hold, read back: payload_bytes, payload_sha256, tail_crc32 (of the
    last 64), media_bytes, media_sha256, feature. Null files give nulls; repeated rows and equal texts give equal values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            rows = []
            for m in batch.column(2).to_pylist():
                if not m:
                    rows.append((None,) * 6)
                    continue
                found = read(m)
                samples = b"".join([m[a : a + n] for track, _, a, n, _, _ in found["packets"] if track == 1])
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(m), hashlib.sha256(m).hexdigest(), features(samples, found)))
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
