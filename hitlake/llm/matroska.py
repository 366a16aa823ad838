"""Media columns: payloads kept losslessly as 8-bit PCM in Matroska, and packet tables parsed from the bytes.

``mux`` writes an EBML header and a segment of known size with one PCM track, a cluster for every 8 blocks (a block's
time is a signed 16-bit number of milliseconds from its cluster's), blocks of eight laced frames (fixed-size lacing;
the last frames of a file have blocks of their own) and a cue for each cluster. ``packets`` reads any stored file of this family: variable-length element ids and sizes, unknown-size
segments and clusters, simple blocks and block groups, all four lacings (none, Xiph, fixed, EBML) and cues. It gives
each frame's track, timestamp, key flag, byte range and whether a cue points at its cluster.

Null and empty texts are one unit of zeros; an empty table gives no rows. Repeated rows and null ids are kept, each with
its own file; equal texts give equal bytes. A text is stored whole whatever its length (one file in a task's memory at
a time beside a few megabytes); columns other than the key and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import slices, utf8

UNIT = 64
FRAME = 4096
LACED = 8
BLOCKS = 8  # 7 blocks of 32 KiB before the last are under 32,768 ms
RATE = 8000

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, TIMESTAMP = 0xA3, 0xA0, 0xA1, 0xE7
SCALE, TRACK_ENTRY, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x2AD7B1, 0xAE, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
PARENTS = {SEGMENT, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS, INFO}
TOP = {INFO, TRACKS, CLUSTER, CUES}


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def _size(n: int) -> bytes:
    width = max(1, -(-(n + 1).bit_length() // 7))  # all ones means unknown
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return _id(kind) + _size(len(body)) + body


def uint(kind: int, x: int) -> bytes:
    return element(kind, x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big"))


HEAD = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
TRACK = element(TRACKS, element(TRACK_ENTRY, uint(0xD7, 1) + uint(0x73C5, 1) + uint(0x83, 2) + uint(0x9C, 1) + element(0x86, b"A_PCM/INT/LIT") + element(0xE1, element(0xB5, struct.pack(">d", RATE)) + uint(0x9F, 1) + uint(0x6264, 8))))
START = element(INFO, uint(SCALE, 1_000_000) + element(0x4D80, b"media") + element(0x5741, b"media")) + TRACK


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def mux(payload: bytes) -> bytes:
    """A Matroska file whose frames, one after the other, are the payload."""
    blocks: list[tuple[int, bytes]] = []
    step = FRAME * LACED
    full = len(payload) - len(payload) % step
    for at in range(0, full, step):
        blocks.append((at, b"\x84" + bytes([LACED - 1]) + payload[at : at + step]))  # key frame, fixed-size lacing
    for at in range(full, len(payload), FRAME):
        blocks.append((at, b"\x80" + payload[at : at + FRAME]))
    parts, cues, at = [START], [], len(START)
    for k in range(0, len(blocks), BLOCKS):
        some = blocks[k : k + BLOCKS]
        base = some[0][0] * 1000 // RATE
        body = [uint(TIMESTAMP, base)]
        for pos, block in some:
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">h", pos * 1000 // RATE - base) + block))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, uint(CUE_TIME, base) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return HEAD + element(SEGMENT, b"".join(parts))


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """Value and end of a variable-length number; keep: with the length marker (ids). -1: unknown size."""
    first = data[at]
    width = 9 - first.bit_length()
    if not first or at + width > len(data):
        raise ValueError(f"bad variable-length number at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if not keep:
        value &= (1 << 7 * width) - 1
        if value == (1 << 7 * width) - 1:
            value = -1
    return value, at + width


def elements(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(id, element start, body start, body end) of all elements, parents before what they hold."""
    ends: list[tuple[int, bool]] = []  # of the parents that are open, and whether their size is unknown
    at = 0
    while at < len(data):
        while ends and at >= ends[-1][0]:
            ends.pop()
        kind, body = _vint(data, at, True)
        size, body = _vint(data, body, False)
        if kind in TOP:
            while len(ends) > 1 and ends[-1][1]:  # a top-level element ends a cluster of unknown size
                ends.pop()
        limit = ends[-1][0] if ends else len(data)
        end = limit if size < 0 else body + size
        if end > limit:
            raise ValueError(f"element at byte {at} is cut short")
        yield kind, at, body, end
        if kind in PARENTS:
            ends.append((end, size < 0))
            at = body
        else:
            at = end


def _laced(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if not lacing:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == 3:
        for k in range(n - 1):
            first = at
            value, at = _vint(data, at, False)
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * (at - first) - 1) - 1))
    else:
        if (end - at) % n:
            raise ValueError("fixed-size lacing does not divide its block")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames exceed their block")
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return out


def demux(data: bytes) -> list[tuple[int, int, bool, int, int, int, bool]]:
    """(track, timestamp, key, cluster, first byte, end byte, cued) of each frame in file order."""
    segment = cluster = base = 0
    out, cued = [], set()
    for kind, at, body, end in elements(data):
        if kind == SEGMENT:
            segment = body
        elif kind == CLUSTER:
            cluster = at - segment
        elif kind == TIMESTAMP:
            base = int.from_bytes(data[body:end], "big")
        elif kind == CUE_CLUSTER:
            cued.add(int.from_bytes(data[body:end], "big"))
        elif kind in (SIMPLE_BLOCK, BLOCK):
            track, p = _vint(data, body, False)
            when, flags = base + struct.unpack_from(">h", data, p)[0], data[p + 2]
            out += [(track, when, kind == SIMPLE_BLOCK and flags >= 128, cluster, a, b) for a, b in _laced(data, p + 3, end, flags >> 1 & 3)]
    return [(*x, x[3] in cued) for x in out]


def store(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes and media: every whole text (null: empty) as UTF-8, padded and muxed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column("text").to_pylist(), 4 << 20):
                some = b.slice(lo, hi - lo)
                texts = [t or b"" for t in some.column("text").to_pylist()]
                media = [mux(padded(t)) for t in texts]
                yield pa.RecordBatch.from_pydict({key: some.column(key), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "media": pa.array(media, pa.binary())})

    return docs.select(key, utf8().alias("text")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


PACKETS = "track int, timestamp_ms long, keyframe boolean, cluster_position long, first_byte long, end_byte long, cued boolean"


def packets(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per frame of each file in column media: key, packet_no and the columns of PACKETS."""
    names = [c.split()[0] for c in PACKETS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in enumerate(b.column("media").to_pylist()):
                if frames := demux(data) if data else []:
                    own = pa.concat_arrays([b.column(key).slice(i, 1)] * len(frames))
                    yield pa.RecordBatch.from_pydict({key: own, "packet_no": pa.array(range(len(frames)), pa.int32())} | dict(zip(names, (pa.array(c, k) for c, k in zip(zip(*frames, strict=True), kinds, strict=True)), strict=True)))

    return media.select(key, "media").mapInArrow(run, f"{key} {media.schema[key].dataType.simpleString()}, packet_no int, {PACKETS}")


def feature(samples: np.ndarray) -> str:
    """Mean level, mean deviation and zero crossings per thousand samples of 8-bit PCM, and a 16-bin level histogram in hex."""
    centred = samples.astype(np.int16) - 128
    level, spread = centred.mean(), np.abs(centred - centred.mean()).mean()
    crossings = 1000 * np.count_nonzero(np.diff(np.signbit(centred))) / len(samples)
    bins = np.bincount(samples >> 4, minlength=16) * 255 // len(samples)
    return f"mean={level:.3f};dev={spread:.3f};zcr={crossings:.2f};hist={bytes(bins.tolist()).hex()}"


DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets int"


def read_back(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests and features of each stored file, from the packets parsed out of its bytes."""
    names = [c.split()[0] for c in DIGEST.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column("media").to_pylist():
                frames = demux(data)
                payload = b"".join(data[f[4] : f[5]] for f in frames)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(np.frombuffer(payload, np.uint8)), len(frames)))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("n_bytes"), *cols], [key, "n_bytes", *names])

    return media.select(key, "n_bytes", "media").mapInArrow(run, f"{key} {media.schema[key].dataType.simpleString()}, n_bytes long, {DIGEST}")
