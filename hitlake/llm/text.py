"""Word splitting and hashing shared by the text operators (numpy inside Spark tasks).

A word is a maximal run of bytes other than space and 0x09-0x0D, which is what ``bytes.split()`` yields.
Texts reach the tasks as UTF-8 bytes; null texts count as empty. Work goes in slices of about one megabyte,
so that memory does not depend on the Arrow batch, and a longer text is split at white space.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut_lineage as cut_lineage

SLICE_BYTES = 1 << 20
SEEN = 1 << 16
LONG = 256
SPACE = b" \t\n\x0b\x0c\r"
BLANK = np.isin(np.arange(256), list(SPACE))
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Seen:
    """Remembers the last keys of a task, at most SEEN of them, so that most repeats are passed over."""

    def __init__(self) -> None:
        self.keys: set[int] = set()

    def new(self, key: int) -> bool:
        if key in self.keys:
            return False
        if len(self.keys) >= SEEN:
            self.keys.clear()
        self.keys.add(key)
        return True


def slices(texts: list, size: int = SLICE_BYTES, weight: Callable = lambda t: len(t or b"")) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``size`` bytes each."""
    start = total = 0
    for i, t in enumerate(texts):
        total += weight(t)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def pieces(text: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """The text cut at white space into pieces of about ``size`` bytes."""
    start = 0
    while len(text) - start > size:
        end = start + size
        while end < len(text) and text[end] not in SPACE:
            end += 1
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def _word_hashes(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, eight bytes at a time; words of over LONG bytes one by one."""
    buffer = np.frombuffer(data + bytes(8), np.uint8)
    lanes = np.ndarray((len(buffer) - 7,), "<u8", buffer, 0, (1,))
    hashes = mixed((lanes[starts] & MASKS[np.minimum(sizes, 8)]) * P1 + sizes.astype(np.uint64))
    at, k = np.flatnonzero(sizes > 8), 8
    while len(at) and k < LONG:
        rest = sizes[at] - k
        hashes[at] = mixed(hashes[at] * P2 + (lanes[starts[at] + k] & MASKS[np.minimum(rest, 8)]))
        at, k = at[rest > 8], k + 8
    for i in at.tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    return hashes


def _core(data: bytes, starts: np.ndarray, ends: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without the bytes of ``edge`` (a table) at both ends; a word of such bytes alone gets length 0."""
    inner = np.concatenate([np.flatnonzero(~edge[np.frombuffer(data, np.uint8)]), [len(data)]])
    first = np.searchsorted(inner, starts)
    last = np.searchsorted(inner, ends)
    none = first == last
    return np.where(none, starts, inner[first]), np.where(none, starts, inner[np.maximum(last, 1) - 1] + 1)


def word_ids(texts: list[bytes | None], lower: bool = False, edge: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts (uint64) and the offset of each text's first word, with the end last.

    lower: A-Z are lower-cased; edge: a table of the bytes that are cut off at both ends of a word.
    """
    ids, counts = [np.empty(0, np.uint64)], np.zeros(len(texts), np.int64)

    def add(parts: list[bytes]) -> np.ndarray:
        """Number of words of each part."""
        data = b" ".join(parts)
        data = data.lower() if lower else data
        blank = np.ones(len(data) + 2, bool)
        blank[1:-1] = BLANK[np.frombuffer(data, np.uint8)]
        turns = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = turns[::2], turns[1::2]
        n = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in parts)])))
        if edge is not None:
            starts, ends = _core(data, starts, ends, edge)
        ids.append(_word_hashes(data, starts, ends - starts))
        return n

    for lo, hi in slices(texts):
        if hi - lo == 1:
            for part in pieces(texts[lo] or b""):
                counts[lo] += add([part])[0]
        else:
            long = len(texts[hi - 1] or b"") > SLICE_BYTES  # what comes before it is under a slice
            counts[lo : hi - long] = add([t or b"" for t in texts[lo : hi - long]])
            if long:
                for part in pieces(texts[hi - 1]):
                    counts[hi - 1] += add([part])[0]
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(counts)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(ids: np.ndarray, k: int, base: np.uint64 = P1) -> np.ndarray:
    """Hash of each run of k consecutive ids, by doubling; entry i stands for ids[i:i+k]."""
    if len(ids) < k:
        return np.empty(0, np.uint64)
    done, have, power = None, 0, ids
    step, rest, scale = 1, k, base
    while rest:
        if rest & 1:
            if done is None:
                done, have = power, step
            else:
                m = len(ids) - have - step + 1
                done = done[:m] * scale + power[have : have + m]
                have += step
        rest >>= 1
        if rest:
            m = len(power) - step
            power = power[:m] * scale + power[step:]
            scale = np.uint64(int(scale) ** 2 & (1 << 64) - 1)
            step *= 2
    return mixed(done[: len(ids) - k + 1])


def doc_of(offsets: np.ndarray) -> np.ndarray:
    """The text each word belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def whole(offsets: np.ndarray, k: int) -> np.ndarray:
    """Which of the len(ids)-k+1 runs of k words lie within one text."""
    n = int(offsets[-1])
    if n < k:
        return np.zeros(0, bool)
    owner = doc_of(offsets)
    return owner[: n - k + 1] == owner[k - 1 :]


def release() -> None:
    """Give memory that is free back to the system: workers live on, and the next task may need it elsewhere."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and release() when a task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def bit_table(slots: DataFrame, bits: int) -> np.ndarray:
    """The numbers in column ``slot`` (0 to 2^bits - 1) as bits, 2^bits of them whatever the rows; tasks fill it part by part."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # no more than the table
        for b in batches:
            slot = np.unique(b.column("slot").to_numpy())
            for some in np.split(slot, np.flatnonzero(np.diff(slot >> 16)) + 1):
                if len(some):
                    held.setdefault(int(some[0]) >> 16, np.zeros(1 << 16, bool))[some & 0xFFFF] = True
        for place, some in held.items():
            yield pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int64()), "bits": pa.array([np.packbits(some, bitorder="little").tobytes()], pa.binary())})

    table = np.zeros((1 << bits) // 8, np.uint8)
    for r in slots.select("slot").repartition(F.shiftright("slot", 16)).mapInArrow(tidy(fill), "place long, bits binary").toLocalIterator():
        table[r["place"] << 13 : (r["place"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    return table


def in_table(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which of the slots are set in a table of bits."""
    return (table[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


def utf8(text: str = "text") -> Column:
    return F.col(text).cast("binary")


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5 is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
