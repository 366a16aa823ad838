"""Captures in pcapng form as Spark data sources, batch and stream.

``read_packets`` gives one row per UDP payload: capture_id (the file's name), pkt_no (the packet's place among all
packets of the file), src_ip, dst_ip and payload. Files of up to ``split_bytes`` are read by the data source
``capture``, small ones together in a task, in one pass with buffered reads; ``start`` and ``max_packets`` choose a packet range, which
ends the read early. Larger files are cut into byte ranges: a first job finds in each range the first block
that begins a chain of valid ones and counts the packets, the ranges' ends are checked against the next starts (a range
that took data for a block is walked again from the true place), running sums give the packet numbers, and a second job
reads the ranges.

``read_stream`` follows files that grow and files that appear. Offsets are file sizes, so the driver reads no packet;
tasks walk the blocks that became whole between two sizes, and packet numbers are counted in state by capture.
``read_closed`` is a stream of captures that are complete (see ``Closed``).

Section headers of either byte order, enhanced and simple packet blocks, up to three VLAN tags, IPv4 with options and
UDP are read; other packets count in pkt_no and give no row. A cut-off tail ends the file silently. Classic pcap files
and link types other than Ethernet raise, and so do blocks of over a megabyte in a stream.
"""

from __future__ import annotations

import glob
import json
import os
import re
import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..lineage import cut_lineage
from ..schema import PACKETS

# Fixed values of the format.
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
ORDER = 0x1A2B3C4D
CLASSIC = (0xA1B2C3D4, 0xD4C3B2A1)
ETHERNET = 1
VLAN = (0x8100, 0x88A8, 0x9100)
ARROW = pa.schema([("capture_id", pa.string()), ("pkt_no", pa.int64()), ("src_ip", pa.string()), ("dst_ip", pa.string()), ("payload", pa.binary())])
KINDS = (SECTION, INTERFACE, SIMPLE, 4, 5, ENHANCED, 10, 0xBAD, 0x40000BAD)  # blocks that may begin a chain
BATCH = 4096
SPLIT = 128 << 20
SMALL = 4 << 20  # a task reads small files up to this size together, and more where there are many
NAMES = 1000  # of complete captures that a task gives
CHAIN = 16  # blocks that tell a block's start from data
PORTION = 256 << 20  # of a file, whose packets are numbered together
WINDOW = 1 << 20  # bytes searched at a time; no block of a followed capture is longer
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # what state by key with a life time needs
IDLE_MS = 3_600_000  # captures rotate within a minute


def payload(frame: bytes) -> tuple[str, str, bytes] | None:
    """Source, destination and UDP payload of an Ethernet frame; None for anything else and for empty payloads."""
    at = 12
    for _ in range(4):
        if len(frame) < at + 2:
            return None
        (kind,) = struct.unpack_from(">H", frame, at)
        at += 2
        if kind not in VLAN:
            break
        at += 2
    if kind != 0x0800 or len(frame) < at + 20:
        return None
    head = 4 * (frame[at] & 15)
    if frame[at] >> 4 != 4 or head < 20 or frame[at + 9] != 17 or len(frame) < at + head + 8:
        return None
    (length,) = struct.unpack_from(">H", frame, at + head + 4)
    data = frame[at + head + 8 : at + head + max(8, length)]
    ip = lambda k: ".".join(map(str, frame[at + k : at + k + 4]))
    return (ip(12), ip(16), data) if data else None


def blocks(stream: BinaryIO, name: str, at: int = 0, order: str = "<", stop: int | None = None) -> Iterator[tuple[int, int, int, str]]:
    """(kind, position, size, byte order) of each whole block from position ``at``, a block's start, that ends by ``stop``; bodies are not read."""
    whole = stream.seek(0, os.SEEK_END)
    whole = whole if stop is None else min(whole, stop)
    while at + 12 <= whole:
        stream.seek(at)
        head = stream.read(12)
        (mark,) = struct.unpack_from("<I", head)
        if mark == SECTION:
            order = "<" if head[8:] == struct.pack("<I", ORDER) else ">"
        elif at == 0:
            raise ValueError(f"{name}: {'a classic pcap, ' if mark in CLASSIC else ''}not a pcapng")
        kind, size = struct.unpack_from(order + "II", head)
        if size < 12 or size % 4 or at + size > whole:
            return
        if kind == INTERFACE and (link := struct.unpack_from(order + "H", head, 8)[0]) != ETHERNET:
            raise ValueError(f"{name}: link type {link}; only Ethernet is read")
        yield kind, at, size, order
        at += size


def is_packet(kind: int, size: int) -> bool:
    return kind == ENHANCED and size >= 32 or kind == SIMPLE and size >= 16


def frames(stream: BinaryIO, name: str, at: int = 0, order: str = "<", stop: int | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(position, end, frame) of each packet block from position ``at``, a block's start."""
    for kind, place, size, order in blocks(stream, name, at, order, stop):
        if is_packet(kind, size):
            stream.seek(place + 8)
            body = stream.read(size - 8)
            length, first = (12, 20) if kind == ENHANCED else (0, 4)
            (kept,) = struct.unpack_from(order + "I", body, length)
            yield place, place + size, body[first : first + min(kept, size - 12 - first)]


def _chained(stream: BinaryIO, at: int, order: str, whole: int) -> bool:
    """Whether blocks follow each other from ``at`` on: CHAIN of them, or all up to ``whole``, and one at least."""
    for n in range(CHAIN):
        if at + 12 > whole:
            return n > 0
        stream.seek(at)
        head = stream.read(12)
        if head[:4] == struct.pack("<I", SECTION):
            order = "<" if head[8:] == struct.pack("<I", ORDER) else ">"
        (size,) = struct.unpack_from(order + "I", head, 4)
        if size < 12 or size % 4:
            return False
        if at + size > whole:
            return n > 0
        stream.seek(at + size - 4)
        if stream.read(4) != struct.pack(order + "I", size):
            return False
        at += size
    return True


def first_block(stream: BinaryIO, at: int, whole: int) -> tuple[int, str] | None:
    """Position and byte order of the first block from byte ``at`` that begins a chain; blocks start at multiples of four."""
    if at == 0:
        return 0, "<"
    at += -at % 4
    while at + 12 <= whole:
        stream.seek(at)
        data = stream.read(min(WINDOW, whole - at))
        found = []
        for order in "<>":
            numbers = np.frombuffer(data[: len(data) // 4 * 4], order + "u4")
            size = numbers[1:].astype(np.int64)
            good = np.isin(numbers[:-1], KINDS) & (size >= 12) & (size % 4 == 0) & (size <= whole - at - 4 * np.arange(len(size)))
            found += [(at + 4 * int(i), order) for i in np.flatnonzero(good)]
        for place, order in sorted(found):
            if _chained(stream, place, order, whole):
                return place, order
        at += len(data) // 4 * 4 - 4
        if len(data) < WINDOW:
            break
    return None


def _batches(path: str, start: int = 0, stop: int | None = None, at: int = 0, number: int = 0, order: str = "<", end: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of the packets from number ``start`` up to ``stop``; ``at`` is where packet ``number`` or a block before it begins."""
    name = os.path.basename(path)
    rows: list[tuple] = []
    with open(path, "rb", buffering=1 << 20) as stream:
        for k, (_, _, frame) in enumerate(frames(stream, path, at, order, end), number):
            if stop is not None and k >= stop:
                break
            if k >= start and (found := payload(frame)):
                rows.append((name, k, *found))
            if len(rows) == BATCH:
                yield _batch(rows, ARROW)
                rows = []
    if rows:
        yield _batch(rows, ARROW)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def local(path: str) -> str:
    """A path of a mounted folder, given with or without the file scheme."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


@dataclass
class Piece(InputPartition):
    paths: list[str]
    start: int = 0
    stop: int | None = None


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = _captures(json.loads(options["paths"]))
        self.start = int(options.get("start", 0))
        most = options.get("maxpackets")
        self.stop = None if most is None else self.start + int(most)
        self.together = int(options.get("together", 0))

    def partitions(self) -> list[InputPartition]:
        """Files in order, as many in a task as do not exceed ``together`` bytes, and one at least."""
        pieces, held = [], 0
        for path in self.paths:
            size = os.path.getsize(path)
            if not pieces or held + size > self.together:
                pieces.append(Piece([], self.start, self.stop))
                held = 0
            pieces[-1].paths.append(path)
            held += size
        return pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            yield from _batches(path, partition.start, partition.stop)


class Capture(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return PACKETS

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)


def _captures(path: str | list[str]) -> list[str]:
    """The captures that match a pattern; a list is of files."""
    found = sorted(map(local, path)) if isinstance(path, list) else sorted(glob.glob(local(path)))
    if not found:
        raise ValueError(f"no capture matches {path}")
    return found


def _register(spark: SparkSession, source: type[DataSource]) -> None:
    """Sources go to Spark's workers by value: those that plan a source do not see this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(source)


def read_packets(spark: SparkSession, path: str | list[str], start: int | None = None, max_packets: int | None = None, split_bytes: int = SPLIT) -> DataFrame:
    """Packets of all captures that match the path, or of a list of files; with a range, only packets from ``start`` and at most max_packets.

    Without a range, captures of over ``split_bytes`` are read by many tasks.
    """
    sizes = {p: os.path.getsize(p) for p in _captures(path)}
    if start is None and max_packets is None and max(sizes.values()) > split_bytes:
        return _read_ranges(spark, sizes, split_bytes)
    _register(spark, Capture)
    together = min(SPLIT, max(SMALL, sum(sizes.values()) // spark.sparkContext.defaultParallelism))
    options = {"start": start, "maxPackets": max_packets, "paths": json.dumps(sorted(sizes)), "together": together}
    return spark.read.format("capture").options(**{k: str(v) for k, v in options.items() if v is not None}).load()


RANGE = "path string, low long, high long, first long, end long, packets long, order string, order_after string, broken boolean"


def _walk(path: str, low: int, high: int, first: int | None, order: str | None) -> tuple:
    """The row of RANGE of the blocks that start in [low, high); they begin at ``first``, or where a chain does."""
    with open(path, "rb", buffering=1 << 16) as stream:
        whole = stream.seek(0, os.SEEK_END)
        if first is None:
            found = first_block(stream, low, whole)
            if found is None or found[0] >= high:
                return path, low, high, None, None, 0, None, None, False
            first, order = found
        end, packets, after = first, 0, order
        for kind, place, size, after in blocks(stream, path, first, order):
            if place >= high:
                break
            packets += is_packet(kind, size)
            end = place + size
        return path, low, high, first, end, packets, order, after, end < high


def _walked(ranges: DataFrame, tasks: int) -> DataFrame:
    """RANGE rows of (path, low, high, first, order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                made = _walk(row["path"], row["low"], row["high"], row["first"], row["order"])
                yield pa.RecordBatch.from_pylist([dict(zip((c.split()[0] for c in RANGE.split(", ")), made, strict=True))], _ranges_schema())

    return cut_lineage(ranges.select("path", "low", "high", "first", "order").repartition(tasks).mapInArrow(run, RANGE))


def _ranges_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RANGE.split(", ")])


def _read_ranges(spark: SparkSession, sizes: dict[str, int], split: int) -> DataFrame:
    tasks = max(1, sum(-(-n // split) for n in sizes.values()))
    files = spark.createDataFrame(list(sizes.items()), "path string, size long")
    low = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long")))
    ranges = files.withColumn("low", low).select("path", "low", F.least(F.col("low") + split, "size").alias("high"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("string").alias("order"))
    walked = _walked(ranges, tasks)
    earlier = Window.partitionBy("path").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)  # a file's ranges
    while True:
        end = F.coalesce(F.last("end", ignorenulls=True).over(earlier), F.lit(0))
        placed = walked.withColumns({"number": F.coalesce(F.sum("packets").over(earlier), F.lit(0)), "lost": F.coalesce(F.bool_or("broken").over(earlier), F.lit(False)), "due": end, "due_order": F.coalesce(F.last("order_after", ignorenulls=True).over(earlier), F.lit("<"))})
        placed = placed.where("NOT lost").withColumn("due", F.when(F.col("due") < F.col("high"), F.col("due")))
        wrong = cut_lineage(placed.where(~F.col("first").eqNullSafe(F.col("due"))))
        if wrong.isEmpty():
            break
        again = wrong.select("path", "low", "high", F.col("due").alias("first"), F.col("due_order").alias("order"))
        done = _walked(again.where("first IS NOT NULL"), tasks)
        none = again.where("first IS NULL").selectExpr("path", "low", "high", "first", "CAST(NULL AS LONG) AS end", "0L AS packets", "CAST(NULL AS STRING) AS order", "CAST(NULL AS STRING) AS order_after", "FALSE AS broken")
        walked = cut_lineage(walked.join(wrong.select("path", "low"), ["path", "low"], "left_anti").unionByName(done).unionByName(none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield from _batches(r["path"], at=r["first"], number=r["number"], order=r["order"], end=r["end"])

    return placed.where("packets > 0").select("path", "first", "end", "number", "order").repartition(tasks).mapInArrow(run, PACKETS)


# --- following --------------------------------------------------------------------------------------------------------

TAIL = "path string, pos long, src_ip string, dst_ip string, payload binary"
ARROW_TAIL = pa.schema([("path", pa.string()), ("pos", pa.int64()), ("src_ip", pa.string()), ("dst_ip", pa.string()), ("payload", pa.binary())])


@dataclass
class Span(InputPartition):
    path: str
    low: int
    high: int


class Follower(DataSourceStreamReader):
    """Follows files that grow and files that appear. The offset holds the bytes of each file that are read."""

    def __init__(self, options: dict[str, str]):
        self.pattern = local(options["path"])
        self.most = int(options.get("maxbytespertrigger", PORTION))
        self.split = int(options.get("splitbytes", SPLIT))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        for path in sorted(glob.glob(self.pattern)):
            self.seen[path] = max(self.seen.get(path, 0), min(os.path.getsize(path), self.seen.get(path, 0) + self.most))
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = {p: max(n, self.seen.get(p, 0)) for p, n in (self.seen | end).items()}
        return [Span(p, k, min(k + self.split, high)) for p, high in end.items() for k in range(start.get(p, 0), high, self.split)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        """Packets, and what else counts as one (without payload), of the blocks that end in (low, high]."""
        path, rows = partition.path, []
        with open(path, "rb", buffering=1 << 20) as stream:
            found = first_block(stream, max(0, partition.low - WINDOW), partition.high)
            if found is None:
                return
            for place, end, frame in frames(stream, path, *found, partition.high):
                if end - place > WINDOW:
                    raise ValueError(f"{path}: a block of {end - place} bytes; a stream reads up to {WINDOW}")
                if end > partition.low:
                    rows.append((path, place, *(payload(frame) or (None, None, None))))
                if len(rows) == BATCH:
                    yield _batch(rows, ARROW_TAIL)
                    rows = []
        if rows:
            yield _batch(rows, ARROW_TAIL)


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture_tail"

    def schema(self) -> str:
        return TAIL

    def streamReader(self, schema: StructType) -> Follower:  # noqa: N802
        return Follower(self.options)


class Numbers(StatefulProcessor):
    """The packets of each file so far; what is held goes idle_ms after a file's last data."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.packets = handle.getValueState("packets", "packets long", self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values("pos")
        before = self.packets.get()[0] if self.packets.exists() else _packets_before(key[0], int(pdf["pos"].iloc[0]))
        pdf["pkt_no"] = np.arange(before, before + len(pdf))
        pdf["capture_id"] = os.path.basename(key[0])
        self.packets.update((before + len(pdf),))
        yield pdf.loc[pdf["payload"].notna(), ["capture_id", "pkt_no", "src_ip", "dst_ip", "payload"]]

    def close(self) -> None:
        pass


def _numbered(rows: DataFrame, idle_ms: int) -> DataFrame:
    """PACKETS of a stream of TAIL rows."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.groupBy("path").transformWithStateInPandas(Numbers(idle_ms), PACKETS, "Append", "ProcessingTime")


def _packets_before(path: str, pos: int) -> int:
    """For a capture that goes on after its state went: its packets are counted anew."""
    if not os.path.exists(path):
        raise ValueError(f"{path} is gone and its packet count too")
    with open(path, "rb", buffering=1 << 16) as stream:
        return sum(is_packet(kind, size) for kind, _, size, _ in blocks(stream, path, stop=pos))


def read_stream(spark: SparkSession, path: str, max_bytes_per_trigger: int = PORTION, split_bytes: int = SPLIT, idle_ms: int = IDLE_MS) -> DataFrame:
    """The same rows as read_packets, as a stream of growing and newly written captures.

    A refresh takes at most max_bytes_per_trigger of each file; a run with the trigger availableNow is one refresh. With
    other triggers, refreshes without data let old state go, so processAllAvailable does not return.
    """
    _register(spark, Tail)
    tail = spark.readStream.format("capture_tail").option("maxBytesPerTrigger", str(max_bytes_per_trigger)).option("splitBytes", str(split_bytes)).load(path)
    return _numbered(tail, idle_ms)


CLOSED = "capture_id string, path string, bytes long"


@dataclass
class Spans(InputPartition):
    spans: list[Span]


class Closed(DataSourceStreamReader):
    """Captures that are complete, each once: (capture_id, path, bytes).

    A name <interface>_<number>... has an interface and a place in its order; other names are an interface of their own.
    A capture is complete when a later one of its interface has appeared, or when its size has not changed for ``still``
    looks at the folder (with still = 0 at once: for what a finished run left). One that grows after that is given again,
    whole, also when later ones have become complete meanwhile; after a restart, so may one that had only rested.

    The offset has, for each interface, the number and size of the last complete one and, with the option ``sizes``, the
    size of every complete one in the folder. Without it, the growth of captures before that last one goes unseen.
    """

    def __init__(self, options: dict[str, str]):
        self.pattern = local(options["path"])
        self.still = int(options.get("still", 3))
        self.sizes = options.get("sizes") == "true"
        self.looks: dict[str, tuple[str | None, int | None, int]] = {}  # last capture of an interface, its size, looks that found both again
        self.given: dict[str, list] = {}

    def _there(self) -> dict[str, list[tuple[int, str, int]]]:
        """(number, path, size) of the captures of each interface, in order."""
        found: dict[str, list[tuple[int, str, int]]] = {}
        for path in glob.glob(self.pattern):
            name = os.path.basename(path)
            parts = re.match(r"^(.*?)_(\d+)(?:_[^_]*)?(?:\.pcapng)?$", name)
            found.setdefault(parts[1] if parts else name, []).append((int(parts[2]) if parts else 0, path, os.path.getsize(path)))
        return {k: sorted(v) for k, v in found.items()}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        there = self._there()
        for interface, captures in there.items():
            _, path, size = captures[-1]
            *same, looks = self.looks.get(interface, (None, None, 0))
            looks = looks + 1 if same == [path, size] else 0
            self.looks[interface] = (path, size, looks)
            if complete := captures if looks >= self.still else captures[:-1]:
                sizes = [{p: n for _, p, n in complete}] if self.sizes else []
                self._give(interface, [complete[-1][0], complete[-1][2], *sizes], {p for _, p, _ in captures})
        return {k: list(v) for k, v in self.given.items()}

    def _give(self, interface: str, new: list, there: set[str]) -> None:
        """Takes the larger numbers of two offsets; captures that are gone from the folder leave it."""
        old = self.given.get(interface, new)
        sizes = [v[2] for v in (old, new) if len(v) > 2]
        merged = {p: max(d.get(p, 0) for d in sizes) for d in sizes for p in d if p in there}
        self.given[interface] = [*max(old[:2], new[:2]), *([merged] if sizes else [])]

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        there, pieces = self._there(), []
        for offset in (start, end):
            for interface, known in offset.items():
                self._give(interface, known, {p for _, p, _ in there.get(interface, [])})
        for interface, (number, size, *sizes) in end.items():
            low, seen, *had = start.get(interface, [-1, 0])
            for n, path, now in there.get(interface, []):
                due = sizes[0].get(path, -1) if sizes else size if n == number else now if n < number else -1
                before = had[0].get(path, -1) if had else due if n < low else seen if n == low else -1
                if due > before:
                    pieces.append(Span(path, n, due))
        return [Spans(pieces[k : k + NAMES]) for k in range(0, len(pieces), NAMES)] if self.sizes else pieces

    def read(self, partition: Span | Spans) -> Iterator[tuple]:
        for span in getattr(partition, "spans", [partition]):
            yield os.path.basename(span.path), span.path, span.high


class ClosedCaptures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "closed_captures"

    def schema(self) -> str:
        return CLOSED

    def streamReader(self, schema: StructType) -> Closed:  # noqa: N802
        return Closed(self.options)


def read_closed(spark: SparkSession, path: str, still: int = 3) -> DataFrame:
    """A stream of the captures that are complete, each once and again when it has grown; the checkpoint is the log of what is processed."""
    _register(spark, ClosedCaptures)
    return spark.readStream.format("closed_captures").option("still", str(still)).option("sizes", "true").load(path)


def _block(kind: int, body: bytes) -> bytes:
    body += bytes(-len(body) % 4)
    size = struct.pack("<I", len(body) + 12)
    return struct.pack("<I", kind) + size + body + size


def _frame(source: str, target: str, data: bytes) -> bytes:
    ip = b"\x45" + bytes(8) + b"\x11" + bytes(2) + bytes(map(int, source.split("."))) + bytes(map(int, target.split(".")))
    return bytes(12) + b"\x08\x00" + ip + struct.pack(">HHHH", 6006, 6006, 8 + len(data), 0) + data


def write_captures(packets: DataFrame, folder: str) -> None:
    """One pcapng file for each capture of packets, in order of pkt_no; for replays and for trying decoders.

    A capture is a sorted run within a task and streams to its file, which gets its name when it is complete.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, made = None, None, 0
        target = local(folder)
        os.makedirs(target, exist_ok=True)
        partial = f"{target}/.{TaskContext.get().taskAttemptId()}"

        def done() -> None:
            if out:
                out.close()
                os.replace(partial, f"{target}/capture-{name}.pcapng")

        for b in batches:
            for capture_id, source, to, data in zip(*(b.column(c).to_pylist() for c in ("capture_id", "src_ip", "dst_ip", "payload")), strict=True):
                if out is None or capture_id != name:
                    done()
                    out, name, made = open(partial, "wb", buffering=1 << 20), capture_id, made + 1
                    out.write(_block(SECTION, struct.pack("<IHHq", ORDER, 1, 0, -1)) + _block(INTERFACE, struct.pack("<HHI", ETHERNET, 0, 0)))
                frame = _frame(source, to, data)
                out.write(_block(ENHANCED, struct.pack("<IIIII", 0, 0, 0, len(frame), len(frame)) + frame))
        done()
        yield pa.RecordBatch.from_pydict({"files": pa.array([made], pa.int64())})

    rows = packets.repartition("capture_id").sortWithinPartitions("capture_id", "pkt_no").select("capture_id", "src_ip", "dst_ip", "payload")
    rows.mapInArrow(run, "files long").agg({"files": "sum"}).collect()
