"""Best-fit packing by linear grouping: as few sequences of at most ``longest`` ids as can be, whole documents where they fit.

Only documents longer than a sequence are cut, into full pieces and a rest. How pieces are combined depends on their
lengths alone, so the plan is made from the number of pieces of each length: at most ``longest`` numbers, whatever the
table's size.

1. Large lengths (over a quarter of longest) stand in descending order and are cut into groups of equal cardinality; each length
   counts as the largest of its group, so that few sizes are left. Lengths that are few already keep their size.
2. The linear programme over configurations (which sizes share a sequence) is solved by column generation,
   new columns being knapsacks under the dual prices; whole numbers of each configuration are kept.
3. The places of a configuration get actual lengths of the group, which are never larger.
4. What is left over, then the small lengths, go by best fit, longest first, into what room the sequences have; sequences
   of one content are one class, so that a length is dealt to a class at a time.

Pieces are numbered within their length without collecting them: each task counts its own, and the tasks' counts are
added up by length. The plan (its size is bound by ``longest`` and ``groups``, not by the documents) reaches the tasks,
which look up each piece's sequence and place.

ids are those of the word-BPE tokenizer, then the end id. Null and empty texts have the end id alone; an empty table
gives no rows. Rows that repeat a doc_id, or have none, are packed one by one (null doc_id stays null). Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import shared_folder
from .packing import _texts, encoder
from .text import tidy

LONGEST = 4096
END = 1
GROUPS = 128
LARGE = 4  # a length over longest / LARGE is large
NEAR = 2e-4
ROUNDS = 4000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
SHIFT = 40  # of the length in a key of (length, number within it)


def linear_groups(counts: np.ndarray, groups: int) -> list[list[list[int]]]:
    """Groups of [length, number] in descending order; counts[length] pieces of each length. Groups have equally many, the last what is left."""
    lengths = np.flatnonzero(counts)[::-1].tolist()
    if len(lengths) <= groups:
        return [[[n, int(counts[n])]] for n in lengths]
    size = -(-int(counts.sum()) // groups)
    out, room = [], 0
    for n in lengths:
        left = int(counts[n])
        while left:
            if not room:
                out.append([])
                room = size
            some = min(left, room)
            out[-1].append([n, some])
            left, room = left - some, room - some
    return out


class Knapsack:
    """The most valuable items, repeats allowed, of total size at most ``longest``."""

    def __init__(self, sizes: np.ndarray, longest: int):
        self.sizes, self.longest = sizes, longest
        # what fits into room c depends on rooms under c - min(sizes) + 1 alone, so rooms go in blocks of that many
        blocks = np.split(np.arange(longest + 1), np.arange(int(sizes.min()), longest + 1, int(sizes.min())))
        self.blocks = [(c[0], c[-1] + 1, np.where(c >= sizes[:, None], c - sizes[:, None], longest + 1)) for c in blocks[1:]]

    def best(self, prices: np.ndarray) -> tuple[float, np.ndarray]:
        """The greatest sum of prices, and how many there are of each item."""
        value, what = np.zeros(self.longest + 2), np.full(self.longest + 1, -1)
        value[-1] = -np.inf  # no room
        for low, high, rest in self.blocks:
            with_k = value[rest] + prices[:, None]
            k = with_k.argmax(0)
            top = with_k[k, np.arange(high - low)]
            value[low:high], what[low:high] = np.maximum(top, 0), np.where(top > 0, k, -1)
        many, room = np.zeros(len(self.sizes), np.int64), self.longest
        while (k := what[room]) >= 0:
            many[k] += 1
            room -= self.sizes[k]
        return float(prices @ many), many


def configurations(sizes: np.ndarray, demand: np.ndarray, longest: int) -> list[tuple[np.ndarray, int]]:
    """(pieces of each size, sequences): whole parts of a solution of the configurations' linear programme, within NEAR of its least."""
    n, knapsack = len(sizes), Knapsack(sizes, longest)
    columns = [np.eye(n, dtype=np.int64)[k] * (longest // int(sizes[k])) for k in range(n)]
    costs, inverse = np.ones(n), np.diag([1.0 / (longest // int(s)) for s in sizes])
    amounts = inverse @ demand
    for turn in range(1, ROUNDS):
        prices = costs @ inverse
        worst = int(np.argmin(prices))
        if prices[worst] < -1e-9:  # more of this size than is asked for costs nothing
            enter, cost = -np.eye(n, dtype=np.int64)[worst], 0.0
        else:
            value, enter = knapsack.best(prices)
            cost = 1.0
            if value <= 1 + NEAR:  # no solution is under the present one / value
                break
        step = inverse @ enter
        up = np.flatnonzero(step > 1e-9)
        if not len(up):
            break
        out = int(up[np.argmin(np.maximum(amounts[up], 0) / step[up])])
        columns[out], costs[out] = enter, cost
        if turn % 100:
            inverse[out] /= step[out]
            rest = np.arange(n) != out
            inverse[rest] -= np.outer(step[rest], inverse[out])
        else:  # rounding errors go
            inverse = np.linalg.inv(np.stack(columns, 1).astype(np.float64))
        amounts = inverse @ demand
    whole = np.floor(amounts + 1e-6).astype(np.int64)
    return [(c, int(m)) for c, m, cost in zip(columns, whole, costs, strict=True) if m > 0 and cost]


class Sequences:
    """Classes of sequences with one content each: by the room that is left, [content, number]. Content is (before, length, copies)."""

    def __init__(self, longest: int):
        self.longest = longest
        self.classes: list[list[list]] = [[] for _ in range(longest + 1)]
        self.there = np.zeros(longest + 1, bool)

    def add(self, room: int, content: tuple | None, number: int) -> None:
        if number:
            self.classes[room].append([content, number])
            self.there[room] = True

    def best_fit(self, length: int, number: int) -> None:
        """Each piece goes where the least room is left that holds it, or into a new sequence."""
        while number:
            room = length + int(np.argmax(self.there[length:]))
            if not self.there[room]:
                self.add(self.longest, None, -(-number // (self.longest // length)))
                continue
            content, have = self.classes[room].pop()
            self.there[room] = bool(self.classes[room])
            each = room // length
            full = min(have, number // each)
            self.add(room - each * length, (content, length, each), full)
            have, number = have - full, number - full * each
            if have and 0 < number < each:
                self.add(room - number * length, (content, length, number), 1)
                have, number = have - 1, 0
            self.add(room, content, have)


def _place(sequences: Sequences, many: np.ndarray, number: int, groups: list[list[list[int]]]) -> None:
    """``number`` sequences of a configuration: its places get the longest lengths that their groups still have."""
    slots = [k for k in np.flatnonzero(many).tolist() for _ in range(int(many[k]))]
    runs = []  # of each slot: [length, number] one after the other, length 0 when the group has no more
    for k in slots:
        left, own = number, []
        while left and groups[k]:
            some = min(left, groups[k][0][1])
            own.append([groups[k][0][0], some])
            groups[k][0][1] -= some
            if not groups[k][0][1]:
                groups[k].pop(0)
            left -= some
        runs.append(own + [[0, left]] * bool(left))
    while number:
        some = min(run[0][1] for run in runs)
        content, room = None, sequences.longest
        for run in runs:
            if run[0][0]:
                content, room = (content, run[0][0], 1), room - run[0][0]
            run[0][1] -= some
            if not run[0][1]:
                run.pop(0)
        sequences.add(room, content, some if content else 0)
        number -= some


def plan(counts: np.ndarray, longest: int = LONGEST, groups: int = GROUPS) -> np.ndarray:
    """Rows (length, first, copies, sequences, base, offset) in order of the first two; counts[length] pieces of each length.

    The pieces of a length from number ``first`` on go, ``copies`` to each of so many ``sequences`` numbered from
    ``base``, to ``offset`` and the places after it.
    """
    left, sequences = counts.copy(), Sequences(longest)
    large = counts * (np.arange(longest + 1) > longest // LARGE)
    if large.any():
        grouped = linear_groups(large, groups)
        sizes: dict[int, list[list[int]]] = {}  # groups of one rounded length are one
        for g in grouped:
            sizes.setdefault(g[0][0], []).extend(g)
        lengths, lists = np.array(list(sizes)), list(sizes.values())
        demand = np.array([sum(n for _, n in g) for g in lists])
        for many, number in configurations(lengths, demand, longest):
            _place(sequences, many, number, lists)
        left[longest // LARGE + 1 :] = 0
        for g in lists:
            for length, n in g:
                left[length] += n
    for length in np.flatnonzero(left)[::-1].tolist():
        sequences.best_fit(length, int(left[length]))
    rows, base, given = [], 0, defaultdict(int)
    for some in sequences.classes:
        for content, number in some:
            parts = []
            while content:
                content, length, copies = content
                parts.append((length, copies))
            offset = 0
            for length, copies in reversed(parts):
                rows.append((length, given[length], copies, number, base, offset))
                given[length] += copies * number
                offset += copies * length
            base += number
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def cut(docs: DataFrame, tokenizer_path: str, longest: int = LONGEST, end_id: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces: doc_id, piece, start, length, ids_crc32, and task and nth, the number of the piece among its task's of the same length."""
    schema = PIECES + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, met = TaskContext.get().partitionId(), np.zeros(longest + 1, np.int64)
        for b in batches:
            for lo, hi, texts, owner in _texts(b.column("text")):
                ids, counts = encoder(tokenizer_path).encode(texts)
                if owner is not None:
                    counts = np.bincount(owner, counts, minlength=hi - lo).astype(np.int64)
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                n = counts + 1
                many = -(-n // longest)
                which = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                length = np.minimum(longest, n[which] - piece * longest)
                ends = np.cumsum(length)
                data = memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(data[4 * (z - m) : 4 * z]) for z, m in zip(ends.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                own, first, of = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(order)) + np.repeat(met[own] - first, of)
                met[own] += of
                cols = [b.column("doc_id").take(pa.array(lo + which)), piece.astype(np.int32), piece * longest, length, np.array(crc, np.int64), np.full(len(which), task, np.int32), nth]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), schema)


def pack(docs: DataFrame, tokenizer_path: str, longest: int = LONGEST, end_id: int = END, groups: int = GROUPS, with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and place; with_ids: with its ids (array of int)."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession, "pieces")
    cut(docs, tokenizer_path, longest, end_id, with_ids).write.parquet(folder)
    pieces = spark.read.parquet(folder)
    own = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(longest + 1, np.int64)
    for r in own.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``longest`` rows
        counts[r["length"]] = r["n"]
    rows = plan(counts, longest, groups)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    firsts = own.select("task", "length", F.coalesce(before, F.lit(0)).alias("first"))
    schema = SCHEMA + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (rows[:, 0] << SHIFT) + rows[:, 1]
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            _, first, copies, _, base, offset = rows[np.searchsorted(keys, (length << SHIFT) + number, "right") - 1].T
            place, k = np.divmod(number - first, copies)
            kept = {c: b.column(c) for c in b.schema.names if c != "number"}
            kept |= {"sequence_id": pa.array(base + place), "offset": pa.array(offset + k * length)}
            yield pa.RecordBatch.from_pydict({c: kept[c] for c in (f.split()[0] for f in schema.split(", "))})

    numbered = pieces.join(firsts, ["task", "length"]).withColumn("number", F.col("first") + F.col("nth")).drop("task", "nth", "first")
    return numbered.mapInArrow(tidy(run), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and doc_ids and starts of its pieces in their order, of pack(with_ids=True); a sequence has ``longest`` ids at most."""
    of = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "ids"))).alias("p"))
    return of.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"))
