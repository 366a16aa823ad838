"""Vector code compression: product codes, their nearest entries found by a geometric near-neighbour access tree (GNAT).

Components become integers floor(scale * x) and vectors are cut into equal parts with a codebook each, so that sums,
distances and rounds are exact whatever the order of the rows. A codebook is a GNAT over its entries: a node keeps split
points far from each other and, for each split and child, the range of the distances from that split to the child's
entries. A query's distances to the splits rule out every child whose ranges lie more than the best distance away.
Ranges and roots are rounded outwards and only a strict excess rules out, so no nearest entry is lost; the distances
that decide, and ties (to the lower entry), are compared as integers.

Tasks assign and add up; the driver holds the codebooks alone (parts x entries x part length integers), whatever the
number of vectors. Rows whose vector is null or holds null or non-finite components are left out. Fewer vectors than
entries make shorter codebooks, an empty table makes none and no rows. Repeated rows count each; a null id is no seed
before others and keeps its row. Vectors of different lengths, of a length the parts do not divide, or with components
of 2^26 / scale or more raise ValueError. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut_lineage, remove, shared_folder
from .text import tidy

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMIT = 1 << 26
DEGREE = 4  # split points of a node
LEAF = 4  # entries of a node without split points
WIDER = 1 + 2.0**-50  # more than what rounding a root and a difference can change
FEW_LABELS = 50_000


@dataclass
class Node:
    """The entries ``own`` (places in the codebook), compared one by one, or split points ``own`` with their children."""

    own: np.ndarray
    children: list[Node | None] = field(default_factory=list)
    low: np.ndarray | None = None  # (splits, children): least distance from a split to a child's entries
    high: np.ndarray | None = None


def _squares(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = x - entry
    return np.einsum("ij,ij->i", d, d)


class Gnat:
    """Nearest entries of one codebook, an array (entries, length) of int64."""

    def __init__(self, entries: np.ndarray, degree: int = DEGREE, leaf: int = LEAF):
        self.entries, self.degree, self.leaf = entries, degree, leaf
        self.compared = 0  # distances computed, for tests
        self.root = self._node(np.arange(len(entries)))

    def _node(self, places: np.ndarray) -> Node | None:
        if not len(places):
            return None
        if len(places) <= self.leaf:
            return Node(places)
        points = self.entries[places]
        splits = [0]
        away = _squares(points, points[0])
        while len(splits) < min(self.degree, len(places)):  # each split point is the farthest from those before it
            splits.append(int(np.argmax(away)))
            away = np.minimum(away, _squares(points, points[splits[-1]]))
        squares = np.stack([_squares(points, points[s]) for s in splits])
        child = np.argmin(squares, 0)
        rest = np.ones(len(places), bool)
        rest[splits] = False
        parts = [places[rest & (child == k)] for k in range(len(splits))]
        roots = np.sqrt(squares.astype(np.float64))
        low, high = np.full((len(splits), len(splits)), np.inf), np.full((len(splits), len(splits)), -np.inf)
        for k in range(len(splits)):
            if some := np.flatnonzero(rest & (child == k)).tolist():
                low[:, k], high[:, k] = roots[:, some].min(1) / WIDER, roots[:, some].max(1) * WIDER
        return Node(places[splits], [self._node(p) for p in parts], low, high)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and squared distance of the entry nearest to each row of x."""
        place, best = np.full(len(x), len(self.entries)), np.full(len(x), np.iinfo(np.int64).max)
        todo = [(self.root, np.arange(len(x)))] if self.root is not None and len(x) else []
        while todo:
            node, rows = todo.pop()
            some, squares = x[rows], []
            for e in node.own.tolist():
                d = _squares(some, self.entries[e])
                squares.append(d)
                better = (d < best[rows]) | (d == best[rows]) & (e < place[rows])
                place[rows[better]], best[rows[better]] = e, d[better]
            self.compared += len(rows) * len(node.own)
            if not node.children:
                continue
            roots = np.sqrt(np.stack(squares).astype(np.float64))
            reach = np.sqrt(best[rows].astype(np.float64)) * WIDER
            for k, child in enumerate(node.children):
                if child is not None:
                    beyond = np.maximum(node.low[:, k, None] - roots * WIDER, roots / WIDER - node.high[:, k, None]).max(0)
                    keep = ~(beyond / WIDER > reach)
                    if keep.any():
                        todo.append((child, rows[keep]))
        return place, best


@dataclass
class Codebooks:
    """entries: (parts, entries, length) int64."""

    entries: np.ndarray

    @cached_property
    def trees(self) -> list[Gnat]:
        return [Gnat(book) for book in self.entries]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts): nearest entries of vectors (rows, parts, length) and their squared distances."""
        found = [tree.nearest(np.ascontiguousarray(x[:, p])) for p, tree in enumerate(self.trees)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """(rows, parts * length): the vectors that codes (rows, parts) stand for."""
        return self.entries[np.arange(len(self.entries)), codes].reshape(len(codes), -1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole_numbers(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """vec_id, label, v of the rows kept: the integers of a vector as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            owner = np.repeat(np.arange(len(size)), size)
            bad = np.bincount(owner[~np.isfinite(values)], minlength=len(size)) > 0
            keep = ~bad & np.asarray(lists.is_valid())
            x = np.floor(values[keep[owner]] * scale)
            if len(x) and np.abs(x).max() >= LIMIT:
                raise ValueError(f"components must be under {LIMIT // scale}")
            ends = np.concatenate([[0], np.cumsum(size[keep])]) * 4
            data = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(x.astype("<i4"))])
            kept = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(kept), b.column("label").filter(kept), data.cast(pa.binary())], ["vec_id", "label", "v"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(vector).alias("v"))
    return rows.mapInArrow(tidy(run), "vec_id long, label long, v binary")


def _matrix(column: pa.Array, parts: int, length: int) -> np.ndarray:
    """(rows, parts, length) int64 of a column of whole_numbers."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    if (size != 4 * parts * length).any():
        raise ValueError("vectors must be of one length")
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64).reshape(-1, parts, length)


def _round(numbers: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round: means of the parts of each entry, rounded down; unused entries stay."""
    parts, entries, length = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, length), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            x = _matrix(b.column("v"), parts, length)
            place, _ = books.assign(x)
            for p in range(parts):
                order = np.argsort(place[:, p], kind="stable")
                used, first = np.unique(place[order, p], return_index=True)
                if len(used):
                    sums[p, used] += np.add.reduceat(x[order, p], first, 0)
                    counts[p, used] += np.diff([*first, len(order)])
        every = np.arange(parts * entries * length)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(every), "total": pa.array(sums.ravel()), "n": pa.array(counts.ravel().repeat(length))})

    added = numbers.select("v").mapInArrow(tidy(run), "slot long, total long, n long").groupBy("slot").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    flat = books.entries.ravel().copy()
    for r in added.where("n > 0").collect():
        flat[r["slot"]] = r["total"] // r["n"]
    return Codebooks(flat.reshape(books.entries.shape))


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error) of the vectors kept, and the codebooks.

    A codebook starts as that part of the ``entries`` smallest vec_ids (ties by the vector). code has the entries of the
    parts, two hex digits each; error is the sum of their squared distances. vectors: vec_id, label and the vector.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    spark, folder = vectors.sparkSession, shared_folder(vectors.sparkSession, "vectors")
    whole_numbers(vectors, vector, scale).write.parquet(folder)
    numbers = spark.read.parquet(folder)
    first = numbers.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    length, rest = divmod(len(first[0]["v"]) // 4, parts) if first else (0, 0)
    if rest or first and not length:
        raise ValueError(f"vectors must have a multiple of {parts} components")
    if len({len(r["v"]) for r in first}) > 1:
        raise ValueError("vectors must be of one length")
    seeds = np.array([np.frombuffer(r["v"], "<i4") for r in first], np.int64).reshape(len(first), parts, length)
    books = Codebooks(seeds.transpose(1, 0, 2).copy())
    for _ in range(rounds if first else 0):
        books = _round(numbers, books)
    coded = cut_lineage(numbers.mapInArrow(tidy(_coder(books)), "vec_id long, label long, code string, error long"))
    remove(spark, folder)
    return coded, books


def _coder(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    parts, _, length = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, squares = books.assign(_matrix(b.column("v"), parts, length))
            digits = [row.tobytes().hex() for row in place.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(digits, pa.string()), pa.array(squares.sum(1))], ["vec_id", "label", "code", "error"])

    return run


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error, the error summed over equal labels, nulls together.

    Sums are made before the shuffle. They are broadcast only when they are few; else the join shuffles, and AQE splits
    a label with too many rows.
    """
    sums = cut_lineage(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    few = sums.count() <= FEW_LABELS
    return coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
