"""Benchmark decontamination by SimHash over item-sized windows.

A window has as many words as a benchmark item. Windows and items get a 64-bit SimHash of their k-word shingles.
Fingerprints are cut into ``BLOCKS`` blocks of 16 bits; of two within ``radius`` bits one block differs in
``radius // BLOCKS`` bits at most, so items are entered under all values that near to each of their blocks, and a join
by (length, block, value) finds every fingerprint within the radius. Candidates are verified by the exact weighted
similarity of their shingles: the sum of the smaller counts by the sum of the larger ones.

Only windows that can reach the similarity are fingerprinted: at least that share of a window's shingles must be
shingles of items of its length, by a table of bits whose size follows from the items (a false hit costs work, never a
result). A window travels as its place, fingerprint and the 128-bit hash of its words; windows of equal words are
compared once, as a leaked passage may stand in very many documents, and the words of one of them are read again at its
place when a fingerprint is near. SimHash is what loses a match: at a similarity of 0.8 about one window in fifty is
beyond the radius, at 0.85 under one in a thousand.

Words are lower-cased (A-Z). Null texts have no windows; items with fewer than k words are too short to tell and never
match; null and repeated items and documents are tolerated: rows with equal ids count as one. Of several windows of one
document that are equally similar to an item the first counts. Empty tables give no rows; columns other than the ids
and texts are ignored. Long texts are read whole, their windows some thousands at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut_lineage, shared_folder, small
from .text import P1, P2, bit_table, gram_hashes, in_table, mixed, slices, tidy, utf8, whole, word_ids

LEAST_BITS, MOST_BITS = 20, 28  # of the table: 4 bits a slot; 32 MB serve some hundred million slots
BLOCKS = 4
AT_ONCE = 1 << 15  # windows
CHUNK = 1 << 16  # words of a text whose windows are verified together


def _slot(shingles: np.ndarray, length: int) -> np.ndarray:
    """Numbers of 62 bits, of which the table's size takes the lowest."""
    return (mixed(shingles + np.uint64(length)) >> np.uint64(2)).astype(np.int64)


def _any_slot(shingles: np.ndarray) -> np.ndarray:
    return _slot(shingles, 0)


def fingerprints(shingles: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """SimHash of the ``count`` shingles from each start."""
    lo, hi = int(starts.min()), int(starts.max()) + count
    ones = np.unpackbits(shingles[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(ones, axis=0, dtype=np.int32)])
    more = 2 * (total[starts - lo + count] - total[starts - lo]) > count
    return np.packbits(more, axis=1).view("<u8").ravel()


def similarity(a: bytes, b: bytes, k: int) -> float:
    """Weighted Jaccard similarity of the k-word shingles of two texts."""
    x, y = (Counter(zip(*(w[i:] for i in range(k)), strict=False)) for w in (a.lower().split(), b.lower().split()))
    most = sum((x | y).values())
    return sum((x & y).values()) / most if most else 0.0


def _items(items: DataFrame, k: int) -> DataFrame:
    """(item_id, item, length, fp, slots) of the items that are long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids, _ = word_ids([text], lower=True)
                if len(ids) >= k:
                    shingles = gram_hashes(ids, k)
                    fp = fingerprints(shingles, np.zeros(1, np.int64), len(shingles)).view(np.int64)[0]
                    rows.append({"item_id": item, "item": text, "length": len(ids), "fp": int(fp), "slots": np.concatenate([_slot(shingles, len(ids)), _any_slot(shingles)]).tolist()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("item_id", pa.int64()), ("item", pa.binary()), ("length", pa.int32()), ("fp", pa.int64()), ("slots", pa.list_(pa.int64()))]))

    return items.select(F.col("item_id").cast("long").alias("item_id"), utf8().alias("text")).where("text IS NOT NULL").mapInArrow(tidy(run), "item_id long, item binary, length int, fp long, slots array<long>")


def windows(docs: DataFrame, table: np.ndarray, lengths: list[int], k: int, least: float) -> DataFrame:
    """(doc_id, t, t2, start, length, fp, w, w2) of the windows that may match an item of their length.

    t, t2 and w, w2 are hashes of the text and of the window's words; of equal windows near each other the first counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)  # of MOST_BITS at most
    mask = 8 * len(table) - 1

    def has(at: np.ndarray) -> np.ndarray:
        return in_table(shared.value, at & mask)

    def of_text(ids: np.ndarray, shingles: np.ndarray, hits: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
        for length in lengths:
            count = length - k + 1
            if len(ids) < length or len(hits) < least * count:
                return  # nor can longer ones
            good = hits[has(_slot(shingles[hits], length))]
            if len(good) < least * count:
                continue
            total = np.zeros(len(ids) + 1, np.int32)
            total[good + 1] = 1
            total = np.cumsum(total, dtype=np.int32)
            starts = np.arange(len(ids) - length + 1)
            starts = starts[total[starts + count] - total[starts] >= least * count - 1e-9]
            for n in range(0, len(starts), AT_ONCE):
                some = starts[n : n + AT_ONCE]
                part = ids[some[0] : some[-1] + length]
                w, w2 = (gram_hashes(part, length, base)[some - some[0]] for base in (P1, P2))
                _, first = np.unique(w, return_index=True)
                first.sort()
                some = some[first]
                yield some, length, fingerprints(shingles, some, count), w[first], w2[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, names = b.column("text").to_pylist(), b.select(["doc_id", "t", "t2"])
            for lo, hi in slices(texts):
                ids, offsets = word_ids(texts[lo:hi], lower=True)
                shingles, inside = gram_hashes(ids, k), whole(offsets, k)
                hits = np.flatnonzero(has(_any_slot(shingles)) & inside)
                for d in np.unique(np.searchsorted(offsets, hits, "right") - 1).tolist():
                    first, last = int(offsets[d]), int(offsets[d + 1])
                    mine = hits[np.searchsorted(hits, first) : np.searchsorted(hits, last)] - first
                    for starts, length, fp, w, w2 in of_text(ids[first:last], shingles[first : last - k + 1], mine):
                        own = names.take(pa.array([lo + d] * len(starts)))
                        columns = [*own.columns, pa.array(starts), pa.array([length] * len(starts), pa.int32()), *(pa.array(x.view(np.int64)) for x in (fp, w, w2))]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "t2", "start", "length", "fp", "w", "w2"])

    return _texts(docs).mapInArrow(tidy(run), "doc_id long, t long, t2 long, start long, length int, fp long, w long, w2 long")


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes of it."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    return texts.withColumns({"t": F.xxhash64("text"), "t2": F.xxhash64("text", F.lit(1))})


def _block(i: int) -> Column:
    return F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))


def _probes(distance: int) -> list[int]:
    """All 16-bit numbers of at most ``distance`` ones."""
    return [sum(1 << k for k in bits) for n in range(distance + 1) for bits in combinations(range(16), n)]


def find(docs: DataFrame, items: DataFrame, k: int = 5, least: float = 0.8, radius: int = 15) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity: the best window of each document for each item it holds."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession, "decontaminate")
    _items(items, k).dropDuplicates(["item_id", "item"]).write.parquet(f"{folder}/items")
    known = spark.read.parquet(f"{folder}/items")
    lengths = sorted(r["length"] for r in known.select("length").distinct().collect())  # no more than the longest item's words
    slots = known.agg(F.coalesce(F.sum(F.size("slots")), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, (4 * slots).bit_length()))
    table = bit_table(known.select(F.explode("slots").alias("slot")).select(F.col("slot").bitwiseAND(F.lit((1 << bits) - 1)).alias("slot")), bits)
    windows(docs, table, lengths, k, least).write.parquet(f"{folder}/windows")
    found = spark.read.parquet(f"{folder}/windows")

    one = F.min(F.struct("t", "t2", "doc_id", "start")).alias("one")
    once = found.groupBy("length", "w", "w2").agg(F.first("fp").alias("fp"), one)
    left = once.withColumn("at", F.explode(F.array(*(F.struct(F.lit(i).alias("block"), _block(i).alias("value")) for i in range(BLOCKS)))))
    probes = F.lit(_probes(radius // BLOCKS))
    blocks = F.explode(F.array(*(F.struct(F.lit(i).alias("block"), _block(i).alias("value")) for i in range(BLOCKS)))).alias("b")
    entered = known.select("item_id", "length", "fp", blocks).select("item_id", "length", F.col("fp").alias("item_fp"), "b", F.explode(probes).alias("probe"))
    right = entered.select("item_id", "length", "item_fp", F.struct(F.col("b.block").alias("block"), F.col("b.value").bitwiseXOR(F.col("probe").cast("long")).alias("value")).alias("at"))
    near = left.join(right.hint("merge"), ["length", "at"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    pairs = near.select("length", "w", "w2", "item_id", "one").dropDuplicates(["length", "w", "w2", "item_id"]).join(known.select("item_id", "length", "item"), ["item_id", "length"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, asked in zip(b.column("text").to_pylist(), b.column("asked"), strict=True):
                words, rows = text.split(), []
                for r in asked.as_py():
                    alike = similarity(b" ".join(words[r["start"] : r["start"] + r["length"]]), r["item"], k)
                    if alike >= least:
                        rows.append((r["length"], r["w"], r["w2"], r["item_id"], alike))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["length", "w", "w2", "item_id", "similarity"])

    of = ["of", "t", "t2", F.floor(F.col("start") / CHUNK).alias("chunk")]
    asked = pairs.select(F.col("one.doc_id").alias("of"), "one.t", "one.t2", "one.start", "length", "w", "w2", "item_id", "item")
    asked = asked.groupBy(*of).agg(F.collect_list(F.struct("start", "length", "w", "w2", "item_id", "item")).alias("asked"))
    texts = _texts(docs).withColumnsRenamed({"t": "u", "t2": "u2"})
    same = (F.col("u") == F.col("t")) & (F.col("u2") == F.col("t2")) & F.col("doc_id").eqNullSafe(F.col("of"))
    asked = cut_lineage(asked)
    texts = texts.join(small(asked.select("of", "t", "t2").distinct()), same, "left_semi")  # what is not asked for is not shuffled
    read = texts.join(asked, same).dropDuplicates(["t", "t2", "chunk"])
    sure = read.select("text", "asked").mapInArrow(tidy(verify), "length int, w long, w2 long, item_id long, similarity double")
    held = found.select("doc_id", "start", "length", "w", "w2").join(small(sure), ["length", "w", "w2"])
    best = held.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"), F.col("length").alias("n_words"))).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.before")).cast("int").alias("start"), "best.n_words", "best.similarity")
