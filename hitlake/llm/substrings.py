"""Exact substring deduplication over a compacted de Bruijn graph of words.

Every run of ``window`` words is an edge of the graph whose nodes are runs of one word less. An edge that starts
earlier elsewhere (smaller doc_id, or the same document and an earlier start) is a repeat, and all of its words go.

Only edges that can repeat are shuffled. Each edge is known by its minimizer, the least hash of the shorter runs in
it, and equal edges have equal minimizers; so a first pass counts the sparse minimizers (about one word in six), those
that stand at two places are set in a table of bits of bounded size (a false hit costs work, never a result), and only
edges of such minimizers go on, as 128-bit hashes with their source coordinates. The first place of an edge that very
many texts may share is aggregated before it is shuffled and joined back; the others, of which one has HOT rows at
most, are ordered. Edges whose coordinates advance together in the copy and in the first source are a nonbranching path
and compact to one span. Documents of equal text count once: the first keeps its words, the others lose theirs if they
have a window at all.

An empty table gives no rows; columns other than doc_id and text are ignored by ``dedup`` and kept by ``strip``. Null
texts are empty. A null doc_id sorts before all others. Rows that repeat doc_id and text are one document and get
the same result. Other texts of one doc_id are documents of their own, one after another by the hash of the text: each
has a number, which stands above the 32 bits of its places. Texts shorter than a window lose nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import remove, shared_folder
from .text import P2, Seen, bit_table, gram_hashes, in_table, mixed, slices, tidy, utf8, whole, word_ids

LOWEST = -(1 << 63)
HOT = 4096  # texts that may share a minimizer whose edges one task orders
TABLE = (20, 27)  # least and most bits of the number of bits in the table of minimizers
SALT = 16
SMALL = 1 << 20  # rows of three numbers that may be broadcast
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each run of ``width`` values."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def _edges(texts: list[bytes | None], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word ids, offsets, hashes of the shorter runs, minimizer of each edge and whether the edge lies in one text."""
    ids, offsets = word_ids(texts)
    short = max(1, window // 2)
    runs = gram_hashes(ids, short)
    inside = whole(offsets, window)
    least = _sliding(runs, window - short + 1, np.minimum) if len(inside) else np.empty(0, np.uint64)
    return ids, offsets, runs, least, inside


def _keyed(docs: DataFrame) -> DataFrame:
    """d: doc_id without nulls; c: hash of the text; text as bytes."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("d"), F.xxhash64("text").alias("c"), utf8().alias("text"))


def minimizers(docs: DataFrame, window: int) -> DataFrame:
    """(a, c, many): the distinct minimizers of each text and whether it has them at several places; a text that a task has seen is not repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for b in batches:
            rows = [(c, t) for c, t in zip(b.column("c").to_pylist(), b.column("text").to_pylist(), strict=True) if t and seen.new(c)]
            for lo, hi in slices([t for _, t in rows]):
                some = rows[lo:hi]
                _, offsets, runs, least, inside = _edges([t for _, t in some], window)
                if not inside.any():
                    continue
                width = window - max(1, window // 2) + 1
                edge = np.concatenate([np.zeros(width - 1, np.uint64), np.where(inside, least, 0), np.zeros(width - 1, np.uint64)])
                at = np.flatnonzero((_sliding(edge, width, np.maximum) == runs) & (runs > 0))
                doc = np.searchsorted(offsets, at, "right") - 1
                order = np.lexsort((runs[at], doc))
                a, doc = runs[at][order], doc[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                many = np.diff(np.append(first, len(a))) > 1
                keys = np.array([c for c, _ in some], np.int64)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a[first].view(np.int64)), "c": pa.array(keys[doc[first]]), "many": pa.array(many)})

    return docs.select("c", "text").mapInArrow(tidy(run), "a long, c long, many boolean")


def edges(docs: DataFrame, window: int, table: np.ndarray, often: np.ndarray) -> DataFrame:
    """(w1, w2, d, start, own, hot) of the edges whose minimizer is in ``table``, of docs (d, nth, text); hot: it is in ``often``.

    An edge that its text has before, at ``own``, is a repeat whatever other texts hold: its hash is replaced by one of
    its place, so that a text of one word over and over does not gather in one task.
    """
    shared = docs.sparkSession.sparkContext.broadcast((table, often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, often = shared.value
        for b in batches:
            texts, keys, nth = b.column("text").to_pylist(), b.column("d").to_numpy(), b.column("nth").to_numpy().astype(np.int64) << 32
            for lo, hi in slices(texts):
                ids, offsets, _, least, inside = _edges(texts[lo:hi], window)
                slot = _slot(least.view(np.int64), len(table))
                at = np.flatnonzero(inside & in_table(table, slot)) if len(inside) else np.empty(0, np.int64)
                first = gram_hashes(ids, window)
                second = gram_hashes(mixed(ids ^ P2), window, P2)
                doc = np.searchsorted(offsets, at, "right") - 1
                w1, w2, start, own = first[at], second[at], at - offsets[doc] + nth[lo + doc], np.full(len(at), -1, np.int64)
                hot = in_table(often, _slot(least[at].view(np.int64), len(often)))
                order = np.lexsort((at, w1, doc))
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(doc[order]) != 0) | (w1[order][1:] != w1[order][:-1]) | (w2[order][1:] != w2[order][:-1])
                head = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                again = order[~new]
                own[again] = start[order[head[~new]]]
                w1[again] = mixed(keys[lo + doc[again]].view(np.uint64) * P2 + start[again].astype(np.uint64))
                hot[again] = False
                for s in range(0, len(at), 100_000):
                    e = slice(s, s + 100_000)
                    yield pa.RecordBatch.from_pydict({"w1": pa.array(w1[e].view(np.int64)), "w2": pa.array(w2[e].view(np.int64)), "d": pa.array(keys[lo + doc[e]]), "start": pa.array(start[e]), "own": pa.array(own[e], mask=own[e] < 0), "hot": pa.array(hot[e])})

    return docs.select("d", "nth", "text").mapInArrow(tidy(run), "w1 long, w2 long, d long, start long, own long, hot boolean")


def _slot(a: np.ndarray, size: int) -> np.ndarray:
    """Place of minimizers in a table of ``size`` bytes."""
    return a & (8 * size - 1)


def _tables(keyed: DataFrame, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimizers that stand at two places, and those in more than HOT texts, as tables of bits."""
    folder = shared_folder(keyed.sparkSession, "minimizers")
    counted = minimizers(keyed, window).groupBy("a").agg(F.max("many").alias("many"), F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n"))
    counted.where("many OR low < high").select("a", "n").write.parquet(folder)
    found = keyed.sparkSession.read.parquet(folder)
    bits = int(np.clip((16 * found.count()).bit_length(), *TABLE))
    often = found.where(F.col("n") > HOT)
    slot = lambda b: F.col("a").bitwiseAND(F.lit((1 << b) - 1).cast("long")).alias("slot")
    tables = bit_table(found.select(slot(bits)), bits), bit_table(often.select(slot(TABLE[0])), TABLE[0])
    remove(keyed.sparkSession, folder)
    return tables


def _joined(rows: DataFrame, few: DataFrame, how: str) -> DataFrame:
    """rows joined with few by (d, c); few is broadcast if it has SMALL rows at most."""
    return rows.join(F.broadcast(few) if few.count() <= SMALL else few.hint("merge"), ["d", "c"], how)


def _paths(keyed: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts that are whole copies (d, c), the others that can hold spans (d, c, nth), and repeated spans (d, nth, start, end, source_d, source_start), end excluded."""
    owners = keyed.where(F.octet_length("text") > 0).select("d", "c", F.xxhash64("text", F.lit(1)).alias("c2"))
    firsts = owners.groupBy("c", "c2").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    several = firsts.where("first < last").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    copies = owners.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALT).cast("long")).cast("int")).join(several, ["c", "c2", "salt"]).where("d > first").select("d", "c").distinct()
    of_doc = Window.partitionBy("d").orderBy("c")
    numbered = firsts.select(F.col("first").alias("d"), "c").distinct().withColumn("nth", F.row_number().over(of_doc) - 1)

    table, often = _tables(keyed, window)
    single = _joined(_joined(keyed.where(F.octet_length("text") > 0), copies, "left_anti"), numbered.where("nth > 0"), "left").withColumn("nth", F.coalesce("nth", F.lit(0)))
    found = edges(single, window, table, often)

    same = Window.partitionBy("w1", "w2").orderBy("d", "start")
    here, own = F.struct("d", "start"), F.struct("d", F.col("own").alias("start"))
    few = found.where("NOT hot").withColumn("first", F.first(here).over(same))
    hot = found.where("hot")
    hot = hot.join(hot.groupBy("w1", "w2").agg(F.min(here).alias("first")), ["w1", "w2"]).select(*few.columns)
    sourced = few.unionByName(hot).withColumn("source", F.when(F.col("own").isNotNull(), own).otherwise(F.col("first")))
    repeats = sourced.where((here != F.col("first")) | F.col("own").isNotNull()).select("d", "start", F.col("source.d").alias("source_d"), (F.col("start") - F.col("source.start")).alias("ahead"))
    by_doc = repeats.repartition("d")
    along = Window.partitionBy("d", "source_d", "ahead").orderBy("start")
    stepped = by_doc.withColumn("path", F.col("start") - F.dense_rank().over(along))  # rows that repeat a text have its edges again
    spans = stepped.groupBy("d", "source_d", "ahead", "path").agg(F.min("start").alias("start"), (F.max("start") + window).alias("end"))
    place = lambda c: c.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return copies, numbered, spans.select("d", F.shiftright("start", 32).cast("int").alias("nth"), place(F.col("start")).alias("start"), place(F.col("end")).alias("end"), "source_d", place(F.col("start") - F.col("ahead")).alias("source_start"))


def repeated_spans(docs: DataFrame, window: int = 20) -> DataFrame:
    """Spans of words that stand earlier elsewhere: doc_id, start, end (excluded), source_doc_id, source_start; whole copies are left out."""
    *_, spans = _paths(_keyed(docs), window)
    back = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
    return spans.select(back("d").alias("doc_id"), "start", "end", back("source_d").alias("source_doc_id"), "source_start")


def _gone(words: list[bytes], spans: list | None, copy: bool | None, window: int) -> np.ndarray:
    """Which of a text's words go."""
    gone = np.zeros(len(words), bool)
    if copy and len(words) >= window:
        gone[:] = True
    for s in spans or ():
        gone[s["start"] : s["end"]] = True
    return gone


def _losses(keyed: DataFrame, window: int) -> DataFrame:
    """(d, c, copy, spans) of the texts that lose words."""
    copies, numbered, spans = _paths(keyed, window)
    own = spans.groupBy("d", "nth").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # of one text: no more than its words
    # spans belong to the first text of its kind; a copy has a row of its own
    firsts = numbered.join(own, ["d", "nth"]).select("d", "c", F.lit(False).alias("copy"), "spans")
    return firsts.unionByName(copies.select("d", "c", F.lit(True).alias("copy"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans")))


def dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space) of every row."""
    keyed = _keyed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, digests = [], [], []
            for text, copy, spans in zip(*(b.column(k).to_pylist() for k in ("text", "copy", "spans")), strict=True):
                words = (text or b"").split()
                n.append(len(words))
                removed.append(0)
                if copy or spans:
                    gone = _gone(words, spans, copy, window)
                    removed[-1] = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            ids = pa.array([None if d == LOWEST else d for d in b.column("d").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    joined = keyed.join(_losses(keyed, window).hint("merge"), ["d", "c"], "left").select("d", "text", "copy", "spans")
    return joined.mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip(docs: DataFrame, window: int = 20) -> DataFrame:
    """docs, all columns, without the repeated words; rows that lose all their words go.

    The white space before a kept word stays, and a text that loses nothing stays as it is.
    """
    keyed = _keyed(docs)
    d, c = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)), F.xxhash64("text")
    rows = docs.select(d.alias("d"), c.alias("c"), F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, texts, stays = b.column("row"), [], []
            for text, copy, spans in zip(row.field("text").to_pylist(), b.column("copy").to_pylist(), b.column("spans").to_pylist(), strict=True):
                left = True
                if copy or spans:
                    raw = text.encode()
                    gone = _gone(raw.split(), spans, copy, window)
                    left = not (len(gone) and gone.all())
                    text = _spliced(raw, gone) if gone.any() else text
                texts.append(text)
                stays.append(left)
            cols = [pa.array(texts, pa.string()) if f.name == "text" else row.field(f.name) for f in row.type]
            kept = pa.StructArray.from_arrays(cols, fields=list(row.type)).filter(pa.array(stays, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept], ["row"])

    joined = rows.join(_losses(keyed, window).hint("merge"), ["d", "c"], "left").select("row", "copy", "spans")
    return joined.mapInArrow(tidy(run), T.StructType([T.StructField("row", rows.schema["row"].dataType)])).select("row.*")


def _spliced(text: bytes, gone: np.ndarray) -> str:
    """text without the words that are gone, each with the white space before it."""
    parts, at = [], 0
    for m, g in zip(WORD.finditer(text), gone.tolist(), strict=True):
        if not g:
            parts.append(text[at : m.end()])
        at = m.end()
    return b"".join([*parts, text[at:]]).strip().decode()

