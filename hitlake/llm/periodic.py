"""Periodic run detection: all maximal repetitions of words in each text, found from multi-scale minimizers.

A run is a stretch of words with smallest period q and at least max(LEAST, 2 q) words that no neighbouring word extends.
Periods under SHORT are found by comparing a text with itself at each lag. The others belong to scales L = SHORT, 2 SHORT,
... (L <= q < 2 L), at which every window of L/2 grams of L/2 words gives its least gram (the leftmost of equal ones). A
window lies within the first period of a run and again one period later, so both have minimizers of one gram, q apart.
Equal minimizers closer than L/4 stand in a stretch of smaller period and form a chain; lags are those between members of
different chains, less than 2 L apart (at most eight chains on), which are an arithmetic progression for each two chains.
A lag and its place seed an extension that compares words both ways, so hashes of grams only suggest. Where several
periods give one stretch, the smallest is its period. Equality of words rests on 64-bit hashes.

Work goes in slices of about a megabyte of whole texts, with a separator after each text; memory is about 15 times the
longest text. Null and empty texts have no words and no runs. Rows that repeat an id, or have none, are texts of their
own. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import BLANK, doc_of, gram_hashes, pieces, slices, tidy, utf8, word_ids

LEAST = 12
SHORT = 32
JOINED = 1 << 16  # words that are joined at a time
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
Tail = Callable[[int | None, int], tuple[int, int] | None]


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first items are equal."""
    done, size, most = 0, 64, min(len(a), len(b))
    a, b = a[:most], b[:most]
    while done < most:
        same = a[done : done + size] == b[done : done + size]
        if not same.all():
            return done + int(np.argmin(same))
        done, size = min(done + size, most), size * 4
    return done


def _minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """Places of the least gram, the leftmost of equal ones, of each window of ``width`` grams (a power of two)."""
    place, step = np.arange(len(grams)), 1
    while step < width and len(grams) > step:
        less = grams[step:] < grams[:-step]
        grams, place = np.where(less, grams[step:], grams[:-step]), np.where(less, place[step:], place[:-step])
        step *= 2
    return place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place


def _lags(place: np.ndarray, gram: np.ndarray, text: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, place): the lags from ``scale`` up to its double between chains of equal minimizers of one text."""
    order = np.lexsort((place, gram))
    place, gram, text = place[order], gram[order], text[order]
    gap = np.diff(place)
    alike = (gram[1:] == gram[:-1]) & (text[1:] == text[:-1])
    linked = alike & (gap <= scale // 4)
    head = np.flatnonzero(np.concatenate([[True], ~linked]))
    first, last = place[head], place[np.concatenate([head[1:], [len(place)]]) - 1]
    step = np.gcd.reduceat(np.concatenate([[0], np.where(linked, gap, 0)]), head)
    kind = np.cumsum(np.concatenate([[True], ~alike]))[head]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    here, on = np.arange(len(head)), 1
    while len(here):
        here = here[here + on < len(head)]
        here = here[(kind[here + on] == kind[here]) & (first[here + on] - last[here] < 2 * scale)]
        there = here + on
        some = last[there] - first[here] >= scale
        a, b = here[some], there[some]
        by = np.gcd(step[a], step[b])
        least, most = first[b] - last[a], last[b] - first[a]
        unit = np.maximum(by, 1)
        start = np.maximum(0, -((least - scale) // unit))  # of the progression, the first lag of this scale
        n = np.where(by > 0, (np.minimum(most, 2 * scale - 1) - least) // unit - start + 1, (least >= scale).astype(np.int64))
        start, n = np.where(by > 0, start, 0), np.maximum(n, 0)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        far = np.repeat(unit * start, n) + np.repeat(unit, n) * k
        back = np.minimum(far, np.repeat(last[a] - first[a], n))
        out.append((np.repeat(least, n) + far, np.repeat(last[a], n) - back))
        on += 1
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _long_periods(words: np.ndarray, text: np.ndarray, scale: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of stretches with periods from ``scale`` up to its double; words with separators."""
    half, n = scale // 2, len(words)
    grams = gram_hashes(words, half)
    place = _minimizers(grams, half)
    lag, at = _lags(place, grams[place], text[place], scale)
    if not len(lag):
        return
    # a stretch of ``scale`` equal words goes on for eight words past the gram, on one side at least
    left, right = np.ones(len(lag), bool), np.ones(len(lag), bool)
    for j in range(8):
        i = at - 1 - j
        left &= (i >= 0) & (words[np.maximum(i, 0)] == words[np.maximum(i, 0) + lag])
        i = np.minimum(at + half + j, n - 1)
        right &= (i + lag < n) & (words[i] == words[np.minimum(i + lag, n - 1)])
    lag, at = lag[left | right], at[left | right]
    order = np.lexsort((at, lag))
    last, seen = 0, 0
    for q, i in zip(lag[order].tolist(), at[order].tolist(), strict=True):
        if q == last and i < seen:
            continue
        end = i + _equal(words[i : n - q], words[i + q :])
        start = i - _equal(words[i - 1 :: -1] if i else words[:0], words[i + q - 1 :: -1])
        last, seen = q, end
        if end - start >= q:
            yield start, end - start + q, q


def find_runs(ids: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """All runs of texts of words ``ids`` (word_ids): (runs, 4) of text, start, length and period, by text, start and period; and where each text's begin."""
    sizes = np.diff(offsets)
    found: list[np.ndarray] = [np.empty((0, 4), np.int64)]
    texts = np.flatnonzero(sizes >= least)
    scale = 1
    while len(texts):
        own = sizes[texts]
        begin = np.cumsum(own + 1) - own - 1
        text = np.repeat(np.arange(len(texts)), own + 1)
        words = np.arange(len(text)).astype(np.uint64) | np.uint64(1 << 63)  # separators, each met once
        inside = np.ones(len(text), bool)
        inside[begin + own] = False
        words[inside] = ids[np.arange(len(text))[inside] - text[inside] + np.repeat(offsets[texts] - (np.cumsum(own) - own), own)]
        rows: list[tuple[int, int, int]] = []
        if scale < SHORT:
            for q in range(1, SHORT):
                need = max(least - q, q)
                at = np.flatnonzero(words[q:] == words[:-q])
                cut = np.flatnonzero(np.diff(at) > 1) + 1
                start, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
                long = end - start >= need
                rows += [(int(at[s]), int(e - s) + q, q) for s, e in zip(start[long], end[long], strict=True)] if len(at) else []
            scale = SHORT
        else:
            rows += _long_periods(words, text, scale)
            scale *= 2
        if rows:
            run = np.array(rows, np.int64)
            found.append(np.column_stack([texts[text[run[:, 0]]], run[:, 0] - begin[text[run[:, 0]]], run[:, 1:]]))
        texts = texts[sizes[texts] >= 2 * scale]
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :3] != runs[:-1, :3]).any(1)  # of one stretch, the smallest period
    runs = runs[new]
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
    return runs, np.searchsorted(runs[:, 0], np.arange(len(sizes) + 1))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words are in no run after its first period; runs: start, length, period."""
    turns = np.zeros(n + 1, np.int64)
    np.add.at(turns, runs[:, 0] + runs[:, 2], 1)
    np.add.at(turns, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(turns[:n]) == 0


def _join(text: bytes, which: np.ndarray) -> bytes:
    """The words of these numbers, joined by one space."""
    blank = np.ones(len(text) + 2, bool)
    blank[1:-1] = BLANK[np.frombuffer(text, np.uint8)]
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = turns[::2], turns[1::2]
    parts = []
    for k in range(0, len(which), JOINED):
        some = which[k : k + JOINED]
        parts.append(b" ".join([text[s:e] for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]))
    return b" ".join(parts)


def find(docs: DataFrame, least: int = LEAST, tail: Tail | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed: the words in no run after its first period, joined by one space.

    tail: from doc_id and the number of words, (a, p) if the words from place a on are to repeat those of a to a + p.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, texts = b.column("doc_id").to_pylist(), b.column("text")
            sizes = [len(t.as_buffer() or b"") if t.is_valid else 0 for t in texts]
            for lo, hi in slices(sizes, weight=int):
                yield piece(names[lo:hi], texts.slice(lo, hi - lo).to_pylist())

    def piece(names: list, texts: list) -> pa.RecordBatch:
        ids, offsets = word_ids(texts)
        order: dict[int, np.ndarray] = {}  # words of the texts whose tails repeat
        for k, name in enumerate(names if tail else []):
            n = int(offsets[k + 1] - offsets[k])
            if how := tail(name, n):
                order[k] = np.arange(n)
                order[k][how[0] :] = how[0] + np.arange(n - how[0]) % how[1]
        if order:
            whole = np.arange(len(ids))
            for k, own in order.items():
                whole[offsets[k] : offsets[k + 1]] = offsets[k] + own
            ids = ids[whole]
        runs, first = find_runs(ids, offsets, least)
        left = []
        for k, t in enumerate(texts):
            own = runs[first[k] : first[k + 1], 1:]
            if len(own) or k in order:
                keep = np.flatnonzero(kept_words(int(offsets[k + 1] - offsets[k]), own))
                left.append(_join(t, order[k][keep] if k in order else keep))
            else:
                left.append(b" ".join(filter(None, (b" ".join(p.split()) for p in pieces(t or b"")))))
        struct = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], fields=list(RUN))
        lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), struct)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.diff(offsets)), lists, pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(tidy(run), SCHEMA)


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Repetitions for one document in ten, by the CRC-32 of its id; a null id has none."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or n == 0:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)
