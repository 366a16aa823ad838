"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's most frequent letter n-grams (1 to 3, with word borders) by rank. A text gets the
language whose profile has the smallest out-of-place distance to the text's own ranks: the sum over its n-grams of
the difference of ranks, or the full profile length for an n-gram the profile lacks. N-grams are hashed to 16 bits.

Null or letterless texts give ``und`` with score 0. Ties go to the language first in order of name. Empty training
data gives ``und`` throughout. Rows with null lang or null text are not learned from. Repeated rows count as often as they
stand there and are predicted alike; texts are read whole, a megabyte at a time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import slices, tidy

SLOTS = 1 << 16
RANKS = 400
PIECE = 1 << 20  # characters of a text at a time
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Hashed n-grams of the letters; every other run of characters is one border."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[cp]
    if not letter.any():
        return np.empty(0, np.uint16)
    cp = np.where(letter, cp, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    cp = np.concatenate([[0], cp[keep], [0]]).astype(np.uint32)
    one = cp * np.uint32(2654435761)
    two = (one[:-1] ^ (cp[1:] * np.uint32(2246822519))) * np.uint32(3266489917) + np.uint32(1)
    three = (two[:-1] ^ (cp[2:] * np.uint32(668265263))) * np.uint32(374761393) + np.uint32(2)
    return np.concatenate([(one[cp > 0] >> 16), (two >> 16), (three >> 16)]).astype(np.uint16)


def gram_counts(text: str) -> np.ndarray:
    """How often each of the SLOTS codes is in grams(text), PIECE characters at a time."""
    total, last, was_letter, start = np.zeros(SLOTS, np.int64), np.zeros(1, np.uint32), False, 0
    found = False

    def add(new: np.ndarray) -> np.ndarray:
        """Count the n-grams that end in ``new``; what is to be kept for those that begin here."""
        cp = np.concatenate([last, new]).astype(np.uint32)
        one = cp * np.uint32(2654435761)
        two = (one[:-1] ^ (cp[1:] * np.uint32(2246822519))) * np.uint32(3266489917) + np.uint32(1)
        three = (two[:-1] ^ (cp[2:] * np.uint32(668265263))) * np.uint32(374761393) + np.uint32(2)
        k = len(last)
        for codes in (one[k:][new > 0], two[k - 1 :], three):  # last has two at most
            total[:] += np.bincount(codes >> 16, minlength=SLOTS)
        return cp[-2:]

    while start < len(text):
        end = start + PIECE
        if end < len(text):
            end = text.rfind(" ", start + 1, end) + 1 or end  # lower-casing looks at whole words
        cp = np.frombuffer(text[start:end].lower().encode("utf-32-le", "replace"), np.uint32)
        letter = _letters()[cp]
        found = found or bool(letter.any())
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= was_letter
        last, was_letter, start = add(np.where(letter, cp, 0)[keep]), bool(letter[-1]), end
    last = add(np.zeros(1, np.uint32))
    return total if found else np.zeros(SLOTS, np.int64)


def ranked(codes: np.ndarray, ranks: int, counts: np.ndarray | None = None) -> np.ndarray:
    """The most frequent codes, most frequent first; ties by code. counts: how often each is there, in place of codes."""
    if counts is None and len(codes) < 3000:
        found, n = np.unique(codes, return_counts=True)
    else:
        n = np.bincount(codes, minlength=SLOTS) if counts is None else counts
        found = np.flatnonzero(n)
        n = n[found]
    key = n.astype(np.int64) * SLOTS + (SLOTS - 1 - found.astype(np.int64))
    if len(key) > ranks:
        key = np.partition(key, len(key) - ranks)[-ranks:]
    return SLOTS - 1 - (np.sort(key)[::-1] % SLOTS)


def learn(docs: DataFrame, ranks: int = RANKS) -> dict[str, np.ndarray]:
    """Profiles from columns text and lang, counted over all rows; what reaches the driver is ``ranks`` codes a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for lo, hi in slices(texts):
                by: dict[str, list[str]] = {}
                for t, lang in zip(texts[lo:hi], langs[lo:hi], strict=True):
                    by.setdefault(lang, []).append(t)
                for lang, some in by.items():
                    counts = gram_counts("\n".join(some))
                    held[lang] = held[lang] + counts if lang in held else counts
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "gram": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())})

    rows = docs.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    counted = rows.mapInArrow(tidy(count), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= ranks)
    profiles: dict[str, np.ndarray] = {}
    for r in top.collect():
        profiles.setdefault(r["lang"], np.full(SLOTS, -1, np.int16))[r["gram"]] = r["rank"] - 1
    return dict(sorted(profiles.items()))


def _predict(texts: list[str | None], langs: list[str], table: np.ndarray, ranks: int) -> tuple[list[str], list[float]]:
    pred, score = [], []
    for t in texts:
        if t and langs and len(t) > PIECE:
            own = ranked(np.empty(0, np.uint16), ranks, gram_counts(t))
        else:
            own = ranked(grams(t) if t and langs else np.empty(0, np.uint16), ranks)
        if not len(own):
            pred.append(UNKNOWN)
            score.append(0.0)
            continue
        theirs = table[:, own]
        away = np.where(theirs < 0, ranks, np.abs(theirs - np.arange(len(own)))).sum(1)
        best = int(away.argmin())
        pred.append(langs[best])
        score.append(float(1 - away[best] / (ranks * len(own))))
    return pred, score


def _shared(docs: DataFrame, profiles: dict[str, np.ndarray]):
    return docs.sparkSession.sparkContext.broadcast(np.stack(list(profiles.values())) if profiles else np.empty((0, SLOTS), np.int16))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], ranks: int = RANKS, key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score of every row. score: 1 less the distance as a share of the largest possible one."""
    langs, shared = list(profiles), _shared(docs, profiles)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = _predict(b.column("text").to_pylist(), langs, shared.value, ranks)
            yield pa.RecordBatch.from_pydict({key: b.column(key), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())})

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(key, "text").mapInArrow(tidy(predict), schema)


def accepted(docs: DataFrame, profiles: dict[str, np.ndarray], least: float, ranks: int = RANKS) -> DataFrame:
    """The rows of docs, all columns, whose language is found with a score of ``least`` or more."""
    langs, shared = list(profiles), _shared(docs, profiles)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = _predict(b.column("row").field("text").to_pylist(), langs, shared.value, ranks)
            yield b.filter(pa.array([p != UNKNOWN and s >= least for p, s in zip(pred, score, strict=True)], pa.bool_()))

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.mapInArrow(tidy(choose), rows.schema).select("row.*")
