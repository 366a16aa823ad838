"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are powers of two, at most ``longest``, largest first: as many
full pieces as fit, then the binary digits of the rest. A piece is a sequence of its own, so no sequence crosses
documents and none needs padding. Pieces of one length form a bucket; each task deals the pieces of a bucket out in
batches of equal shape (``batch_id``), of at most ``batch_tokens`` ids, and only its last batch of a bucket may be short.

ids are those of the word-BPE tokenizer, then the end id. The tokenizer never joins text over white space, nor letters
and marks, so each distinct word, run of marks and odd chunk is encoded once and kept. Texts go in slices of a few
megabytes; a longer text is cut at white space.

Null and empty texts have the end id alone; an empty table gives no rows. Rows that repeat a doc_id, or have none, are
packed one by one, each with pieces of its own (null doc_id stays null). Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import pieces, slices, tidy

LONGEST = 4096
END = 2
BATCH_TOKENS = 1 << 18
SLICE = 4 << 20
CACHED_PARTS = 1 << 19
KEPT_PARTS = 1 << 17  # between tasks
JOINED = 200  # words that the tokenizer gets in one string
ENCODED = 4096  # strings that it gets at a time
# Runs of letters and runs of marks are what the tokenizer cuts words into. No apostrophe, which may belong to either.
LETTERS = "".join(chr(i) for i in range(0x41, 0x100) if chr(i).isalpha() and chr(i) not in "ªµº")
MARKS = "".join(chr(i) for i in range(0x21, 0x7F) if not chr(i).isalnum() and chr(i) != "'")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int, batch_id long"


class _Places(dict):
    """part -> its place in order of first sight."""

    def __missing__(self, part: str) -> int:
        self[part] = place = len(self)
        return place


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of ``size`` from ``start``, one range after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Ids of whole texts. When the memory of parts is full, those met once go; between tasks only frequent ones stay."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.tokenizer, self.words):
            t.no_truncation()
            t.no_padding()
        # lower-case words of LETTERS need no normalizing and are never cut before the merges
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
        self.last = np.zeros(1 + max(self.words.get_vocab().values()), bool)
        self.last[[i for t, i in self.words.get_vocab().items() if t.endswith("</w>")]] = True
        self.places = _Places({"": 0})
        self.flat, self.start, self.size, self.met = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def forget(self, most: int) -> None:
        """Keep at most ``most`` parts, those met most often since the last time, and none that was met once."""
        keep = np.flatnonzero(self.met[1:] > 1) + 1
        if len(keep) > most:
            keep = np.sort(keep[np.argsort(-self.met[keep], kind="stable")[:most]])
        keep = np.concatenate([[0], keep])
        parts = list(self.places)
        self.places = _Places((parts[i], k) for k, i in enumerate(keep.tolist()))
        size = self.size[keep]
        self.flat = self.flat[_ranges(self.start[keep], size)]
        self.start, self.size, self.met = np.cumsum(size) - size, size, np.zeros(len(keep), np.int64)

    def _add(self, ids: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.flat, self.size = np.concatenate([self.flat, ids.astype(np.uint32)]), np.concatenate([self.size, size])
        self.met = np.concatenate([self.met, np.zeros(len(size), np.int64)])

    def _places_of(self, parts: list[str], plain: bool) -> np.ndarray:
        """Places of the parts, new ones encoded; plain: all are lower-case words of LETTERS."""
        at = np.fromiter(map(self.places.__getitem__, parts), np.int64, len(parts))
        new = list(islice(self.places, len(self.size), None))
        for k in range(0, len(new), ENCODED):
            some = new[k : k + ENCODED]
            if plain:
                got = self.words.encode_batch_fast([" ".join(some[i : i + JOINED]) for i in range(0, len(some), JOINED)], add_special_tokens=False)
                ids = np.fromiter(chain.from_iterable(e.ids for e in got), np.int64)
                self._add(ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1))
            else:
                got = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                self._add(np.fromiter(chain.from_iterable(got), np.int64), np.fromiter(map(len, got), np.int64, len(got)))
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of ids of each text (strings without null)."""
        if len(self.places) > CACHED_PARTS:
            self.forget(CACHED_PARTS // 2)
        for blank in "\n\t\r":
            texts = pc.replace_substring(texts, blank, " ")
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        chunks, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        word, tail = pc.utf8_rtrim(chunks, MARKS), pc.utf8_ltrim(chunks, LETTERS)
        simple = pc.equal(pc.add(pc.binary_length(word), pc.binary_length(tail)), pc.binary_length(chunks))
        first, second = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        is_simple = simple.to_numpy(zero_copy_only=False)
        for parts, out, rows, plain in ((pc.utf8_lower(word.filter(simple)), first, is_simple, True), (tail.filter(simple), second, is_simple, False), (chunks.filter(pc.invert(simple)), first, ~is_simple, False)):
            kinds = parts.dictionary_encode()
            out[rows] = self._places_of(kinds.dictionary.to_pylist(), plain)[kinds.indices.to_numpy(zero_copy_only=False)]
        often = np.bincount(at, minlength=len(chunks))
        for places in (first, second):
            self.met += np.bincount(places, often, minlength=len(self.met)).astype(np.int64)
        both = np.stack([first, second], 1).ravel()
        size = self.size[both]
        own = self.flat[_ranges(self.start[both], size)]  # of each distinct chunk
        size = size.reshape(-1, 2).sum(1)
        start = np.cumsum(size) - size
        ids = own[_ranges(start[at], size[at])]
        cuts = np.concatenate([[0], np.cumsum(size[at])])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ids, np.diff(cuts)


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process, so that what it has learned serves the tasks after."""
    return Encoder(path)


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two that add up to n, largest first, none over ``longest``."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def _pieces(n: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and length of the pieces of texts of n ids, as ``lengths`` has them."""
    digits = np.array([1 << k for k in range(longest.bit_length() - 2, -1, -1)], np.int64)
    which, digit = np.nonzero((n % longest)[:, None] & digits)
    full = n // longest
    owner = np.concatenate([np.repeat(np.arange(len(n)), full), which])
    length = np.concatenate([np.full(int(full.sum()), longest), digits[digit]])
    order = np.lexsort((-length, owner))
    owner, length = owner[order], length[order]
    ends = np.cumsum(length)
    return owner, ends - length - (np.cumsum(n) - n)[owner], length


def _texts(column: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray | None]]:
    """(first row, last row, strings, owner): rows in slices; a text over SLICE bytes alone, in pieces that rows own."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for lo, hi in slices(size.tolist(), SLICE, int):
        some = pc.fill_null(column.slice(lo, hi - lo), "")
        if size[lo:hi].max(initial=0) <= SLICE:
            yield lo, hi, some, None
            continue
        for k in range(lo, hi):
            parts = list(pieces(some[k - lo].as_buffer().to_pybytes(), SLICE)) if size[k] else [b""]
            yield k, k + 1, pa.array(parts, pa.binary()).cast(pa.string()), np.zeros(len(parts), np.int64)


def pack(docs: DataFrame, tokenizer_path: str, longest: int = LONGEST, end_id: int = END, batch_tokens: int = BATCH_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids: with its ids (array of int).

    sequence_id and batch_id are unique: the task's number and the place in it, which a rerun repeats.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = SCHEMA + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 36
        made, dealt = 0, np.zeros(longest.bit_length(), np.int64)  # pieces so far, in all and by bucket
        for b in batches:
            for lo, hi, texts, owner in _texts(b.column("text")):
                ids, counts = encoder(tokenizer_path).encode(texts)
                if owner is not None:
                    counts = np.bincount(owner, counts, minlength=hi - lo).astype(np.int64)
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                which, start, length = _pieces(counts + 1, longest)
                ends = np.cumsum(length)
                data = memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(data[4 * (z - n) : 4 * z]) for z, n in zip(ends.tolist(), length.tolist(), strict=True)]
                bucket = np.round(np.log2(length)).astype(np.int32)
                place = np.zeros(len(length), np.int64)  # in its bucket
                for k in np.unique(bucket).tolist():
                    mine = bucket == k
                    n = int(mine.sum())
                    place[mine] = dealt[k] + np.arange(n)
                    dealt[k] += n
                batch = place // np.maximum(1, batch_tokens // length) * longest.bit_length() + bucket
                cols = [b.column("doc_id").take(pa.array(lo + which)), start, length, np.array(crc, np.int64), (counts + 1)[which], task + made + np.arange(len(length)), np.zeros(len(length), np.int64), bucket, task + batch]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                made += len(length)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], [c.split()[0] for c in schema.split(", ")])
        encoder(tokenizer_path).forget(KEPT_PARTS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), schema)


def write_buckets(packed: DataFrame, path: str) -> None:
    """The pieces, one folder a bucket (path/bucket=k), so that a reader draws batches of one shape."""
    packed.write.mode("overwrite").partitionBy("bucket").parquet(path)


def default_tokenizer() -> str:
    """Where the installed public tokenizers keep the word-BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
