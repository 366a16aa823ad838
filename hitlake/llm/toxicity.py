"""Toxicity by logistic regression, trained by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text: its distinct words, adjacent pairs and pairs that skip one or two words, lower-cased, without
punctuation at the ends, hashed to 2^22 slots. FTRL-proximal keeps a learning rate for each coordinate, and its L1
term leaves few weights other than zero, so that the model is small enough to broadcast: at most
``shards * features kept`` (slot, weight) pairs.

Training reads at most ``max_rows`` labelled rows, those with the smallest hash of their id, and of these as many, in
that order, as have ``max_features`` distinct features together, in ``shards`` groups, each learned by one task over a
bounded sample; the weights are averaged over the groups (one group by default, which learns rare words best). Features
are taken before rows are grouped, so that long texts do not meet in one task. Null labels are left out; rows of one id with
several labels all count. Null texts are empty: they get the score of the bias. Without training rows the score is 0. Labels all
of one kind give the bias that sign; very long texts are read whole. Repeated rows score alike; ties of the hash go by
id, then label. Other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import remove, shared_folder
from .text import P1, doc_of, mixed, slices, tidy, utf8, whole, word_ids

SLOTS = 1 << 22
EDGE = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) pairs of all features, not distinct, text by text in no set order."""
    ids, offsets = word_ids(texts, lower=True, edge=EDGE)
    owner = doc_of(offsets)
    slots, owners = [mixed(ids) % SLOTS], [owner]
    for gap in (1, 2, 3):
        inside = whole(offsets, gap + 1)
        if inside.any():
            pair = mixed(ids[:-gap] * P1 + ids[gap:] + np.uint64(gap))[inside]
            slots.append(pair % SLOTS)
            owners.append(owner[: len(inside)][inside])
    return np.concatenate(owners), np.concatenate(slots).astype(np.int32)


@dataclass
class Ftrl:
    """FTRL-proximal for one binary label over binary features."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1
    z: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS + 1))
    n: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS + 1))

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == SLOTS, 0.0, self.l1)  # the bias is not shrunk
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def distinct(texts: list[bytes | None]) -> list[np.ndarray]:
    """The distinct slots of each text, in order."""
    owner, slots = features(texts)
    both = np.unique(owner.astype(np.int64) * SLOTS + slots)
    cuts = np.searchsorted(both, np.arange(1, len(texts)) * SLOTS)
    return [(x % SLOTS).astype(np.int32) for x in np.split(both, cuts)]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, shards: int = 1, epochs: int = 4, label: str = "toxic", max_features: int = 1 << 27) -> dict[int, float]:
    """Weights by slot (SLOTS: the bias) from the labelled rows of docs (doc_id, text)."""
    known = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = known.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "label").limit(max_rows)
    rows = docs.select("doc_id", utf8().alias("text")).join(F.broadcast(chosen), "doc_id")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in slices(texts):
                found = [x.astype("<i4").tobytes() for x in distinct(texts[lo:hi])]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in ("h", "doc_id", "label")), pa.array(found, pa.binary())], ["h", "doc_id", "label", "slots"])

    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession, "features")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows.select("h", "doc_id", "label", "text").mapInArrow(tidy(take), f"h long, doc_id {kind}, label int, slots binary").write.parquet(folder)
    taken = spark.read.parquet(folder)
    key = ["h", "doc_id", "label"]
    so_far = F.sum("n").over(Window.orderBy(*key))  # max_rows small rows at most
    held = taken.select(*key, (F.octet_length("slots") / 4).alias("n")).withColumn("so_far", so_far).where(F.col("so_far") <= max_features)
    sample = taken.join(F.broadcast(held.select(key).distinct()), key, "left_semi").withColumn("shard", F.pmod("h", F.lit(shards)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        model = Ftrl()
        pdf = pdf.sort_values(["h", "doc_id", "label"], kind="stable")
        rows, marks = [np.append(np.frombuffer(x, "<i4"), np.int32(SLOTS)) for x in pdf["slots"]], pdf["label"].tolist()
        for _ in range(epochs):
            for at, mark in zip(rows, marks, strict=True):
                model.learn(at, mark)
        w = model.weights(np.arange(SLOTS + 1))
        at = np.flatnonzero(w)
        return pd.DataFrame({"slot": at.astype(np.int64), "w": w[at]})

    fitted = sample.groupBy("shard").applyInPandas(fit, "slot long, w double")
    weights = {r["slot"]: r["w"] / shards for r in fitted.groupBy("slot").agg(F.sum("w").alias("w")).collect()}
    remove(spark, folder)
    return weights


def score(docs: DataFrame, weights: dict[int, float], key: str = "doc_id") -> DataFrame:
    """key and score (0 to 1) of every row's whole text."""
    at = np.array(sorted(weights), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((at, np.array([weights[k] for k in at.tolist()], np.float32)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS + 1, np.float32)
        table[shared.value[0]] = shared.value[1]
        used = table != 0
        for b in batches:
            texts, parts = b.column("text").to_pylist(), []
            for lo, hi in slices(texts):
                owner, slots = features(texts[lo:hi])
                some = used[slots]
                both = np.unique(owner[some].astype(np.int64) * SLOTS + slots[some])
                total = np.bincount(both // SLOTS, table[both % SLOTS], minlength=hi - lo) + table[SLOTS]
                parts.append(1 / (1 + np.exp(-np.clip(total, -35, 35))) if len(at) else np.zeros(hi - lo))
            yield pa.RecordBatch.from_pydict({key: b.column(key), "score": pa.array(np.concatenate([*parts, np.empty(0)]), pa.float64())})

    return docs.select(key, utf8().alias("text")).mapInArrow(tidy(apply), f"{key} {docs.schema[key].dataType.simpleString()}, score double")
