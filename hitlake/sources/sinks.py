"""Stores of hits, histograms and records. Spark's committer publishes a table only when all of it is written."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import remove, shared_folder
from ..operators.hits import derive
from ..schema import DERIVED, EFFICIENCY_FIELDS, KEY, RAW
from .capture import local


def write_hits(hits: DataFrame, path: str, mode: str = "overwrite", derived: bool = False) -> None:
    """Raw hit columns by capture; with ``derived`` all sixteen, for export. Constant columns cost nothing in Parquet."""
    columns = KEY + RAW + (DERIVED if derived else [])
    hits.select(*columns).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("capture_id").parquet(path)


def load_hits(spark: SparkSession, path: str, columns: list[str] | None = None, derive_cols: bool = True, calibration: DataFrame | None = None) -> DataFrame:
    """Stored hits, derived columns computed on the way, or a choice of columns; only those and their inputs are read."""
    rows = spark.read.parquet(path)
    if derive_cols and not set(DERIVED) <= set(rows.columns):
        rows = derive(rows, calibration)
    return rows.select(*KEY, *columns) if columns else rows


def write_interval_store(hits: DataFrame, table: str, buckets: int = 256) -> None:
    """Hits as a table of the catalog, bucketed by capture and marker interval: coincidence on it moves no hits.

    ``buckets`` fixes the tasks that read it: some for each core and no more than the files a folder may hold.
    """
    hits.write.mode("overwrite").format("parquet").bucketBy(buckets, "capture_id", "srs_timestamp").sortBy("capture_id", "srs_timestamp").saveAsTable(table)


def write_counts(counts: DataFrame, path: str) -> None:
    """Histograms, one folder a capture; a capture that is written again replaces its own."""
    counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("capture_id").parquet(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_records(records: DataFrame, path: str, kind: str = "json") -> None:
    """Records as JSON lines, or as CSV with a header."""
    if kind not in ("json", "csv"):
        raise ValueError(f"kind must be 'json' or 'csv', not {kind!r}")
    writer = records.write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)


def write_files(rows: DataFrame, root: str, name: str) -> int:
    """A file root/folder/name with the content ``text`` for each row (folder, text), as records of captures lie
    beside them; returns how many. Tasks write them, under another name until they are complete."""
    target = local(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for b in batches:
            for folder, text in zip(b.column("folder").to_pylist(), b.column("text").to_pylist(), strict=True):
                os.makedirs(f"{target}/{folder}", exist_ok=True)
                partial = f"{target}/{folder}/.{uuid.uuid4().hex}"
                with open(partial, "w", encoding="utf-8") as out:
                    out.write(text)
                os.replace(partial, f"{target}/{folder}/{name}")
                made += 1
        yield pa.RecordBatch.from_pydict({"made": pa.array([made], pa.int64())})

    return rows.select("folder", "text").mapInArrow(run, "made long").agg(F.coalesce(F.sum("made"), F.lit(0))).first()[0]


def reduce_captures(packets: DataFrame, path: str, data_format: str = "SRS", keep_hits: bool = True, pads: DataFrame | None = None) -> None:
    """Hits, histograms and scalars of captures under path; without keep_hits only the latter two stay.

    The record holds the efficiency of each station and n_masked_hits as well; noisy and hot channels, and with pads
    hot pads, are masked there, each capture judged by itself.
    """
    from ..operators import coincidence, masks
    from ..operators.geometry import cabling
    from ..operators.hits import to_hits
    from ..operators.histograms import build_counts
    from ..operators.scalars import build_scalars, by_station, decode_meta
    from ..operators.words import to_words

    spark, words = packets.sparkSession, to_words(packets)
    folder = f"{path}/hits" if keep_hits else shared_folder(spark, "hits")
    write_hits(to_hits(words, data_format), folder)
    hits = spark.read.parquet(folder)
    write_counts(build_counts(hits), f"{path}/counts")
    record = build_scalars(hits, read_counts(spark, f"{path}/counts"), decode_meta(words, hits, packets), cabling(spark))
    found = coincidence.analyse(derive(hits), cabling(spark), masks.auto_mask(hits, pads))
    masked = found.groupBy("capture_id").agg(F.max("n_masked_hits").alias("n_masked_hits"))
    write_records(record.join(by_station(found, EFFICIENCY_FIELDS, "efficiency"), "capture_id", "left").join(masked, "capture_id", "left"), f"{path}/scalars")
    if not keep_hits:
        remove(spark, folder)
