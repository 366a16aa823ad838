"""Live analysis of captures that grow: stateful marker carry, running counts, newest hits, closed captures and merged histograms.

State is by capture and goes some time after a capture's last data; captures rotate, so what is held does not grow with
their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.bits import bits, sign_extend
from ..lineage import remove
from ..operators.histograms import histogram
from ..operators.hits import SLOTS, markers
from ..operators.words import hit_fields, to_words
from ..sources.capture import IDLE_MS, read_packets

RAW_SCHEMA = "capture_id string, pkt_no long, word_no long, fec long, vmm long, time long, ch long, adc long, over_threshold boolean, offset long, bcid long, tdc long, srs_timestamp long, trigger_time long, trigger_counter long"
STATE = "srs_timestamp long, trigger_time long, trigger_counter long"


def stream_hits(packets: DataFrame, data_format: str = "SRS", src_ips: list[str] | None = None, idle_ms: int = IDLE_MS) -> DataFrame:
    """Raw hits of a stream of packets; the last markers of each (capture, fec, chip) carry over between batches.

    They are forgotten idle_ms after the last data of their key; hits that come later have no marker.
    """
    found = hit_fields(markers(to_words(packets, src_ips), data_format))
    owner = F.when(F.col("is_hit"), bits(F.col("d1"), 22, 31)).otherwise(F.col("target"))
    rows = found.withColumns({"owner": owner, "offset": sign_extend(F.col("raw_offset")), "time": F.col("frame"), "capture_id": F.col("capture_id").cast("string")}).where("owner IS NOT NULL")
    rows = rows.select("capture_id", "fec", "owner", "pkt_no", "word_no", "is_hit", "slot", "value", "vmm", "time", "ch", "adc", "over_threshold", "offset", "bcid", "tdc")
    names = [c.split()[0] for c in RAW_SCHEMA.split(", ")]

    def carry(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = dict(zip(SLOTS, state.get if state.exists else (0, 0, 0), strict=True))
        pdf = pd.concat(list(parts)).sort_values(["pkt_no", "word_no"])
        for name, slot in SLOTS.items():
            filled = pdf["value"].where(pdf["slot"] == slot).astype("Int64").ffill().fillna(last[name])
            pdf[name] = filled.astype("int64")
            last[name] = int(pdf[name].iloc[-1])
        state.update(tuple(last.values()))
        state.setTimeoutDuration(idle_ms)
        yield pdf.loc[pdf["is_hit"], names]

    return rows.groupBy("capture_id", "fec", "owner").applyInPandasWithState(carry, RAW_SCHEMA, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def live_counts(hits: DataFrame) -> DataFrame:
    """Running vmm, ch, n of a stream, for complete or update mode."""
    return hits.groupBy("vmm", "ch").agg(F.count("*").alias("n"))


def live_histograms(entries: DataFrame) -> DataFrame:
    """Running sums of streamed histogram rows (hist, vmm, bin, bin2, n)."""
    return entries.groupBy("hist", "vmm", "bin", "bin2").agg(F.sum("n").alias("n"))


def rates(previous: dict[int | None, int], counts: DataFrame, seconds: float) -> tuple[DataFrame, dict[int | None, int]]:
    """vmm, n, hits_per_s against the totals of the last refresh, and the new totals (at most 32 chips). The row of a null vmm is of all chips."""
    totals: dict[int | None, int] = {r["vmm"]: r["n"] for r in counts.groupBy("vmm").agg(F.sum("n").alias("n")).orderBy("vmm").collect()}
    totals[None] = sum(totals.values())
    rows = [(k, n, (n - previous.get(k, 0)) / max(seconds, 1e-9)) for k, n in totals.items()]
    return counts.sparkSession.createDataFrame(rows, "vmm long, n long, hits_per_s double"), totals


def keep_last(stream: DataFrame, path: str, n: int = 100_000, seconds: float | None = 2.0) -> StreamingQuery:
    """Keeps the newest n hits of a stream as a table under ``path``, one folder a refresh: path/batch=<id>.

    A refresh joins the last table with the new hits and keeps the newest by (pkt_no, word_no, capture_id); a rerun of
    a batch writes the same folder again.
    """
    order = ["pkt_no", "word_no", "capture_id"]

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark, rows = batch.sparkSession, batch
        if batch_id:
            rows = rows.unionByName(spark.read.parquet(f"{path}/batch={batch_id - 1}"))
        rows.orderBy(*(F.desc(c) for c in order)).limit(n).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        remove(spark, f"{path}/batch={batch_id - 2}")  # the last one stays for a rerun of this refresh

    return _start(stream.writeStream.foreachBatch(refresh), path, seconds)


def keep_table(running: DataFrame, path: str, seconds: float | None = 2.0) -> StreamingQuery:
    """Keeps a running aggregate (live_counts, live_histograms) as a table under ``path``, one folder a refresh."""

    def refresh(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        remove(batch.sparkSession, f"{path}/batch={batch_id - 2}")

    return _start(running.writeStream.outputMode("complete").foreachBatch(refresh), path, seconds)


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The table of the last refresh under ``path``."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")


def newest_histograms(hits: DataFrame, adc_bins: int = 20) -> DataFrame:
    """hist, vmm, bin, n of kept hits: ADC in equal bins and channels, chip by chip."""
    adc = histogram(hits, "adc", adc_bins, 0, 1024, by=("vmm",)).select(F.lit("adc").alias("hist"), "vmm", "bin", "n")
    return adc.unionByName(hits.groupBy("vmm", F.col("ch").alias("bin")).agg(F.count("*").alias("n")).withColumn("hist", F.lit("ch")))


def each_closed(closed: DataFrame, path: str, work: Callable[[DataFrame, int], None], seconds: float | None = 2.0) -> StreamingQuery:
    """Runs ``work`` on all packets of the captures that were closed since the last refresh (a stream of read_closed).

    A refresh that fails runs again with the same captures, whole: work that replaces what it wrote of a capture counts
    each once.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        paths = sorted({r["path"] for r in batch.select("path").collect()})  # of one refresh
        if paths:
            work(read_packets(batch.sparkSession, paths), batch_id)

    return _start(closed.writeStream.foreachBatch(refresh), path, seconds)


def keep_totals(parts: DataFrame, path: str, seconds: float | None = 2.0) -> StreamingQuery:
    """Keeps the sums over captures of streamed histograms (capture_id, hist, vmm, bin, bin2, n) under ``path``/totals.

    The rows of a capture in one refresh are a version of it, whole: a capture that is sent again replaces its part.
    Versions lie under ``path``/parts, one folder a refresh, and ``path``/versions tells which one counts; a refresh
    reads the last totals and the older versions of its own captures, and a rerun writes the same folders again.
    """
    key = ["hist", "vmm", "bin", "bin2"]

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = f"{path}/parts/batch={batch_id}"
        batch.select("capture_id", *key, "n").write.mode("overwrite").parquet(new)
        rows = spark.read.parquet(new)
        versions = rows.select("capture_id").distinct().withColumn("of", F.lit(batch_id))
        change = rows.select(*key, "n")
        if batch_id:
            known = spark.read.parquet(f"{path}/versions/batch={batch_id - 1}")
            old = known.join(versions.select("capture_id"), "capture_id", "left_semi")
            for (of,) in old.select("of").distinct().collect():
                gone = spark.read.parquet(f"{path}/parts/batch={of}").join(old.where(F.col("of") == of).select("capture_id"), "capture_id", "left_semi")
                change = change.unionByName(gone.select(*key, (-F.col("n")).alias("n")))
            versions = versions.unionByName(known.join(versions.select("capture_id"), "capture_id", "left_anti"))
            change = change.unionByName(spark.read.parquet(f"{path}/totals/batch={batch_id - 1}"))
        versions.write.mode("overwrite").parquet(f"{path}/versions/batch={batch_id}")
        change.groupBy(*key).agg(F.sum("n").alias("n")).where("n <> 0").write.mode("overwrite").parquet(f"{path}/totals/batch={batch_id}")
        remove(spark, f"{path}/totals/batch={batch_id - 2}", f"{path}/versions/batch={batch_id - 2}")

    return _start(parts.writeStream.foreachBatch(refresh), path, seconds)


def _start(writer, path: str, seconds: float | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", f"{path}/_checkpoint")
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()
