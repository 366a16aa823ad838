"""Count windows over live hits: the newest n of each capture as a ring in state, with histograms that lose what leaves.

A refresh costs what came and what left, not the window: hits lie in state in blocks of BLOCK, a refresh writes the
blocks it adds and reads those it drops, and one table of counts by chip and channel and by chip and ADC value is kept
beside them. Histograms of any binning follow from those counts (``window_histograms``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.stats import bin_index
from ..lineage import remove
from ..sources.capture import IDLE_MS, STORE
from .live import _start

BLOCK = 4096
CHIPS, CHANNELS, VALUES = 32, 64, 1024  # fixed by the widths of the fields
WINDOW = "capture_id string, seen long, hist string, vmm long, bin long, n long"


def _newest(pdf: pd.DataFrame, n: int) -> pd.DataFrame:
    return pdf.nlargest(n, ["pkt_no", "word_no"]) if len(pdf) > n else pdf


def _cut(n: int):
    """The newest n hits of each capture in a task; column ``cut`` counts those left out, on one row of each capture."""

    def flush(held: dict[str, pd.DataFrame], cut: Counter) -> Iterator[pd.DataFrame]:
        for capture, pdf in held.items():
            yield pdf.assign(cut=np.r_[cut[capture], np.zeros(len(pdf) - 1, np.int64)])
        held.clear()
        cut.clear()

    def newest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, pd.DataFrame] = {}
        cut: Counter = Counter()
        for part in parts:
            for capture, pdf in part.groupby("capture_id", sort=False):
                both = pd.concat([held[capture], pdf]) if capture in held else pdf
                held[capture] = _newest(both, n)
                cut[capture] += len(both) - len(held[capture])
            if sum(map(len, held.values())) > 8 * n:  # many captures in a task: sent on as they are
                yield from flush(held, cut)
        yield from flush(held, cut)

    return newest


class CountWindow(StatefulProcessor):
    """The newest n hits of a capture; its state goes idle_ms after the capture's last data."""

    def __init__(self, n: int, idle_ms: int):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "block long", "hits binary")
        self.at = handle.getValueState("at", "first long, next long, seen long, counts binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf, came = None, 0
        for part in rows:
            came += len(part) + int(part["cut"].sum())
            pdf = _newest(part if pdf is None else pd.concat([pdf, part]), self.n)
        hits = pdf.sort_values(["pkt_no", "word_no"])["hit"].to_numpy(np.uint32)
        first, end, seen, counts = 0, 0, 0, np.zeros(CHIPS * (CHANNELS + VALUES), np.int32)
        if self.at.exists():
            first, end, seen, known = self.at.get()
            counts += np.frombuffer(known, np.int32)
        leave = max(first, end + len(hits) - self.n)
        counts -= _counts(self._take(first, leave))
        counts += _counts(hits)
        self._put(end, hits)
        self.at.update((leave, end + len(hits), seen + came, counts.tobytes()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield _rows(key[0], seen + came, counts)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.blocks.clear()
        self.at.clear()
        yield from ()

    def _block(self, k: int) -> np.ndarray:
        return np.frombuffer(self.blocks.getValue((k,))[0], np.uint32)

    def _take(self, first: int, stop: int) -> np.ndarray:
        """Hits first to stop of the ring; blocks that have left as a whole go."""
        out = [np.zeros(0, np.uint32)]
        for k in range(first // BLOCK, -(-stop // BLOCK) if stop > first else 0):
            out.append(self._block(k)[max(first - k * BLOCK, 0) : stop - k * BLOCK])
            if (k + 1) * BLOCK <= stop:
                self.blocks.removeKey((k,))
        return np.concatenate(out)

    def _put(self, end: int, hits: np.ndarray) -> None:
        k, within = divmod(end, BLOCK)
        if within and self.blocks.containsKey((k,)):
            hits = np.concatenate([self._block(k), hits])
        for i in range(0, len(hits), BLOCK):
            self.blocks.updateValue((k + i // BLOCK,), (hits[i : i + BLOCK].tobytes(),))

    def close(self) -> None:
        pass


def _counts(hits: np.ndarray) -> np.ndarray:
    vmm, ch, adc = hits >> 16, hits >> 10 & (CHANNELS - 1), hits & (VALUES - 1)
    return np.concatenate([np.bincount(vmm * CHANNELS + ch, minlength=CHIPS * CHANNELS), np.bincount(vmm * VALUES + adc, minlength=CHIPS * VALUES)]).astype(np.int32)


def _rows(capture: str, seen: int, counts: np.ndarray) -> pd.DataFrame:
    at = np.flatnonzero(counts)
    adc = at >= CHIPS * CHANNELS
    vmm, bin_ = np.where(adc, np.divmod(at - CHIPS * CHANNELS, VALUES), np.divmod(at, CHANNELS))
    return pd.DataFrame({"capture_id": capture, "seen": seen, "hist": np.where(adc, "adc", "ch"), "vmm": vmm, "bin": bin_, "n": counts[at].astype(np.int64)})


def count_window(hits: DataFrame, n: int = 100_000, idle_ms: int = IDLE_MS) -> DataFrame:
    """WINDOW rows of a stream of hits, a capture's whole window each time it has new hits.

    hist is ``ch`` or ``adc`` with a bin for each channel or ADC value; n counts the newest n hits of the capture by
    (pkt_no, word_no), ``seen`` all its hits so far. Refreshes must bring a capture's hits in order, as stream_hits does;
    within one, order is free. A task sends on at most the newest n of a capture, so a refresh that brings a whole
    capture moves no more. Hits without capture, chip, channel or ADC value do not count. idle_ms after its last data a
    capture's window is forgotten, and hits after that start a new one.
    """
    hits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    packed = (F.shiftleft(F.col("vmm").cast("long"), 16) + F.shiftleft(F.col("ch").cast("long"), 10) + F.col("adc")).cast("long")
    rows = hits.select("capture_id", "pkt_no", "word_no", packed.alias("hit")).where("capture_id IS NOT NULL AND hit IS NOT NULL")
    cut = rows.mapInPandas(_cut(n), "capture_id string, pkt_no long, word_no long, hit long, cut long")
    return cut.groupBy("capture_id").transformWithStateInPandas(CountWindow(n, idle_ms), WINDOW, "Append", "ProcessingTime")


def keep_windows(windows: DataFrame, path: str, seconds: float | None = 2.0, keep: int = 1800) -> StreamingQuery:
    """Keeps the last window of each capture as a table under ``path``/windows, one folder a refresh.

    Captures without new hits for ``keep`` refreshes go. A rerun of a refresh writes the same folders again. State that
    expires makes refreshes without data, so with sources that know availableNow (files) a run with seconds=None goes on.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("of", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/new/batch={batch_id}")
        rows = spark.read.parquet(f"{path}/new/batch={batch_id}")
        if batch_id:
            known = spark.read.parquet(f"{path}/windows/batch={batch_id - 1}").where(F.col("of") > batch_id - keep)
            rows = rows.unionByName(known.join(rows.select("capture_id").distinct(), "capture_id", "left_anti"))
        rows.write.mode("overwrite").parquet(f"{path}/windows/batch={batch_id}")
        remove(spark, f"{path}/windows/batch={batch_id - 2}", f"{path}/new/batch={batch_id - 2}")

    return _start(windows.writeStream.foreachBatch(refresh), path, seconds)


def window_histograms(windows: DataFrame, adc_bins: int = 20, pairs: dict[str, tuple[int, ...]] | None = None, pair_bins: int = 5) -> DataFrame:
    """capture_id, seen, hist, vmm, bin, n of kept windows.

    ``ch`` by chip and channel; ``adc`` by chip in equal bins over 0 to 1024; and for each name in ``pairs`` the ADC of
    those chips together (vmm null) in equal bins from their least to their greatest value, the last bin closed; of
    equal values all, one bin wide around them.
    """
    key = ["capture_id", "seen"]
    ch = windows.where("hist = 'ch'").select(*key, "hist", "vmm", "bin", "n")
    adc = windows.where("hist = 'adc'")
    out = ch.unionByName(_summed(adc, F.col("hist"), F.col("vmm"), bin_index(F.col("bin"), 0, VALUES, adc_bins)))
    if pairs:
        named = F.lit(None).cast("string")
        for name, chips in pairs.items():
            named = F.when(F.col("vmm").isin(*chips), F.lit(name)).otherwise(named)
        own = Window.partitionBy(*key, "pair")
        each = adc.withColumn("pair", named).where("pair IS NOT NULL").withColumns({"lo": F.min("bin").over(own), "hi": F.max("bin").over(own)})
        at = F.when(F.col("lo") == F.col("hi"), F.lit(pair_bins // 2)).otherwise(F.least(F.expr(f"(bin - lo) * {pair_bins} div (hi - lo)"), F.lit(pair_bins - 1)))
        out = out.unionByName(_summed(each, F.col("pair"), F.lit(None).cast("long"), at))
    return out


def _summed(rows: DataFrame, hist: Column, vmm: Column, at: Column) -> DataFrame:
    return rows.groupBy("capture_id", "seen", hist.alias("hist"), vmm.alias("vmm"), at.cast("long").alias("bin")).agg(F.sum("n").alias("n"))
