"""Additive histograms as long tables (capture_id, hist, vmm, bin, bin2, n), all families from one scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import bits
from ..functions.stats import bin_index
from ..lineage import small

TIME_BINS = 200
# Bins of each family, for dense output.
BINS = {"adc": 1024, "adc_ot0": 1024, "adc_ot1": 1024, "ch": 64, "bcid": 4096, "tdc": 256, "offset": 32, "ot": 2, "adc_vs_ch": 64, "time_profile": TIME_BINS}


def build_counts(hits: DataFrame) -> DataFrame:
    """All families of a hit table, with zero rows left out. adc_vs_ch has the channel in bin and adc / 8 in bin2."""
    span = small(hits.groupBy("capture_id").agg(F.min("time").alias("t0"), F.max("time").alias("t1")))
    rows = hits.select("capture_id", "vmm", "ch", "adc", "over_threshold", "offset", "bcid", "tdc", "time").join(span, "capture_id")
    slot = F.floor((F.col("time") - F.col("t0")) * TIME_BINS / F.greatest(F.col("t1") - F.col("t0"), F.lit(1)))
    nil = F.lit(-1)
    entry = lambda name, b, b2=nil: F.struct((F.lit(name) if isinstance(name, str) else name).alias("hist"), b.cast("int").alias("bin"), b2.cast("int").alias("bin2"))
    entries = F.array(
        entry("adc", F.col("adc")),
        entry(F.when(F.col("over_threshold"), "adc_ot1").otherwise("adc_ot0"), F.col("adc")),
        entry("ch", F.col("ch")),
        entry("bcid", F.col("bcid")),
        entry("tdc", F.col("tdc")),
        entry("offset", F.col("offset") + 16),
        entry("ot", F.col("over_threshold").cast("int")),
        entry("adc_vs_ch", F.col("ch"), bits(F.col("adc").cast("long"), 3, 127)),
        entry("time_profile", F.least(F.greatest(slot, F.lit(0)), F.lit(TIME_BINS - 1))),
    )
    # the partial aggregate after the explode holds at most the bins of a task's captures
    return rows.select("capture_id", "vmm", F.explode(entries).alias("e")).groupBy("capture_id", "e.hist", "vmm", "e.bin", "e.bin2").agg(F.count("*").alias("n"))


def time_range(hits: DataFrame) -> DataFrame:
    """capture_id, first, last of the frame counter."""
    return hits.groupBy("capture_id").agg(F.min("time").alias("first"), F.max("time").alias("last"))


def merge_counts(*counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum over captures, bin by bin without binning anew; ``by`` keeps further columns apart."""
    return reduce(DataFrame.unionByName, counts).groupBy(*by, "hist", "vmm", "bin", "bin2").agg(F.sum("n").alias("n"))


def merge_time_range(ranges: DataFrame) -> DataFrame:
    return ranges.agg(F.min("first").alias("first"), F.max("last").alias("last"))


def hits_per_vmm(hits: DataFrame) -> DataFrame:
    return hits.groupBy("capture_id", "vmm").agg(F.count("*").alias("n"))


def pct_from_counts(counts: DataFrame, hist: str, q: float, by: tuple[str, ...] = ("capture_id", "vmm")) -> DataFrame:
    """by and pct: the first bin whose running sum reaches q of the total."""
    rows = counts.where(F.col("hist") == hist).groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by)
    running, total = F.sum("n").over(w.orderBy("bin")), F.sum("n").over(w)
    return rows.withColumns({"running": running, "total": total}).where(F.col("running") >= q * F.col("total")).groupBy(*by).agg(F.min("bin").cast("double").alias("pct"))


def dense(counts: DataFrame, hist: str) -> DataFrame:
    """capture_id, vmm, bins: one array of all bins for each chip with hits, zeros included."""
    n = BINS[hist]
    one = counts.where(F.col("hist") == hist).groupBy("capture_id", "vmm", "bin").agg(F.sum("n").alias("n"))
    maps = one.groupBy("capture_id", "vmm").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    return maps.select("capture_id", "vmm", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0))).alias("bins"))


def histogram(df: DataFrame, column: str | Column, bins: int, lo: float | None = None, hi: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """by, bin, n of a column in equal bins over [lo, hi], or over each group's own range; the last bin is closed.

    Values outside and null are left out. A group of one value has the range of width 1 around it.
    """
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    rows = df.select(*by, value.alias("x")).where("x IS NOT NULL")
    if lo is None or hi is None:
        own = rows.groupBy(*by).agg(F.min("x").alias("a"), F.max("x").alias("b"))
        own = own.select(*by, F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
        rows = rows.join(small(own), list(by)) if by else rows.crossJoin(F.broadcast(own))
    else:
        rows = rows.withColumns({"a": F.lit(float(lo)), "b": F.lit(float(hi))})
    binned = rows.withColumn("bin", bin_index(F.col("x"), F.col("a"), F.col("b"), bins)).where("bin IS NOT NULL")
    return binned.groupBy(*by, "bin").agg(F.count("*").alias("n"))


def width_histogram(df: DataFrame, column: str, width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """histogram over the data's range with int((max - min) / width) bins, at least one."""
    rows = df.select(*by, F.col(column).cast("double").alias("x"))
    own = rows.groupBy(*by).agg(F.min("x").alias("a"), F.max("x").alias("b")).withColumn("bins", F.greatest(F.lit(1), F.floor((F.col("b") - F.col("a")) / width)))
    joined = rows.join(small(own), list(by)) if by else rows.crossJoin(F.broadcast(own))
    at = F.when(F.col("a") == F.col("b"), F.lit(0).cast("long")).otherwise(bin_index(F.col("x"), F.col("a"), F.col("b"), F.col("bins")))
    return joined.withColumn("bin", at).groupBy(*by, "bin", "bins").agg(F.count("*").alias("n"))


# QA histograms of fixed range (column, bins, low, high).
FIXED = {"adc": ("adc", 100, 0, 1024), "ch": ("ch", 64, 0, 64), "bcid": ("bcid", 100, 0, 4096), "tdc": ("tdc", 64, 0, 256), "offset": ("offset", 32, -16, 16)}


def qa_fixed(hits: DataFrame) -> DataFrame:
    """hist, vmm, valid, bin, n of the fixed-range families in one scan; offset is split by hit_valid (else valid is null)."""
    entries = []
    for name, (column, bins, lo, hi) in FIXED.items():
        at = bin_index(F.col(column).cast("double"), F.lit(float(lo)), F.lit(float(hi)), bins)
        entries.append(F.struct(F.lit(name).alias("hist"), at.cast("int").alias("bin"), (F.col("hit_valid") if name == "offset" else F.lit(None).cast("boolean")).alias("valid")))
    entries.append(F.struct(F.lit("ot").alias("hist"), F.col("over_threshold").cast("int").alias("bin"), F.lit(None).cast("boolean").alias("valid")))
    rows = hits.select("vmm", F.explode(F.array(*entries)).alias("e"))
    return rows.where("e.bin IS NOT NULL").groupBy("e.hist", "vmm", "e.valid", "e.bin").agg(F.count("*").alias("n"))


def qa_adc_channel(hits: DataFrame) -> DataFrame:
    """vmm, ch, bin, n: channel by 100 ADC bins over [0, 1024]."""
    at = bin_index(F.col("adc").cast("double"), F.lit(0.0), F.lit(1024.0), 100)
    return hits.select("vmm", "ch", at.alias("bin")).groupBy("vmm", "ch", "bin").agg(F.count("*").alias("n"))


RANGED = ["timestamp_ns", "abs_time_ns", "srs_timestamp", "trigger_time", "time"]


def qa_ranged(hits: DataFrame, bins: int = TIME_BINS) -> DataFrame:
    """capture_id, hist, bin, n over each capture's own range; families with one value only are left out.

    trigger_counter has one bin for each value up to ``bins``.
    """
    names = [*RANGED, "trigger_counter"]
    rows = hits.select("capture_id", F.explode(F.array(*(F.struct(F.lit(c).alias("hist"), F.col(c).cast("double").alias("x")) for c in names))).alias("e")).select("capture_id", "e.hist", "e.x")
    own = rows.groupBy("capture_id", "hist").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("b > a")
    own = own.withColumn("bins", F.when(F.col("hist") == "trigger_counter", F.least(F.lit(bins), (F.col("b") - F.col("a") + 1).cast("int"))).otherwise(F.lit(bins)))
    at = bin_index(F.col("x"), F.col("a"), F.col("b"), F.col("bins"))
    return rows.join(small(own), ["capture_id", "hist"]).withColumn("bin", at).groupBy("capture_id", "hist", "bin").agg(F.count("*").alias("n"))


def qa_calibrated(hits: DataFrame, bins: int = FIXED["adc"][1]) -> DataFrame:
    """capture_id, vmm, bin, n of the calibrated ADC, in equal bins over the capture's own range."""
    x = F.col("adc_calibrated").cast("double")
    own = hits.groupBy("capture_id").agg(F.min(x).alias("low"), F.max(x).alias("high"))
    same = F.col("low") == F.col("high")
    own = own.select("capture_id", F.when(same, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"), F.when(same, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"))
    rows = hits.join(small(own), "capture_id").select("capture_id", "vmm", bin_index(x, F.col("low"), F.col("high"), bins).alias("bin"))
    return rows.groupBy("capture_id", "vmm", "bin").agg(F.count("*").alias("n"))
