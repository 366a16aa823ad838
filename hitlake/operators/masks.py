"""Hot-channel and hot-pad masks (capture_id, vmm, ch) and their use. Each capture is judged by itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut_lineage, small
from ..schema import NOISY_CHANNELS, TRIGGER
from .geometry import neighbours


def noisy_channels(spark: SparkSession) -> DataFrame:
    """vmm, ch of the channels that are noisy in every capture."""
    return spark.createDataFrame(NOISY_CHANNELS, "vmm int, ch int").coalesce(1)


def occupancy(hits: DataFrame, *by: str) -> DataFrame:
    """by, vmm, ch, n: at most 32 x 64 rows of each of ``by``, computed at once and cut from their lineage, so that no later use reads the hits again."""
    return cut_lineage(hits.groupBy(*by, "vmm", "ch").agg(F.count("*").alias("n")))


def auto_hot_channels(hits: DataFrame, ratio: float = 8.0, min_hits: int = 200, counts: DataFrame | None = None) -> DataFrame:
    """Channels over ratio times the median of their chip's channels with hits; chips with under min_hits in a capture are left out.

    counts: occupancy(hits, "capture_id"), if it is at hand.
    """
    counts = occupancy(hits, "capture_id") if counts is None else counts
    chip = Window.partitionBy("capture_id", "vmm")
    judged = counts.withColumns({"total": F.sum("n").over(chip), "med": F.median("n").over(chip)})
    return judged.where((F.col("total") >= min_hits) & (F.col("n") > ratio * F.col("med"))).select("capture_id", "vmm", "ch")


def auto_hot_pads(hits: DataFrame, pads: DataFrame, ratio: float = 6.0, min_hits: int = 50, counts: DataFrame | None = None) -> DataFrame:
    """Pads over ratio times the median of their six nearest pads, which counts as 1 at least; stations with under 20 pads or no hits in a capture are left out."""
    counts = occupancy(hits, "capture_id") if counts is None else counts
    mapped = F.broadcast(pads.where("mapped").select("station", "vmm", "ch"))
    lit = counts.select("capture_id").distinct().crossJoin(mapped).join(counts, ["capture_id", "vmm", "ch"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    station = Window.partitionBy("capture_id", "station")
    used = lit.withColumns({"pads": F.count("*").over(station), "hits": F.sum("n").over(station)}).where("pads >= 20 AND hits > 0")
    other = lit.select("capture_id", F.col("vmm").alias("n_vmm"), F.col("ch").alias("n_ch"), F.col("n").alias("near"))
    near = other.join(F.broadcast(neighbours(pads)), ["n_vmm", "n_ch"]).groupBy("capture_id", "vmm", "ch").agg(F.median("near").alias("med"))
    hot = used.join(near, ["capture_id", "vmm", "ch"])
    return hot.where((F.col("n") >= min_hits) & (F.col("n") > ratio * F.greatest("med", F.lit(1.0)))).select("capture_id", "vmm", "ch")


def merge_masks(*masks: DataFrame) -> DataFrame:
    """Union of masks, all by capture or all of every capture."""
    columns = [c for c in ("capture_id", "vmm", "ch") if c in masks[0].columns]
    return reduce(DataFrame.unionByName, [m.select(*columns[:-2], F.col("vmm").cast("int"), F.col("ch").cast("int")) for m in masks]).distinct()


def auto_mask(hits: DataFrame, pads: DataFrame | None = None) -> DataFrame:
    """Noisy and hot channels, and hot pads if pads are given, of each capture, from one count of the hits."""
    counts = occupancy(hits, "capture_id")
    noisy = counts.select("capture_id").distinct().crossJoin(F.broadcast(noisy_channels(hits.sparkSession)))
    found = [noisy, auto_hot_channels(hits, counts=counts)]
    return merge_masks(*found, *([] if pads is None else [auto_hot_pads(hits, pads, counts=counts)]))


def effective(mask: DataFrame, trigger: tuple[int, int] = TRIGGER) -> DataFrame:
    """The mask without the trigger channel, which is never masked."""
    return mask.where(~((F.col("vmm") == trigger[0]) & (F.col("ch") == trigger[1])))


def apply_mask(hits: DataFrame, mask: DataFrame, trigger: tuple[int, int] = TRIGGER) -> tuple[DataFrame, DataFrame]:
    """Hits that are not masked, and (capture_id, n_masked_hits) of those that are. A mask without capture_id is of every capture."""
    used = small(effective(mask, trigger))
    key = [c for c in ("capture_id", "vmm", "ch") if c in mask.columns]
    dropped = hits.join(used, key, "left_semi").groupBy("capture_id").agg(F.count("*").alias("n_masked_hits"))
    return hits.join(used, key, "left_anti"), dropped


def find_trigger_channel(hits: DataFrame, min_share: float = 0.8) -> DataFrame:
    """vmm, ch, share of the channel with the largest share of its chip's hits, if at least min_share; ties to the lowest."""
    counts = occupancy(hits)
    totals = counts.groupBy("vmm").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "vmm").withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= min_share)
    best = shares.agg(F.min(F.struct((-F.col("share")).alias("less"), "vmm", "ch")).alias("b")).where("b IS NOT NULL")
    return best.select("b.vmm", "b.ch", (-F.col("b.less")).alias("share"))


def trigger_times(hits: DataFrame, trigger: tuple[int, int] = TRIGGER) -> DataFrame:
    """capture_id, abs_time_ns: distinct times of trigger hits in order."""
    return hits.where((F.col("vmm") == trigger[0]) & (F.col("ch") == trigger[1])).select("capture_id", "abs_time_ns").distinct().orderBy("capture_id", "abs_time_ns")


def unknown_vmms(hits: DataFrame, cabling: DataFrame, trigger_known: bool = True) -> DataFrame:
    """capture_id, vmm, n of hits whose chip is not cabled; the trigger chip counts as known or not."""
    out = hits.join(F.broadcast(cabling.select("vmm")), "vmm", "left_anti")
    out = out.where(F.col("vmm") != TRIGGER[0]) if trigger_known else out
    return out.groupBy("capture_id", "vmm").agg(F.count("*").alias("n"))
