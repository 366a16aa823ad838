"""Cabling, pads and their neighbourhoods. All of it is bounded by the detector (32 chips of 64 channels), so it is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import BOTTOM_HALF, CABLING, OVERRIDES, PAD_FIELDS, STRATEGIES, STRATEGY


def cabling(spark: SparkSession, bottom_half: str = BOTTOM_HALF) -> DataFrame:
    """vmm, station, z_mm, connector, half: one row per chip."""
    other = "top" if bottom_half == "bot" else "bot"
    rows = [(v, s, z, c, h) for s, z, c, _, lo, hi in CABLING for v, h in ((lo, bottom_half), (hi, other))]
    return spark.createDataFrame(rows, "vmm int, station string, z_mm double, connector int, half string").coalesce(1)


def within_to_strip(within: Column, half: Column, strategy: Column) -> Column:
    """Strip 1-128 of a channel; an unknown strategy raises."""
    offset = F.when(strategy == "linear", within).when(strategy == "reverse", 63 - within).when(strategy == "pairswap", within.bitwiseXOR(F.lit(1))).otherwise(F.raise_error(F.concat(F.lit("unknown strategy "), strategy)).cast("int"))
    return F.when(half == "top", 65).otherwise(1) + offset


def channels(spark: SparkSession, strategy: str | Column = STRATEGY, bottom_half: str = BOTTOM_HALF, overrides: dict | None = None, chips: DataFrame | None = None) -> DataFrame:
    """One row per (vmm, ch) with station, connector, half, sector, strip and channel_id."""
    if isinstance(strategy, str) and strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    chosen = F.lit(strategy) if isinstance(strategy, str) else strategy
    for (station, connector, half), own in (OVERRIDES if overrides is None else overrides).items():
        chosen = F.when((F.col("station") == station) & (F.col("connector") == connector) & (F.col("half") == half), F.lit(own)).otherwise(chosen)
    rows = (chips if chips is not None else cabling(spark, bottom_half)).withColumn("ch", F.explode(F.sequence(F.lit(0), F.lit(63))))
    rows = rows.withColumns({"sector": F.col("connector") - 1, "strip": within_to_strip(F.col("ch"), F.col("half"), chosen)})
    return rows.withColumn("channel_id", F.col("sector") * 128 + F.col("strip") - 1)


def build_pad_table(spark: SparkSession, geometry: DataFrame, strategy: str = STRATEGY, bottom_half: str = BOTTOM_HALF, overrides: dict | None = None) -> DataFrame:
    """channels joined to the pads of the geometry; mapped tells whether a pad was found."""
    return with_geometry(channels(spark, strategy, bottom_half, overrides), geometry)


def with_geometry(rows: DataFrame, geometry: DataFrame) -> DataFrame:
    pads = geometry.select("channel_id", *(F.col(c) if c in geometry.columns else F.lit(None).cast("double").alias(c) for c in PAD_FIELDS))
    return rows.join(F.broadcast(pads), "channel_id", "left").withColumn("mapped", F.col("pad_cx").isNotNull())


def attach_pads(hits: DataFrame, pads: DataFrame) -> DataFrame:
    """hits left-joined to the pads by (vmm, ch)."""
    return hits.join(F.broadcast(pads), ["vmm", "ch"], "left")


def neighbours(pads: DataFrame, k: int = 6) -> DataFrame:
    """station, vmm, ch, n_vmm, n_ch, rank: the k nearest mapped pads of the same station; ties by chip and channel."""
    mapped = pads.where("mapped").select("station", "vmm", "ch", "pad_cx", "pad_cy")
    other = mapped.select("station", F.col("vmm").alias("n_vmm"), F.col("ch").alias("n_ch"), F.col("pad_cx").alias("n_cx"), F.col("pad_cy").alias("n_cy"))
    pairs = mapped.join(other, "station").where("NOT (vmm = n_vmm AND ch = n_ch)").withColumn("d", F.hypot(F.col("pad_cx") - F.col("n_cx"), F.col("pad_cy") - F.col("n_cy")))
    w = Window.partitionBy("station", "vmm", "ch").orderBy("d", "n_vmm", "n_ch")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("station", "vmm", "ch", "n_vmm", "n_ch", "rank")


def pad_polygons(pads: DataFrame) -> DataFrame:
    """station, vmm, ch and the four rotated corners of each mapped pad; size 5 and angle 0 (degrees) where unknown."""
    w, h = (F.coalesce(c, F.lit(5.0)) / 2 for c in ("pad_w", "pad_h"))
    a = F.radians(F.coalesce("pad_angle", F.lit(0.0)))
    corner = lambda x, y: F.struct((F.col("pad_cx") + x * F.cos(a) - y * F.sin(a)).alias("x"), (F.col("pad_cy") + x * F.sin(a) + y * F.cos(a)).alias("y"))
    return pads.where("mapped").select("station", "vmm", "ch", F.array(corner(-w, -h), corner(w, -h), corner(w, h), corner(-w, h)).alias("corners"))
