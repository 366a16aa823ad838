"""Strip detector images of the simple decoder's hits (vmmid, chno, adc, bcid, frame)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import numbered, small

SIZE = 124
X_VMMS, Y_VMMS = (0, 1), (2, 3)


def select_chips(hits: DataFrame, vmms: tuple[int, ...], ch: int | None = None) -> DataFrame:
    """Hits of some chips, or of one channel of them."""
    out = hits.where(F.col("vmmid").isin(*vmms))
    return out.where(F.col("chno") == ch) if ch is not None else out


def pin_index(pins: DataFrame) -> DataFrame:
    """axis, idx, pin of a pin map (axis, asic_pin, detector_pin): idx is the place in order of the ASIC pin."""
    w = Window.partitionBy("axis").orderBy("asic_pin")
    return pins.select("axis", (F.row_number().over(w) - 1).alias("idx"), F.col("detector_pin").alias("pin"))


def repin(hits: DataFrame, pins: DataFrame) -> DataFrame:
    """Hits with chno from the pin map: chips 0 and 1 by axis Y, 2 and 3 by X, odd ones 64 further; null without a match, others kept."""
    places = F.when(F.col("vmmid") < 4, F.col("chno") + F.when(F.col("vmmid") % 2 == 1, 64).otherwise(0))
    keyed = hits.withColumns({"axis": F.when(F.col("vmmid").isin(0, 1), "Y").when(F.col("vmmid").isin(2, 3), "X"), "idx": places})
    out = keyed.join(F.broadcast(pin_index(pins)), ["axis", "idx"], "left")
    return out.withColumn("chno", F.when(F.col("axis").isNotNull(), F.col("pin")).otherwise(F.col("chno"))).select(hits.columns)


def mono_events(hits: DataFrame, by: tuple[str, ...] = ("capture_id", "frame", "bcid")) -> DataFrame:
    """Hits that are alone in their (frame, bcid)."""
    return hits.withColumn("together", F.count("*").over(Window.partitionBy(*by))).where("together = 1").drop("together")


def strip_counts(hits: DataFrame, vmms: tuple[int, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """by, chno, n of some chips."""
    return select_chips(hits, vmms).groupBy(*by, "chno").agg(F.count("*").alias("n"))


def batched(hits: DataFrame, size: int = 10_000) -> DataFrame:
    """Hits with batch: runs of ``size`` hits of a capture in file order; what is left at its end goes."""
    placed = numbered(hits, ["capture_id", "pkt_no", "word_no"], "k")  # a capture spreads over many tasks
    own = small(placed.groupBy("capture_id").agg(F.min("k").alias("first"), F.count("*").alias("total")))
    rows = placed.join(own, "capture_id").withColumn("batch", F.floor((F.col("k") - F.col("first")) / size))
    return rows.where(F.col("batch") < F.floor(F.col("total") / size)).select(*hits.columns, "batch")


def xy_image(hits: DataFrame, x_vmms: tuple[int, ...] = X_VMMS, y_vmms: tuple[int, ...] = Y_VMMS, size: int = SIZE, by: tuple[str, ...] = ()) -> DataFrame:
    """by, y, x, intensity = Y[y] + X[x] on the whole size x size grid; strips beyond it and null ones are left out."""
    groups = hits.select(*by).distinct() if by else hits.sparkSession.range(1).select()
    axis = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    grid = groups.withColumn("y", axis).withColumn("x", axis)
    x = strip_counts(hits, x_vmms, by).withColumnsRenamed({"chno": "x", "n": "nx"})
    y = strip_counts(hits, y_vmms, by).withColumnsRenamed({"chno": "y", "n": "ny"})
    if not by:  # of ``size`` rows
        x, y = F.broadcast(x), F.broadcast(y)
    out = grid.join(x, [*by, "x"], "left").join(y, [*by, "y"], "left")
    return out.select(*by, "y", "x", (F.coalesce("ny", F.lit(0)) + F.coalesce("nx", F.lit(0))).cast("double").alias("intensity"))


def last_hits(hits: DataFrame, n: int = 100_000) -> DataFrame:
    """The newest n hits of each capture in file order."""
    w = Window.partitionBy("capture_id").orderBy(F.desc("pkt_no"), F.desc("word_no"))
    return hits.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")
