"""Beam profiles, hit maps, map quality and wiring searches. Hits are counted by (vmm, ch) before any pad is joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import bin_index
from ..schema import CABLING, STATIONS, STRATEGIES, STRATEGY
from .geometry import cabling, channels, neighbours, with_geometry
from .masks import occupancy


CAPTURE = ("capture_id",)


def hit_map(hits: DataFrame, pads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, station, vmm, ch, pad_cx, pad_cy, n of every mapped pad, 0 without hits; by capture if ``by`` has capture_id."""
    lit = F.broadcast(pads.where("mapped").select("station", "vmm", "ch", "pad_cx", "pad_cy"))
    counts = occupancy(hits, *by)
    every = counts.select(*by).distinct().crossJoin(lit) if by else lit
    return every.join(counts, [*by, "vmm", "ch"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def hit_maps(hits: DataFrame, in_time: DataFrame, pads: DataFrame) -> DataFrame:
    """hit_map of each capture with n_all (all hits but the trigger chip's) and n_in_time."""
    every = hit_map(hits, pads, CAPTURE).withColumnRenamed("n", "n_all")
    counts = occupancy(in_time, *CAPTURE).withColumnRenamed("n", "n_in_time")
    return every.join(counts, [*CAPTURE, "vmm", "ch"], "left").withColumn("n_in_time", F.coalesce("n_in_time", F.lit(0)))


def _weighted(counts: DataFrame, by: list[str]) -> DataFrame:
    """n, means and population variances of pad_cx and pad_cy, weighted by n."""
    n, x, y = F.sum("n"), F.col("pad_cx"), F.col("pad_cy")
    means = counts.groupBy(*by).agg(n.alias("hits"), (F.sum(x * F.col("n")) / n).alias("mx"), (F.sum(y * F.col("n")) / n).alias("my"))
    rows = counts.join(means, by)
    return rows.groupBy(*by, "hits", "mx", "my").agg((F.sum(F.col("n") * (x - F.col("mx")) * (x - F.col("mx"))) / F.col("hits")).alias("vx"), (F.sum(F.col("n") * (y - F.col("my")) * (y - F.col("my"))) / F.col("hits")).alias("vy"))


def beam_spread(hits: DataFrame, pads: DataFrame) -> DataFrame:
    """station, spread (root of the summed variances; null under 100 hits), hits."""
    stats = _weighted(hit_map(hits, pads).where("n > 0"), ["station"])
    return stats.select("station", F.when(F.col("hits") >= 100, F.sqrt(F.col("vx") + F.col("vy"))).alias("spread"), "hits")


def beam_profile(in_time: DataFrame, pads: DataFrame, least: int = 20) -> DataFrame:
    """capture_id, station, n_in_time, means and population deviations of x and y; null under ``least`` hits."""
    stats = _weighted(hit_map(in_time, pads, CAPTURE).where("n > 0"), [*CAPTURE, "station"])
    some = lambda c: F.when(F.col("hits") >= least, c)
    return stats.select(*CAPTURE, "station", F.col("hits").alias("n_in_time"), some(F.col("mx")).alias("x_mean_mm"), some(F.sqrt("vx")).alias("x_rms_mm"), some(F.col("my")).alias("y_mean_mm"), some(F.sqrt("vy")).alias("y_rms_mm"))


def profile_histogram(in_time: DataFrame, pads: DataFrame, bins: int = 60, least: int = 20) -> DataFrame:
    """capture_id, station, axis, bin, n over each capture's and station's own range."""
    counts, by = hit_map(in_time, pads, CAPTURE).where("n > 0"), [*CAPTURE, "station", "axis"]
    axes = F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("pad_cx").alias("v")), F.struct(F.lit("y").alias("axis"), F.col("pad_cy").alias("v"))))
    rows = counts.select(*CAPTURE, "station", "n", axes.alias("e")).select(*CAPTURE, "station", "n", "e.axis", "e.v")
    own = rows.groupBy(*by).agg(F.min("v").alias("a"), F.max("v").alias("b"), F.sum("n").alias("hits")).where(F.col("hits") >= least)
    wide = F.col("b") > F.col("a")
    own = own.select(*by, F.when(wide, F.col("a")).otherwise(F.col("a") - 0.5).alias("a"), F.when(wide, F.col("b")).otherwise(F.col("b") + 0.5).alias("b"))
    binned = rows.join(own, by).withColumn("bin", bin_index(F.col("v"), F.col("a"), F.col("b"), bins))
    return binned.groupBy(*by, "bin").agg(F.sum("n").alias("n"))


def _roughness(lit: DataFrame, near: DataFrame, by: list[str], min_frac: float) -> DataFrame:
    """by, roughness from lit (by, vmm, ch, n) and near (by, vmm, ch, n_vmm, n_ch)."""
    other = lit.select(*by, F.col("vmm").alias("n_vmm"), F.col("ch").alias("n_ch"), F.col("n").alias("near"))
    med = near.join(other, [*by, "n_vmm", "n_ch"]).groupBy(*by, "vmm", "ch").agg(F.median("near").alias("med"))
    rows = lit.join(med, [*by, "vmm", "ch"]).withColumns({"top": F.max("med").over(Window.partitionBy(*by)), "hits": F.sum("n").over(Window.partitionBy(*by)), "pads": F.count("*").over(Window.partitionBy(*by))})
    live = rows.where((F.col("top") > 0) & (F.col("med") > min_frac * F.col("top")) & (F.col("hits") >= 500) & (F.col("pads") >= 20))
    value = F.abs(F.col("n") - F.col("med")) / (F.col("n") + F.col("med") + 1)
    judged = live.groupBy(*by).agg(F.median(value).alias("r"), F.count("*").alias("live"))
    return rows.select(*by).distinct().join(judged, by, "left").select(*by, F.when(F.col("live") >= 10, F.col("r")).alias("roughness"))


def map_roughness(hits: DataFrame, pads: DataFrame, min_frac: float = 0.05) -> DataFrame:
    """station, roughness: median over lit pads of |n - med| / (n + med + 1), med of the six nearest; null where there is too little."""
    return _roughness(hit_map(hits, pads).select("station", "vmm", "ch", "n"), neighbours(pads), ["station"], min_frac)


def scan_wiring(hits: DataFrame, geometry: DataFrame) -> DataFrame:
    """strategy, bottom_half, station, spread, mean_spread, best: every ordering and half, the default overrides kept."""
    spark = hits.sparkSession
    tables = [channels(spark, s, h).withColumns({"strategy": F.lit(s), "bottom_half": F.lit(h)}) for s in STRATEGIES for h in ("bot", "top")]
    pads = with_geometry(reduce(DataFrame.unionByName, tables), geometry).where("mapped")
    counts = pads.join(F.broadcast(occupancy(hits)), ["vmm", "ch"])
    by = ["strategy", "bottom_half", "station"]
    spread = _weighted(counts, by).select(*by, F.when(F.col("hits") >= 100, F.sqrt(F.col("vx") + F.col("vy"))).alias("spread"))
    means = spread.withColumn("mean_spread", F.avg("spread").over(Window.partitionBy("strategy", "bottom_half")))
    best = means.where("mean_spread IS NOT NULL").agg(F.min("mean_spread").alias("least"))
    return means.crossJoin(F.broadcast(best)).withColumn("best", F.coalesce(F.col("mean_spread") == F.col("least"), F.lit(False))).drop("least")


def scan_wiring_per_half(hits: DataFrame, geometry: DataFrame, base: str = STRATEGY, bottom_half: str = "bot") -> DataFrame:
    """station, connector, half, vmm, strategy, distance, picked: the ordering of each chip nearest to the station's centre.

    The centre is the median of the hits' pads under the base ordering (200 hits or more); chips have 50 or more.
    """
    spark = hits.sparkSession
    counts = occupancy(hits)
    plain = with_geometry(channels(spark, base, bottom_half, overrides={}), geometry).where("mapped")
    med = lambda c: F.percentile(c, 0.5, F.col("n"))
    centre = plain.join(F.broadcast(counts), ["vmm", "ch"]).groupBy("station").agg(F.sum("n").alias("hits"), med("pad_cx").alias("cx"), med("pad_cy").alias("cy")).where("hits >= 200")
    chips = counts.groupBy("vmm").agg(F.sum("n").alias("total")).where("total >= 50").select("vmm")
    tables = [channels(spark, s, bottom_half, overrides={}).withColumn("strategy", F.lit(s)) for s in STRATEGIES]
    tried = with_geometry(reduce(DataFrame.unionByName, tables), geometry).where("mapped").join(F.broadcast(counts), ["vmm", "ch"]).join(chips, "vmm", "left_semi").join(centre, "station")
    away = F.hypot(F.col("pad_cx") - F.col("cx"), F.col("pad_cy") - F.col("cy"))
    by = ["station", "connector", "half", "vmm", "strategy"]
    scored = tried.withColumn("away", away).groupBy(*by).agg(F.percentile("away", 0.5, F.col("n")).alias("distance"))
    order = F.array_position(F.array(*map(F.lit, STRATEGIES)), F.col("strategy"))
    w = Window.partitionBy("vmm").orderBy(F.round("distance", 9), order)
    return scored.withColumn("picked", F.row_number().over(w) == 1)


def scan_wiring_roughness(hits: DataFrame, geometry: DataFrame, passes: int = 2) -> dict[tuple[str, int, str], str]:
    """Greedy choice of the ordering of each half by map_roughness: passes over the halves, one at a time, ties to the first.

    The hits are counted once; what is left is at most 32 x 64 counts. The stations do not depend on each other, so one
    small job tries the same half of all of them.
    """
    spark: SparkSession = hits.sparkSession
    counts = spark.createDataFrame(occupancy(hits).collect(), "vmm int, ch int, n long").coalesce(1)
    pads = spark.createDataFrame(geometry.collect(), geometry.schema).coalesce(1)
    chips = cabling(spark)
    best: dict[tuple[str, int, str], str] = {}
    halves = [(connector, half) for connector in sorted({c for _, _, c, *_ in CABLING}) for half in ("bot", "top")]
    for _ in range(passes):
        for connector, half in halves:
            tables = [channels(spark, STRATEGY, overrides=best | {(station, connector, half): s for station in STATIONS}, chips=chips).withColumn("trial", F.lit(s)) for s in STRATEGIES]
            placed = with_geometry(reduce(DataFrame.unionByName, tables), pads).where("mapped")
            # one neighbourhood table for all trials: the trial is part of the station
            near = neighbours(placed.withColumn("station", F.concat_ws("/", "trial", "station"))).withColumns({"trial": F.split_part("station", F.lit("/"), F.lit(1)), "station": F.split_part("station", F.lit("/"), F.lit(2))})
            lit = placed.select("trial", "station", "vmm", "ch").join(F.broadcast(counts), ["vmm", "ch"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
            score = {(r["trial"], r["station"]): r["roughness"] for r in _roughness(lit, near, ["trial", "station"], 0.05).collect()}
            for station in STATIONS:
                best[station, connector, half] = min(STRATEGIES, key=lambda s, t=station: float("inf") if score.get((s, t)) is None else score[s, t])
    return best
