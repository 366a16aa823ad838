"""Trends over captures and curves over voltage scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import numbered

def chronological(records: DataFrame) -> DataFrame:
    """records with idx: the place by interface and sequence number in the capture's name, else by mtime."""
    name = F.coalesce("capture", F.lit(""))
    parts = records.withColumns({"_iface": F.regexp_extract(name, r"^(.*?)_(\d+)(?:_[^_]*)?(?:\.pcapng)?$", 1), "_seq": F.try_to_number(F.regexp_extract(name, r"^(.*?)_(\d+)(?:_[^_]*)?(?:\.pcapng)?$", 2), F.lit("999999999999")).cast("double")})
    parts = parts.withColumn("_seq", F.coalesce("_seq", F.col("mtime").cast("double"), F.lit(0.0)))
    return numbered(parts, ["_iface", "_seq", "capture"], "idx").drop("_iface", "_seq")


def trend_series(records: DataFrame, values: dict[str, Column]) -> DataFrame:
    """idx, series, value: of each series the captures with a finite value, gaps kept in idx."""
    rows = records.select("idx", F.explode(F.array(*(F.struct(F.lit(n).alias("series"), v.cast("double").alias("value")) for n, v in values.items()))).alias("e")).select("idx", "e.series", "e.value")
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def live_of(chips: list[int], live: str = "live_channels_per_vmm") -> Column:
    """Live channels summed over some chips of a map by chip; null for none."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.try_element_at(live, F.lit(str(v))), F.lit(0)) for v in chips])
    return F.when(total != 0, total)


def supersede(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with equal key the one with the most triggers; ties keep the first in order."""
    w = Window.partitionBy(*key).orderBy(F.desc(F.coalesce("n_triggers", F.lit(0))), order)
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def scan_table(hv: DataFrame, events: DataFrame) -> DataFrame:
    """sub_run, run, file, station, voltages and efficiency: retakes superseded within a run by path, over runs by run order.

    hv: run, sub_run, station, mesh_v, drift_v. events: run, run_no, sub_run, path, file, n_triggers, efficiency (map by station).
    """
    one = supersede(events.where(F.size("efficiency") > 0), ["run", "sub_run"], "path")
    known = one.join(hv.select("run", "sub_run").distinct(), ["run", "sub_run"], "left_semi")
    final = supersede(known, ["sub_run"], "run_no")
    rows = final.select("run", "sub_run", "file", "n_triggers", F.explode("efficiency").alias("station", "e"))
    return rows.join(hv, ["run", "sub_run", "station"]).select("sub_run", "run", "file", "station", "mesh_v", "drift_v", "n_triggers", "e.*")


def scan_points(table: DataFrame, prefix: str, x: str, y: str = "efficiency") -> DataFrame:
    """station, x, y, lo, hi of the sub-runs with a prefix, by voltage; error bars are 0 at least."""
    rows = table.where(F.col("sub_run").startswith(prefix) & F.col(x).isNotNull())
    return rows.select("station", F.col(x).alias("x"), F.col(y).alias("y"), F.greatest(F.lit(0.0), F.col(y) - F.col("efficiency_lo")).alias("lo"), F.greatest(F.lit(0.0), F.col("efficiency_hi") - F.col(y)).alias("hi")).orderBy("station", "x")


def scan_summary(table: DataFrame) -> DataFrame:
    """The scan's table as text with fixed decimals."""
    four = {"efficiency": "efficiency", "eff_lo": "efficiency_lo", "eff_hi": "efficiency_hi", "raw": "raw_efficiency", "accidental": "accidental_efficiency"}
    one = {"mu_ns": "mu_ns", "sigma_ns": "sigma_ns", "contrast": "contrast"}
    texts = [F.format_string("%.4f", c).alias(n) for n, c in four.items()] + [F.format_string("%.1f", c).alias(n) for n, c in one.items()]
    return table.select("sub_run", "run", "file", "station", F.col("mesh_v").alias("mesh_V"), F.col("drift_v").alias("drift_V"), "n_triggers", *texts)
