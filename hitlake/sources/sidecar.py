"""Side files of captures: calibration, pads, pin maps, scalars, events and voltage settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EFFICIENCY_FIELDS, PAD_FIELDS, SUPPLIES

_COEFFICIENTS = {"time_offsets": ("time_offset", 0.0), "time_slopes": ("time_slope", 1.0), "adc_offsets": ("adc_offset", 0.0), "adc_slopes": ("adc_slope", 1.0)}


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """vmm, ch and four coefficients for all 32 x 64 channels.

    Missing arrays and values keep 0, 1, 0, 1; values after the 64th and chips from 32 are left out; a later entry
    overrides an earlier one, array by array.
    """
    arrays = ", ".join(f"{a}: array<double>" for a in _COEFFICIENTS)
    rows = spark.read.schema(f"vmm_calibration array<struct<vmmID: int, {arrays}>>").json(path, multiLine=True)
    entries = rows.select(F.posexplode("vmm_calibration").alias("entry", "e")).select("entry", F.col("e.vmmID").alias("vmm"), *(f"e.{a}" for a in _COEFFICIENTS)).where("vmm BETWEEN 0 AND 31")
    grid = spark.range(32).select(F.col("id").cast("int").alias("vmm")).crossJoin(spark.range(64).select(F.col("id").cast("int").alias("ch")))
    for array, (name, default) in _COEFFICIENTS.items():
        values = entries.select("entry", "vmm", F.posexplode(array).alias("ch", "value")).where("ch < 64").groupBy("vmm", "ch").agg(F.max_by("value", "entry").alias("value"))
        grid = grid.join(F.broadcast(values), ["vmm", "ch"], "left").withColumn(name, F.coalesce("value", F.lit(default))).drop("value")
    return grid


def read_pads(spark: SparkSession, path: str) -> DataFrame:
    """channel_id and the pad columns; those that the file lacks are null."""
    raw = spark.read.csv(path, header=True)
    return raw.select(F.col("channel_id").cast("int"), *((F.col(c) if c in raw.columns else F.lit(None)).cast("double").alias(c) for c in PAD_FIELDS))


def read_pin_map(spark: SparkSession, path_x: str, path_y: str) -> DataFrame:
    """axis, asic_pin, detector_pin of two CSV files with the columns "Pin Number VMM3" and "Pin Number Detecteur"."""
    one = lambda p, a: spark.read.csv(p, header=True).select(F.lit(a).alias("axis"), F.col("Pin Number VMM3").cast("int").alias("asic_pin"), F.col("Pin Number Detecteur").cast("int").alias("detector_pin"))
    return one(path_x, "X").unionByName(one(path_y, "Y"))


SCALARS = "n_packets long, n_vm3_packets long, n_hits long, n_invalid_offset long, offset_constant boolean, frame_first long, frame_last long, hits_per_vmm map<string,long>, live_channels_per_vmm map<string,long>, adc_p50_per_vmm map<string,double>, adc_p90_per_vmm map<string,double>, ot_fraction double, unknown_vmm_hits map<string,long>, source string, capture string, mtime double, efficiency map<string,struct<efficiency: double, sigma_ns: double, mu_ns: double>>, n_masked_hits long, per_station map<string,struct<n_hits: long, adc_p50: double, adc_p90: double>>, corrupt string"


def read_scalars(spark: SparkSession, root: str) -> DataFrame:
    """All scalars.json under root, with the store's folder and the sub-run three folders up; unreadable files are left out."""
    reader = spark.read.schema(SCALARS).option("recursiveFileLookup", True).option("pathGlobFilter", "scalars.json").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt")
    rows = reader.json(root, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    parts = F.split("file", "/")
    return rows.where("corrupt IS NULL").withColumns({"store": F.regexp_replace("file", "/[^/]*$", ""), "sub_run": F.try_element_at(parts, F.lit(-4))}).drop("corrupt", "file")


def read_events(spark: SparkSession, path: str, run: str, run_no: int = 0) -> DataFrame:
    """run, run_no, sub_run, path, file, n_triggers and efficiency by station of sub_run/file/events.json with efficiency."""
    fields = ", ".join(f"{c}: double" for c in EFFICIENCY_FIELDS)
    rows = spark.read.schema(f"n_triggers_dedup long, efficiency map<string,struct<{fields}>>").json(f"{path.rstrip('/')}/*/*/events.json", multiLine=True)
    parts = F.split("path", "/")
    out = rows.withColumn("path", F.col("_metadata.file_path")).where(F.size("efficiency") > 0)
    return out.select(F.lit(run).alias("run"), F.lit(run_no).alias("run_no"), F.try_element_at(parts, F.lit(-3)).alias("sub_run"), "path", F.try_element_at(parts, F.lit(-2)).alias("file"), F.coalesce("n_triggers_dedup", F.lit(0)).alias("n_triggers"), "efficiency")


def read_hv(spark: SparkSession, path: str, run: str) -> DataFrame:
    """run, sub_run, station, mesh_v, drift_v of a run configuration; values that are missing or no numbers are null."""
    rows = spark.read.schema("sub_runs array<struct<sub_run_name: string, hvs: map<string,map<string,string>>>>").json(path, multiLine=True)
    subs = rows.select(F.explode("sub_runs").alias("s")).select(F.col("s.sub_run_name").alias("sub_run"), "s.hvs")
    supplies = F.broadcast(spark.createDataFrame(SUPPLIES, "station string, what string, card string, channel string"))
    value = F.expr("try_cast(try_element_at(try_element_at(hvs, card), channel) AS DOUBLE)")
    volts = subs.crossJoin(supplies).withColumn("v", value).groupBy("sub_run", "station").agg(F.max(F.when(F.col("what") == "mesh", F.col("v"))).alias("mesh_v"), F.max(F.when(F.col("what") == "drift", F.col("v"))).alias("drift_v"))
    return volts.where("mesh_v IS NOT NULL OR drift_v IS NOT NULL").withColumn("run", F.lit(run))
