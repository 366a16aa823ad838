"""From words to hits: hit fields, marker forward fill and derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import bits, sign_extend
from ..schema import CLOCK_NS, MARKER_NS, TAC_NS, TDC_RANGE
from .words import hit_fields, split_words

SLOTS = {"srs_timestamp": "srs", "trigger_time": "time", "trigger_counter": "counter"}


def markers(words: DataFrame, data_format: str = "SRS") -> DataFrame:
    """words with slot, target and value of the marker layout (null for hits and for markers that are not kept).

    SRS: every id is a chip and takes the 42-bit value. TRG: ids under 16 take values under 4096; the others set the
    trigger counter or time of the chip of id modulo 16.
    """
    if data_format not in ("SRS", "TRG"):
        raise ValueError(f"data_format must be 'SRS' or 'TRG', not {data_format!r}")
    out = words if "is_hit" in words.columns else split_words(words)
    d1, d2 = F.col("d1"), F.col("d2")
    number, low = bits(d2, 10, 31), bits(d2, 0, 1023)
    value = d1 * 1024 + low
    if data_format == "SRS":
        slot, target = F.lit("srs"), number
    else:
        flagged = bits(d1, 28, 15) == 15
        slot = F.when(number >= 16, F.when(flagged, F.lit("counter")).otherwise("time")).when(value < 4096, "srs")
        value = F.when(number < 16, value).when(flagged, bits(d1, 0, 63) * 1024 + low).otherwise(d1 * 1024)
        target = F.when(number < 16, number).otherwise(number % 16)
    return out.withColumns({"slot": F.when(~F.col("is_hit"), slot)}).withColumns({"target": F.when(F.col("slot").isNotNull(), target), "value": F.when(F.col("slot").isNotNull(), value)})


def _slot_value(slot: str) -> Column:
    return F.when(F.col("slot") == slot, F.col("value"))


def fill_markers(marked: DataFrame, segment_packets: int | None = None) -> DataFrame:
    """Hits with the last marker of their (capture_id, fec, vmm) before them in each slot, 0 if there is none.

    ``segment_packets`` cuts a giant capture into runs of so many packets: each is filled by itself and seeded with
    the last values of the runs before it, so that one (capture, fec, vmm) spreads over many tasks.
    """
    rows = marked.withColumn("owner", F.when(F.col("is_hit"), bits(F.col("d1"), 22, 31)).otherwise(F.col("target"))).where("owner IS NOT NULL")
    who = ["capture_id", "fec", "owner"]
    segment = [] if segment_packets is None else ["segment"]
    if segment:
        rows = rows.withColumn("segment", F.floor(F.col("pkt_no") / segment_packets))
    before = Window.partitionBy(*who, *segment).orderBy("pkt_no", "word_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumns({name: F.last(_slot_value(slot), ignorenulls=True).over(before) for name, slot in SLOTS.items()})
    hits = filled.where("is_hit")
    if segment:
        last = rows.groupBy(*who, "segment").agg(*(F.max_by(_slot_value(slot), F.when(F.col("slot") == slot, F.struct("pkt_no", "word_no"))).alias(f"{name}_last") for name, slot in SLOTS.items()))
        earlier = Window.partitionBy(*who).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
        seeds = last.select(*who, "segment", *(F.last(f"{name}_last", ignorenulls=True).over(earlier).alias(f"{name}_seed") for name in SLOTS))
        hits = hits.join(seeds, [*who, "segment"]).withColumns({name: F.coalesce(name, f"{name}_seed") for name in SLOTS})
    return hits.withColumns({name: F.coalesce(name, F.lit(0).cast("long")) for name in SLOTS})


def to_hits(words: DataFrame, data_format: str = "SRS", segment_packets: int | None = None) -> DataFrame:
    """capture_id, pkt_no, word_no and the raw hit columns."""
    found = hit_fields(fill_markers(markers(words, data_format), segment_packets))
    kinds = {"fec": "smallint", "vmm": "smallint", "ch": "smallint", "adc": "int", "bcid": "int", "tdc": "smallint", "trigger_counter": "int"}
    out = found.withColumns({"offset": sign_extend(F.col("raw_offset")).cast("smallint"), "time": F.col("frame")} | {c: F.col(c).cast(k) for c, k in kinds.items()})
    return out.select("capture_id", "pkt_no", "word_no", "fec", "vmm", "time", "ch", "adc", "over_threshold", "offset", "bcid", "tdc", "srs_timestamp", "trigger_time", "trigger_counter")


def calibrated(hits: DataFrame, calibration: DataFrame | None) -> DataFrame:
    """hits with the four coefficients of their channel; 0, 1, 0, 1 where there are none. At most 32 x 64 rows are broadcast."""
    names = {"time_offset": 0.0, "time_slope": 1.0, "adc_offset": 0.0, "adc_slope": 1.0}
    if calibration is None:
        return hits.withColumns({n: F.lit(v) for n, v in names.items()})
    grid = calibration.where("vmm BETWEEN 0 AND 31 AND ch BETWEEN 0 AND 63").dropDuplicates(["vmm", "ch"]).select("vmm", "ch", *names)
    return hits.join(F.broadcast(grid), ["vmm", "ch"], "left").withColumns({n: F.coalesce(n, F.lit(v)) for n, v in names.items()})


def derive(hits: DataFrame, calibration: DataFrame | None = None) -> DataFrame:
    """hits with timestamp_ns, adc_calibrated, abs_time_ns and hit_valid."""
    c = F.col
    coarse = (c("offset") * 4096 + c("bcid")) * F.lit(CLOCK_NS)
    fine = (F.lit(CLOCK_NS) - c("tdc") * F.lit(TAC_NS) / F.lit(float(TDC_RANGE)) - c("time_offset")) * c("time_slope")
    out = calibrated(hits, calibration).withColumn("timestamp_ns", coarse + fine)
    out = out.withColumns({"adc_calibrated": (c("adc_slope") * c("adc") + c("adc_offset")).cast("float"), "abs_time_ns": c("srs_timestamp") * F.lit(MARKER_NS) + c("timestamp_ns"), "hit_valid": c("offset") >= -1})
    return out.drop("time_offset", "time_slope", "adc_offset", "adc_slope")


def invalid_hits(hits: DataFrame) -> DataFrame:
    """vmm, offset, bits, n of the hits that are not valid."""
    from ..functions.bits import offset_bits

    return hits.where("NOT hit_valid").groupBy("vmm", "offset").agg(F.count("*").alias("n")).withColumn("bits", offset_bits(F.col("offset")))
