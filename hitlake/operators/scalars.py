"""Per-capture records: decoder counters, trend scalars, marker cadence and events summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from ..schema import BCID_PERIOD_NS, EFFICIENCY_FIELDS, MARKER_NS
from .histograms import pct_from_counts
from .words import split_words


def decode_meta(words: DataFrame, hits: DataFrame, packets: DataFrame | None = None) -> DataFrame:
    """capture_id and the decoder's counters; n_packets is of packets, else null."""
    of_words = split_words(words).groupBy("capture_id").agg(F.count("*").alias("n_words"), F.count_if(~F.col("is_hit")).alias("n_markers"))
    of_hits = hits.groupBy("capture_id").agg(F.count("*").alias("n_hits"), F.count_distinct("pkt_no").alias("n_vm3_packets"), F.count_if(F.col("offset") < -1).alias("n_invalid_offset"), (F.min("offset") == F.max("offset")).alias("offset_constant"))
    out = of_words.join(of_hits, "capture_id", "left").fillna(0, ["n_hits", "n_vm3_packets", "n_invalid_offset"])
    if packets is None:
        return out.withColumn("n_packets", F.lit(None).cast("long"))
    return out.join(packets.groupBy("capture_id").agg(F.count("*").alias("n_packets")), "capture_id", "left")


def live_channels(hits: DataFrame) -> DataFrame:
    """capture_id, vmm, live: channels with a hit."""
    return hits.groupBy("capture_id", "vmm").agg(F.count_distinct("ch").alias("live"))


def ot_fraction(hits: DataFrame) -> DataFrame:
    """capture_id, ot_fraction: share of hits over threshold."""
    return hits.groupBy("capture_id").agg(F.avg(F.col("over_threshold").cast("double")).alias("ot_fraction"))


def station_scalars(hits: DataFrame, cabling: DataFrame) -> DataFrame:
    """capture_id, station, n_hits, adc_p50, adc_p90 (linear interpolation) of all hits, masked or not."""
    return _stations(hits.groupBy("capture_id", "vmm", "adc").agg(F.count("*").alias("n")), cabling)


def _stations(adc: DataFrame, cabling: DataFrame) -> DataFrame:
    """station_scalars of the counts of adc by chip."""
    counts = adc.join(F.broadcast(cabling.select("vmm", "station")), "vmm").groupBy("capture_id", "station", "adc").agg(F.sum("n").alias("n"))
    p = F.percentile("adc", F.array(F.lit(0.5), F.lit(0.9)), F.col("n"))
    return counts.groupBy("capture_id", "station").agg(F.sum("n").alias("n_hits"), p.alias("p")).select("capture_id", "station", "n_hits", F.col("p")[0].alias("adc_p50"), F.col("p")[1].alias("adc_p90"))


def _by_chip(rows: DataFrame, value: str, name: str) -> DataFrame:
    """capture_id and a map from chip number as text."""
    entry = F.struct(F.col("vmm").cast("string"), F.col(value))
    return rows.groupBy("capture_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name))


def build_scalars(hits: DataFrame, counts: DataFrame, meta: DataFrame, cabling: DataFrame) -> DataFrame:
    """The trend record of each capture. The trigger chip is not cabled, so it is among unknown_vmm_hits."""
    counts = cut_lineage(counts)  # a small table with six uses
    per_chip = counts.where("hist = 'ot'").groupBy("capture_id", "vmm").agg(F.sum("n").alias("n"))
    live = counts.where("hist = 'ch'").groupBy("capture_id", "vmm").agg(F.count_distinct("bin").alias("live"))
    unknown = per_chip.join(F.broadcast(cabling.select("vmm")), "vmm", "left_anti")
    ot = counts.where("hist = 'ot'").groupBy("capture_id").agg((F.sum(F.when(F.col("bin") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("ot_fraction"))
    span = hits.groupBy("capture_id").agg(F.min("time").alias("frame_first"), F.max("time").alias("frame_last"))
    adc = counts.where("hist = 'adc'").select("capture_id", "vmm", F.col("bin").alias("adc"), "n")
    stations = _stations(adc, cabling).groupBy("capture_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("station", F.struct("n_hits", "adc_p50", "adc_p90"))))).alias("per_station"))
    parts = [span, ot, _by_chip(per_chip, "n", "hits_per_vmm"), _by_chip(live, "live", "live_channels_per_vmm")]
    parts += [_by_chip(pct_from_counts(counts, "adc", q), "pct", f"adc_p{round(100 * q)}_per_vmm") for q in (0.5, 0.9)]
    parts += [_by_chip(unknown, "n", "unknown_vmm_hits"), stations]
    out = meta.select("capture_id", "n_packets", "n_vm3_packets", "n_hits", "n_invalid_offset", "offset_constant")
    for part in parts:
        out = out.join(part, "capture_id", "left")
    return out


def marker_gaps(hits: DataFrame) -> DataFrame:
    """capture_id, gap, n: spacing (in ticks) of distinct marker values of chips with more than two. Counts of captures add up."""
    distinct = hits.select("capture_id", "vmm", "srs_timestamp").distinct()
    w = Window.partitionBy("capture_id", "vmm")
    gap = F.col("srs_timestamp") - F.lag("srs_timestamp").over(w.orderBy("srs_timestamp"))
    gaps = distinct.withColumns({"gap": gap, "values": F.count("*").over(w)}).where("values > 2 AND gap IS NOT NULL")
    return gaps.groupBy("capture_id", "gap").agg(F.count("*").alias("n"))


def quantiles_from_counts(counts: DataFrame, value: str, n: str, names: dict[str, float], by: tuple[str, ...]) -> DataFrame:
    """by and a quantile (linear interpolation) for each of ``names``, exact, from how often each value occurs."""
    rows = counts.groupBy(*by, value).agg(F.sum(n).alias("_n"))
    w = Window.partitionBy(*by)
    rows = rows.withColumns({"_upto": F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(w)})
    out = []
    for name, q in names.items():
        place = q * (F.col("_all") - 1)
        at = lambda k: F.min(F.when(F.col("_upto") > k, F.col(value)))
        share = F.max(place - F.floor(place))
        out.append((at(F.floor(place)) + share * (at(F.ceil(place)) - at(F.floor(place)))).alias(name))
    return rows.groupBy(*by).agg(*out)


def marker_cadence(hits: DataFrame) -> DataFrame:
    """capture_id, marker_gap_ns_p50, marker_gap_ns_p99 of marker_gaps."""
    return cadence_from_gaps(marker_gaps(hits))


def cadence_from_gaps(gaps: DataFrame, by: tuple[str, ...] = ("capture_id",)) -> DataFrame:
    """by, marker_gap_ns_p50, marker_gap_ns_p99, bcid_rollover_ns from counts of gaps, of one or of many captures."""
    ns = gaps.withColumn("ns", F.col("gap") * F.lit(MARKER_NS))
    found = quantiles_from_counts(ns, "ns", "n", {"marker_gap_ns_p50": 0.5, "marker_gap_ns_p99": 0.99}, by)
    return found.withColumn("bcid_rollover_ns", F.lit(BCID_PERIOD_NS))


def offsets_seen(hits: DataFrame) -> DataFrame:
    """capture_id, offsets: the distinct offsets in order."""
    return hits.groupBy("capture_id").agg(F.array_sort(F.collect_set("offset")).alias("offsets"))


def run_parameters(hits: DataFrame, meta: DataFrame, data_format: str = "SRS") -> DataFrame:
    """One row per capture: counters, binning constants and hits of chips 0-31, -1 where a chip is absent."""
    chips = _by_chip(hits.groupBy("capture_id", "vmm").agg(F.count("*").alias("n")), "n", "m")
    full = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda v: F.coalesce(F.try_element_at("m", v.cast("string")), F.lit(-1)).cast("int"))
    return meta.join(chips, "capture_id", "left").withColumns({"hits_per_vmm": full, "data_format": F.lit(data_format), "adc_bins": F.lit(1024), "ch_bins": F.lit(64), "bcid_bins": F.lit(4096), "tdc_bins": F.lit(256)}).drop("m")


def events_summary(hits: DataFrame, meta: DataFrame, analysis: DataFrame | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """capture_id, counters, first and last time, hits per chip and, if given, efficiency and beam profile by station."""
    base = hits.groupBy("capture_id").agg(F.count_if("hit_valid").alias("n_hits_valid"), F.min("abs_time_ns").alias("t_first_ns"), F.max("abs_time_ns").alias("t_last_ns"))
    chips = _by_chip(hits.groupBy("capture_id", "vmm").agg(F.count("*").alias("n")), "n", "hits_per_vmm")
    out = meta.select("capture_id", "n_packets", "n_vm3_packets", "n_hits").join(base, "capture_id", "left").join(chips, "capture_id", "left")
    if analysis is not None:
        out = out.join(by_station(analysis, EFFICIENCY_FIELDS, "efficiency"), "capture_id", "left").join(analysis.groupBy("capture_id").agg(F.max("n_triggers").alias("n_triggers_dedup")), "capture_id", "left")
    if profiles is not None:
        fields = [c for c in profiles.columns if c not in ("capture_id", "station")]
        out = out.join(by_station(profiles, fields, "beam_profile"), "capture_id", "left")
    return out


def by_station(rows: DataFrame, fields: list[str], name: str) -> DataFrame:
    entry: Column = F.struct("station", F.struct(*fields))
    return rows.groupBy("capture_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name))
