"""Registered queries: one for each operator of the inventory, with the same question in DuckDB SQL where SQL has it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as fb
from ..functions import stats as fs
from ..lineage import cut_lineage, exists, shared_folder, stored
from ..operators import coincidence, compare, geometry, histograms, masks, maps, scalars, strips, trends, triplets
from ..operators import hits as oh
from ..operators import words as ow
from ..schema import EFFICIENCY_FIELDS, HIT_COLUMNS, KEY, PAD_FIELDS, STATION_VMMS, STRATEGIES, SUPPLIES
from ..sources import capture, sidecar, sinks
from ..streaming import live, windows
from . import inputs
from .oracles import fits, greedy_wiring, oracle, pmod, spectra, wrap

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _words(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return inputs.words(spark, sf_dir, **kw)


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.packets(_words(spark, sf_dir))


def _raw(spark: SparkSession, sf_dir: str, data_format: str = "SRS", **kw) -> DataFrame:
    return oh.to_hits(_words(spark, sf_dir, data_format=data_format, **kw), data_format)


def _hits(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return oh.derive(_raw(spark, sf_dir, **kw))


def _pads(spark: SparkSession) -> DataFrame:
    return geometry.build_pad_table(spark, inputs.pad_geometry(spark))


def _mask(spark: SparkSession, hits: DataFrame) -> DataFrame:
    return masks.auto_mask(hits, _pads(spark))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-time hits without noisy and hot channels: hot pads are judged by the very wiring that scans search."""
    hits = _hits(spark, sf_dir)
    return _in_time(spark, masks.apply_mask(hits, masks.auto_mask(hits))[0])


def _unmasked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits without noisy and hot channels and hot pads."""
    hits = _hits(spark, sf_dir)
    return masks.apply_mask(hits, _mask(spark, hits))[0]


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coincidence.build_groups(_hits(spark, sf_dir), geometry.cabling(spark))


def _in_time(spark: SparkSession, hits: DataFrame) -> DataFrame:
    return coincidence.coincident_hits(hits, geometry.cabling(spark), inputs.windows(hits))


PKT = "pk AS (SELECT capture_id, pkt_no, CASE WHEN pkt_no % 7 = 0 THEN '10.0.0.7' ELSE '10.0.0.2' END AS src_ip, '10.0.0.3' AS dst_ip, any_value(frame) AS frame, any_value(fec) AS fec, count(*) AS words, pkt_no % 10 <> 9 AS magic FROM words GROUP BY capture_id, pkt_no)"
SIDE = "sim AS (SELECT f.capture_id, f.pkt_no, f.word_no, f.frame, vmm AS vmmid, raw_offset AS \"offset\", adc, g0 AS bcid, CAST(over_threshold AS INT) AS overthreshold, ch AS chno, tdc FROM fields f JOIN pk ON pk.capture_id = f.capture_id AND pk.pkt_no = f.pkt_no AND magic)"


# --- packets and words -------------------------------------------------------------------------------------------


@query(oracle("SELECT capture_id, pkt_no, src_ip, 16 + 6 * words AS bytes FROM pk WHERE magic AND src_ip IN ('10.0.0.2', '10.0.0.7')", extra=PKT))
def p1_select_packets(spark, sf_dir):
    return ow.select_packets(_packets(spark, sf_dir), ["10.0.0.2", "10.0.0.7"]).select("capture_id", "pkt_no", "src_ip", F.octet_length("payload").alias("bytes"))


@query(oracle("SELECT capture_id, src_ip, count(*) AS n FROM pk WHERE magic AND pkt_no < 500 GROUP BY ALL", extra=PKT))
def p2_detect_sources(spark, sf_dir):
    return ow.detect_sources(_packets(spark, sf_dir))


@query(oracle("SELECT p.capture_id, p.pkt_no, p.src_ip FROM pk p WHERE magic AND EXISTS (SELECT 1 FROM pk q WHERE q.capture_id = p.capture_id AND q.src_ip = p.src_ip AND q.magic AND q.pkt_no < 5)", extra=PKT))
def p2_packets_of_sources(spark, sf_dir):
    """Packets of the sources that each capture's first five packets show."""
    packets = _packets(spark, sf_dir)
    return ow.select_packets(packets, ow.detect_sources(packets, 5)).select("capture_id", "pkt_no", "src_ip")


@query(oracle("SELECT capture_id, pkt_no, frame, fec FROM pk", extra=PKT))
def p3_headers(spark, sf_dir):
    return ow.headers(_packets(spark, sf_dir)).select("capture_id", "pkt_no", "frame", "fec")


@query(oracle("SELECT w.capture_id, w.pkt_no, w.word_no, w.fec, w.frame, d1, d2 FROM words w JOIN pk ON pk.capture_id = w.capture_id AND pk.pkt_no = w.pkt_no WHERE magic AND word_no < pk.words - 1", extra=PKT))
def p4_word_explode(spark, sf_dir):
    return ow.to_words(_packets(spark, sf_dir))


@query(oracle("SELECT capture_id, is_hit, count(*) AS n FROM fields GROUP BY ALL"))
def p5_split_words(spark, sf_dir):
    return ow.split_words(_words(spark, sf_dir)).groupBy("capture_id", "is_hit").agg(F.count("*").alias("n"))


@query(oracle('SELECT capture_id, pkt_no, word_no, vmm, adc, bcid, raw_offset, ch, over_threshold, tdc FROM fields WHERE is_hit'))
def p6_hit_fields(spark, sf_dir):
    return ow.hit_fields(ow.split_words(_words(spark, sf_dir)).where("is_hit")).select("capture_id", "pkt_no", "word_no", "vmm", "adc", "bcid", "raw_offset", "ch", "over_threshold", "tdc")


@query(oracle("SELECT capture_id, pkt_no, word_no, owner AS target, v_srs AS value FROM marks WHERE NOT is_hit AND owner IS NOT NULL"))
def p7_markers_srs(spark, sf_dir):
    return oh.markers(_words(spark, sf_dir)).where("slot IS NOT NULL").select("capture_id", "pkt_no", "word_no", "target", "value")


@query(oracle("SELECT capture_id, pkt_no, word_no, owner AS target, CASE WHEN v_srs IS NOT NULL THEN 'srs' WHEN v_time IS NOT NULL THEN 'time' ELSE 'counter' END AS slot, coalesce(v_srs, v_time, v_ctr) AS value FROM marks WHERE NOT is_hit AND owner IS NOT NULL", "TRG"))
def p8_markers_trg(spark, sf_dir):
    return oh.markers(_words(spark, sf_dir, data_format="TRG"), "TRG").where("slot IS NOT NULL").select("capture_id", "pkt_no", "word_no", "target", "slot", "value")


CAL = """SELECT capture_id, pkt_no, word_no, ("offset" * 4096 + bcid) * 22.5::DOUBLE + (22.5::DOUBLE - tdc * 60::DOUBLE / 255::DOUBLE - time_offset) * time_slope AS timestamp_ns, CAST(adc_slope * adc + adc_offset AS FLOAT) AS adc_calibrated,
 srs_timestamp * 25::DOUBLE + (("offset" * 4096 + bcid) * 22.5::DOUBLE + (22.5::DOUBLE - tdc * 60::DOUBLE / 255::DOUBLE - time_offset) * time_slope) AS abs_time_ns, "offset" >= -1 AS hit_valid FROM raw JOIN cal ON cal.vmm = raw.vmm AND cal.ch = raw.ch"""


@query(oracle(CAL))
def p9_derive_calibrated(spark, sf_dir):
    return oh.derive(_raw(spark, sf_dir), inputs.calibration(spark)).select("capture_id", "pkt_no", "word_no", "timestamp_ns", "adc_calibrated", "abs_time_ns", "hit_valid")


@query(oracle("SELECT * FROM sim", extra=f"{PKT}, {SIDE}"))
def p10_simple_decoder(spark, sf_dir):
    return _simple(spark, sf_dir)


def _simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ow.simple_hits(ow.to_words(_packets(spark, sf_dir), mode="simple"))


@query(oracle('SELECT vmm, "offset", right(repeat(\'0\', 5) || bin(CASE WHEN "offset" < 0 THEN "offset" + 32 ELSE "offset" END), 5) AS bits, count(*) AS n FROM hits WHERE NOT hit_valid GROUP BY ALL'))
def p11_invalid_hits(spark, sf_dir):
    return oh.invalid_hits(_hits(spark, sf_dir))


@query(oracle("SELECT (SELECT count(*) FROM hits) - count(*) AS dropped, count(*) AS kept FROM masked"))
def p12_apply_mask(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    kept, dropped = masks.apply_mask(hits, _mask(spark, hits))
    return dropped.agg(F.coalesce(F.sum("n_masked_hits"), F.lit(0)).alias("dropped")).crossJoin(kept.agg(F.count("*").alias("kept")))


@query(oracle("SELECT count(*) FILTER (vmm = 0 AND ch = 44) AS triggers, count(*) FILTER (vmm <> 0) AS detector, count(*) FILTER (vmm BETWEEN 2 AND 7) AS p2_in FROM hits"))
def p13_predicates(spark, sf_dir):
    return _raw(spark, sf_dir).agg(F.count_if(F.expr("vmm = 0 AND ch = 44")).alias("triggers"), F.count_if(F.col("vmm") != 0).alias("detector"), F.count_if(F.col("vmm").isin(*STATION_VMMS["P2_IN"])).alias("p2_in"))


@query(oracle("SELECT capture_id, vmm, 'analysis' AS rule, count(*) AS n FROM hits WHERE vmm NOT IN (SELECT vmm FROM cabling) AND vmm <> 0 GROUP BY ALL UNION ALL SELECT capture_id, vmm, 'reduce' AS rule, count(*) AS n FROM hits WHERE vmm NOT IN (SELECT vmm FROM cabling) GROUP BY ALL", corrupt=True))
def p14_unknown_vmms(spark, sf_dir):
    hits, known = _raw(spark, sf_dir, corrupt=True), geometry.cabling(spark)
    return masks.unknown_vmms(hits, known).withColumn("rule", F.lit("analysis")).unionByName(masks.unknown_vmms(hits, known, trigger_known=False).withColumn("rule", F.lit("reduce")))


@query(oracle("SELECT chno, count(*) AS n FROM sim WHERE vmmid IN (2, 3) AND chno < 40 GROUP BY ALL UNION ALL SELECT chno, count(*) AS n FROM sim WHERE vmmid = 0 AND chno = 44 GROUP BY ALL", extra=f"{PKT}, {SIDE}"))
def p16_chip_selection(spark, sf_dir):
    hits = _simple(spark, sf_dir)
    pair = strips.select_chips(hits, (2, 3)).where("chno < 40").groupBy("chno").agg(F.count("*").alias("n"))
    return pair.unionByName(strips.select_chips(hits, (0,), 44).groupBy("chno").agg(F.count("*").alias("n")))


@query(oracle("SELECT station, vmm, ch, k, round(pad_cx + sx * 2.5::DOUBLE * cos(radians(pad_angle)) - sy * 2.5::DOUBLE * sin(radians(pad_angle)), 6) AS x, round(pad_cy + sx * 2.5::DOUBLE * sin(radians(pad_angle)) + sy * 2.5::DOUBLE * cos(radians(pad_angle)), 6) AS y, n FROM lit JOIN (SELECT vmm AS v, ch AS c, pad_angle FROM pads) p ON v = vmm AND c = ch, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) t(k, sx, sy)"))
def p17_pad_polygons(spark, sf_dir):
    pads = _pads(spark)
    corners = geometry.pad_polygons(pads).select("station", "vmm", "ch", F.posexplode("corners").alias("k", "p"))
    counts = maps.hit_map(_raw(spark, sf_dir), pads).select("vmm", "ch", "n")
    return corners.join(counts, ["vmm", "ch"]).select("station", "vmm", "ch", "k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), "n")


@query(oracle("SELECT DISTINCT capture_id, abs_time_ns FROM hits WHERE vmm = 0 AND ch = 44"))
def p18_trigger_times(spark, sf_dir):
    return masks.trigger_times(_hits(spark, sf_dir))


@query(oracle("SELECT c.capture_id, station, i.range AS i, round(exp(-0.5::DOUBLE * ((-2000::DOUBLE + i.range * (4000::DOUBLE / 599) - mu) / sigma) * ((-2000::DOUBLE + i.range * (4000::DOUBLE / 599) - mu) / sigma)) * 100::DOUBLE + 3::DOUBLE, 6) AS y FROM (SELECT DISTINCT capture_id FROM hits) c, win, range(600) i"))
def p19_fit_curve(spark, sf_dir):
    fits = inputs.windows(_raw(spark, sf_dir)).withColumns({"amplitude": F.lit(100.0), "bg": F.lit(3.0)})
    curve = coincidence.fit_curve(fits)
    return curve.select("capture_id", "station", F.round((F.col("x") + 2000) / (4000 / 599)).cast("int").alias("i"), F.round("y", 6).alias("y"))


@query(oracle("SELECT * FROM raw"))
def j1_marker_fill_srs(spark, sf_dir):
    return _raw(spark, sf_dir)


@query(oracle("SELECT * FROM raw", "TRG"))
def j1_marker_fill_trg(spark, sf_dir):
    return _raw(spark, sf_dir, data_format="TRG")


@query(oracle("SELECT * FROM raw"))
def w2_marker_fill_segments(spark, sf_dir):
    return oh.to_hits(_words(spark, sf_dir), segment_packets=7)


COUNTS = """sp AS (SELECT capture_id, min("time") AS t0, max("time") AS t1 FROM hits GROUP BY 1), counts AS (
SELECT capture_id, hist, vmm, bin, bin2, count(*) AS n FROM (
 SELECT capture_id, vmm, 'adc' AS hist, adc AS bin, -1 AS bin2 FROM hits UNION ALL SELECT capture_id, vmm, CASE WHEN over_threshold THEN 'adc_ot1' ELSE 'adc_ot0' END, adc, -1 FROM hits
 UNION ALL SELECT capture_id, vmm, 'ch', ch, -1 FROM hits UNION ALL SELECT capture_id, vmm, 'bcid', bcid, -1 FROM hits UNION ALL SELECT capture_id, vmm, 'tdc', tdc, -1 FROM hits
 UNION ALL SELECT capture_id, vmm, 'offset', "offset" + 16, -1 FROM hits UNION ALL SELECT capture_id, vmm, 'ot', CAST(over_threshold AS INT), -1 FROM hits
 UNION ALL SELECT capture_id, vmm, 'adc_vs_ch', ch, adc >> 3 FROM hits
 UNION ALL SELECT h.capture_id, vmm, 'time_profile', least(greatest((("time" - t0) * 200) // greatest(t1 - t0, 1), 0), 199), -1 FROM hits h JOIN sp ON sp.capture_id = h.capture_id) x GROUP BY ALL)"""

# --- sources and sinks -------------------------------------------------------------------------------------------


@query(oracle("SELECT 'capture-' || capture_id || '.pcapng' AS capture_id, pkt_no, src_ip, dst_ip, 16 + 6 * words AS bytes, frame FROM pk", extra=PKT))
def s1_capture_source(spark, sf_dir):
    folder = shared_folder(spark, "captures")
    capture.write_captures(_packets(spark, sf_dir), folder)
    rows = ow.headers(capture.read_packets(spark, f"{folder}/*.pcapng"))
    return rows.select("capture_id", "pkt_no", "src_ip", "dst_ip", F.octet_length("payload").alias("bytes"), "frame")


@query(oracle("SELECT 'capture-' || capture_id || '.pcapng' AS capture_id, pkt_no, src_ip, 16 + 6 * words AS bytes, frame FROM pk", extra=PKT))
def s1_split_captures(spark, sf_dir):
    """The same captures in ranges of 4 kB, each by a task."""
    folder = shared_folder(spark, "captures")
    capture.write_captures(_packets(spark, sf_dir), folder)
    rows = ow.headers(capture.read_packets(spark, f"{folder}/*.pcapng", split_bytes=4096))
    return rows.select("capture_id", "pkt_no", "src_ip", F.octet_length("payload").alias("bytes"), "frame")


@query(oracle("SELECT capture_id, pkt_no, word_no, adc, abs_time_ns, hit_valid FROM hits"))
def s9_s10_hit_store(spark, sf_dir):
    folder = shared_folder(spark, "hits")
    sinks.write_hits(_raw(spark, sf_dir), folder)
    return sinks.load_hits(spark, folder, ["adc", "abs_time_ns", "hit_valid"])


@query(oracle("SELECT * FROM counts WHERE hist = 'ch'", extra=COUNTS))
def s11_counts_store(spark, sf_dir):
    folder = shared_folder(spark, "counts")
    sinks.write_counts(histograms.build_counts(_raw(spark, sf_dir)), folder)
    return sinks.read_counts(spark, folder).where("hist = 'ch'")


@query(oracle("SELECT c.capture_id, v.range AS vmm, coalesce(n, -1) AS n FROM (SELECT DISTINCT capture_id FROM hits) c CROSS JOIN range(32) v LEFT JOIN (SELECT capture_id, vmm, count(*) AS n FROM hits GROUP BY ALL) h ON h.capture_id = c.capture_id AND h.vmm = v.range"))
def s13_run_parameters(spark, sf_dir):
    hits, meta = _meta(spark, sf_dir)
    return scalars.run_parameters(hits, meta).select("capture_id", F.posexplode("hits_per_vmm").alias("vmm", "n"))


@query(oracle("SELECT capture_id, pkt_no, word_no, " + ", ".join(f'"{c}"' for c in HIT_COLUMNS) + " FROM hits"))
def s14_per_hit_export(spark, sf_dir):
    folder = shared_folder(spark, "export")
    sinks.write_hits(_hits(spark, sf_dir), folder, derived=True)
    return spark.read.parquet(folder).select(*KEY, *HIT_COLUMNS)


# --- joins -------------------------------------------------------------------------------------------------------


@query(oracle("SELECT h.vmm, h.ch, count(*) AS n, round(min(adc_slope), 6) AS adc_slope, round(max(time_offset), 6) AS time_offset FROM hits h JOIN cal ON cal.vmm = h.vmm AND cal.ch = h.ch GROUP BY ALL"))
def j2_calibration_join(spark, sf_dir):
    rows = oh.calibrated(_raw(spark, sf_dir), inputs.calibration(spark))
    return rows.groupBy("vmm", "ch").agg(F.count("*").alias("n"), F.round(F.min("adc_slope"), 6).alias("adc_slope"), F.round(F.max("time_offset"), 6).alias("time_offset"))


@query(oracle("SELECT h.capture_id, h.pkt_no, h.word_no, h.vmm, h.ch, station, strip, channel_id, pad_cx, pad_cy, mapped FROM hits h LEFT JOIN pads p ON p.vmm = h.vmm AND p.ch = h.ch"))
def j3_attach_pads(spark, sf_dir):
    return geometry.attach_pads(_raw(spark, sf_dir), _pads(spark)).select("capture_id", "pkt_no", "word_no", "vmm", "ch", "station", "strip", "channel_id", "pad_cx", "pad_cy", "mapped")


PAD_COLUMNS = "p.vmm, p.ch, station, connector, half, sector, strip, channel_id, pad_cx, pad_cy, mapped"


@query(oracle(f"SELECT {PAD_COLUMNS}, coalesce(n, 0) AS n FROM pads p LEFT JOIN occ o ON o.vmm = p.vmm AND o.ch = p.ch"))
def j4_pad_table(spark, sf_dir):
    rows = _pads(spark).join(masks.occupancy(_raw(spark, sf_dir)), ["vmm", "ch"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select(*(c.removeprefix("p.") for c in PAD_COLUMNS.split(", ")), "n")


@query(oracle("SELECT capture_id, station, srs_timestamp, dt FROM pairs"))
def j5_interval_pairs(spark, sf_dir):
    return coincidence.group_dt(_groups(spark, sf_dir))


@query(oracle("SELECT capture_id, station, srs_timestamp, dt FROM mixed"))
def j6_mixed_pairs(spark, sf_dir):
    return coincidence.group_dt(_groups(spark, sf_dir), mixed=True)


def _trig(windows: str = "win ON win.station = g.station") -> str:
    return f"tg AS (SELECT g.capture_id, g.station, g.srs_timestamp, unnest(triggers) AS t, phases, dt_min, dt_max, sb_min, sb_max FROM groups g JOIN {windows}), cnt AS (SELECT capture_id, station, count(DISTINCT srs_timestamp) AS n_marker_intervals, count(*) AS n_triggers, count(*) FILTER (len(list_filter(phases, lambda p: {wrap('p - t')} BETWEEN dt_min AND dt_max)) > 0) AS n_signal, count(*) FILTER (len(list_filter(phases, lambda p: {wrap('p - t')} BETWEEN sb_min AND sb_max)) > 0) AS n_sideband FROM tg GROUP BY ALL)"


TRIG = _trig()


@query(oracle("SELECT * FROM cnt", extra=TRIG))
def j7_trigger_exists(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return coincidence.trigger_counts(coincidence.build_groups(hits, geometry.cabling(spark)), inputs.windows(hits))


@query(oracle("SELECT * FROM cnt", extra=TRIG))
def s10_interval_store(spark, sf_dir):
    """Trigger counts on hits that are stored by marker interval."""
    table, hits = f"hits_{uuid.uuid4().hex}", _hits(spark, sf_dir)
    sinks.write_interval_store(hits, table, 8)
    near = spark.table(table)
    found = cut_lineage(coincidence.trigger_counts(coincidence.build_groups(near, geometry.cabling(spark)), inputs.windows(near)))
    spark.sql(f"DROP TABLE {table}")
    return found


@query(oracle("SELECT capture_id, pkt_no, word_no, vmm, ch, station FROM in_time"))
def j8_coincident_hits(spark, sf_dir):
    return _in_time(spark, _hits(spark, sf_dir)).select("capture_id", "pkt_no", "word_no", "vmm", "ch", "station")


@query(oracle("SELECT capture_id, pkt_no, word_no, vmm, ch FROM masked"))
def j9_channel_mask(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return masks.apply_mask(hits, _mask(spark, hits))[0].select("capture_id", "pkt_no", "word_no", "vmm", "ch")


@query(oracle("SELECT near.vmm, near.ch, n_vmm, n_ch, rank, n FROM near JOIN lit ON lit.vmm = n_vmm AND lit.ch = n_ch"))
def j10_neighbours(spark, sf_dir):
    pads = _pads(spark)
    counts = maps.hit_map(_raw(spark, sf_dir), pads).select(F.col("vmm").alias("n_vmm"), F.col("ch").alias("n_ch"), "n")
    return geometry.neighbours(pads).join(counts, ["n_vmm", "n_ch"]).select("vmm", "ch", "n_vmm", "n_ch", "rank", "n")


@query(oracle("SELECT station, vmm, ch, pad_cx, pad_cy, n FROM lit"))
def j11_pad_occupancy(spark, sf_dir):
    return maps.hit_map(_raw(spark, sf_dir), _pads(spark))


PINS = "pins AS (SELECT axis, row_number() OVER (PARTITION BY axis ORDER BY range * 7 % 128) - 1 AS idx, (range * (CASE WHEN axis = 'X' THEN 5 ELSE 11 END) + 3) % 128 AS pin FROM range(128), (VALUES ('X'), ('Y')) a(axis)), rep AS (SELECT s.* EXCLUDE (chno), CASE WHEN vmmid < 4 THEN pin ELSE chno END AS chno FROM sim s LEFT JOIN pins ON axis = (CASE WHEN vmmid IN (0, 1) THEN 'Y' WHEN vmmid IN (2, 3) THEN 'X' END) AND idx = chno + (CASE WHEN vmmid % 2 = 1 THEN 64 ELSE 0 END))"


@query(oracle("SELECT capture_id, pkt_no, word_no, vmmid, chno FROM rep", extra=f"{PKT}, {SIDE}, {PINS}"))
def j13_repin(spark, sf_dir):
    return strips.repin(_simple(spark, sf_dir), inputs.pin_map(spark)).select("capture_id", "pkt_no", "word_no", "vmmid", "chno")


TRIPLES = "SELECT l_orderkey % 640 AS c1, l_partkey % 640 AS c2, l_suppkey % 640 AS c3 FROM lineitem"
MEMBERS = "SELECT l_orderkey % 640 AS c1, l_partkey % 640 AS c2, l_suppkey % 640 AS c3 FROM lineitem WHERE l_linenumber = 1"
PACK = "c1 + c2 * 640 + c3 * 409600"


def _triples(spark: SparkSession, sf_dir: str, members: bool = False) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = rows.where("l_linenumber = 1") if members else rows
    return rows.select((F.col("l_orderkey") % 640).alias("c1"), (F.col("l_partkey") % 640).alias("c2"), (F.col("l_suppkey") % 640).alias("c3"))


@query(f"WITH t AS (SELECT *, {PACK} AS key FROM ({TRIPLES})), m AS (SELECT DISTINCT {PACK} AS key FROM ({MEMBERS})) SELECT physical, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys FROM (SELECT t.key, m.key IS NOT NULL AS physical FROM t LEFT JOIN m ON m.key = t.key) GROUP BY physical")
def j14_triplet_membership(spark, sf_dir):
    rows = triplets.is_physical(_triples(spark, sf_dir), _triples(spark, sf_dir, members=True))
    return rows.groupBy("physical").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query(oracle("SELECT * FROM (SELECT 'adc' AS \"column\", count(*) AS n_rows, count(*) FILTER (vmm = 3) AS n_diff, 2::DOUBLE AS max_delta FROM raw UNION ALL SELECT 'tdc', count(*), 0, 0::DOUBLE FROM raw) x"))
def j15_compare_hits(spark, sf_dir):
    a = _raw(spark, sf_dir)
    return compare.compare_hits(a, a.withColumn("adc", F.when(F.col("vmm") == 3, F.col("adc") + 2).otherwise(F.col("adc"))), ["adc", "tdc"])


# --- aggregations ------------------------------------------------------------------------------------------------



def _counts_query(name: str, where: str):
    def run(spark, sf_dir):
        return histograms.build_counts(_raw(spark, sf_dir)).where(where)

    run.__name__ = name
    query(oracle(f"SELECT * FROM counts WHERE {where}", extra=COUNTS))(run)


_counts_query("a1_histograms", "hist IN ('adc', 'ch', 'bcid', 'tdc', 'offset', 'ot')")
_counts_query("a3_adc_by_threshold", "hist IN ('adc_ot0', 'adc_ot1')")
_counts_query("a4_adc_vs_channel", "hist = 'adc_vs_ch'")
_counts_query("a5_time_profile", "hist = 'time_profile'")


@query(oracle("SELECT k.capture_id, k.vmm, b.range AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT capture_id, vmm FROM hits) k CROSS JOIN range(32) b LEFT JOIN (SELECT capture_id, vmm, bin, n FROM counts WHERE hist = 'offset') c ON c.capture_id = k.capture_id AND c.vmm = k.vmm AND c.bin = b.range", extra=COUNTS))
def a1_dense_offsets(spark, sf_dir):
    """One family with its empty bins."""
    dense = histograms.dense(histograms.build_counts(_raw(spark, sf_dir)), "offset")
    return dense.select("capture_id", "vmm", F.posexplode("bins").alias("bin", "n"))


@query(oracle("SELECT capture_id, vmm, count(*) AS n FROM hits GROUP BY ALL"))
def a2_hits_per_vmm(spark, sf_dir):
    return histograms.hits_per_vmm(_raw(spark, sf_dir))


@query(oracle("SELECT hist, vmm, bin, bin2, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL", extra=COUNTS))
def a6_merge_counts(spark, sf_dir):
    return histograms.merge_counts(histograms.build_counts(_raw(spark, sf_dir)))


@query(oracle('SELECT min("time") AS first, max("time") AS last FROM hits'))
def a6_merge_time_range(spark, sf_dir):
    return histograms.merge_time_range(histograms.time_range(_raw(spark, sf_dir)))


@query(oracle("SELECT capture_id, vmm, CAST(quantile_disc(adc, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(adc, 0.9) AS DOUBLE) AS p90 FROM hits GROUP BY ALL"))
def a7_percentiles_from_counts(spark, sf_dir):
    counts = histograms.build_counts(_raw(spark, sf_dir))
    p = [histograms.pct_from_counts(counts, "adc", q).withColumnRenamed("pct", f"p{round(100 * q)}") for q in (0.5, 0.9)]
    return p[0].join(p[1], ["capture_id", "vmm"])


@query(oracle("SELECT capture_id, vmm, count(DISTINCT ch) AS live FROM hits GROUP BY ALL"))
def a8_live_channels(spark, sf_dir):
    return scalars.live_channels(_raw(spark, sf_dir))


@query(oracle("SELECT capture_id, round(avg(CAST(over_threshold AS INT)), 9) AS ot_fraction FROM hits GROUP BY ALL"))
def a9_ot_fraction(spark, sf_dir):
    return scalars.ot_fraction(_raw(spark, sf_dir)).select("capture_id", F.round("ot_fraction", 9).alias("ot_fraction"))


def _meta(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    words = _words(spark, sf_dir)
    hits = oh.derive(stored(oh.to_hits(words), "hits"))  # decoded once, read by each part of the record
    return hits, scalars.decode_meta(words, hits, inputs.packets(words))


@query(oracle("""SELECT h.capture_id, count(*) AS n_hits, count(DISTINCT pkt_no) AS n_vm3_packets, any_value(np) AS n_packets, count(*) FILTER ("offset" < -1) AS n_invalid_offset, min("time") AS frame_first, max("time") AS frame_last, round(avg(CAST(over_threshold AS INT)), 9) AS ot_fraction,
 count(*) FILTER (h.vmm = 5) AS hits_vmm5, count(DISTINCT CASE WHEN h.vmm = 5 THEN ch END) AS live_vmm5, CAST(quantile_disc(CASE WHEN h.vmm = 5 THEN adc END, 0.9) AS DOUBLE) AS adc_p90_vmm5, count(*) FILTER (h.vmm = 0) AS unknown_vmm0, round(quantile_cont(CASE WHEN station = 'P2_MID' THEN adc END, 0.5), 6) AS mid_adc_p50
 FROM hits h LEFT JOIN cabling c ON c.vmm = h.vmm JOIN (SELECT capture_id, count(DISTINCT pkt_no) AS np FROM words GROUP BY 1) w ON w.capture_id = h.capture_id GROUP BY h.capture_id"""))
def a10_scalars_record(spark, sf_dir):
    hits, meta = _meta(spark, sf_dir)
    r = scalars.build_scalars(hits, histograms.build_counts(hits), meta, geometry.cabling(spark))
    of = lambda m, v: F.try_element_at(m, F.lit(v))
    return r.select("capture_id", "n_hits", "n_vm3_packets", "n_packets", "n_invalid_offset", "frame_first", "frame_last", F.round("ot_fraction", 9).alias("ot_fraction"), of("hits_per_vmm", "5").alias("hits_vmm5"), of("live_channels_per_vmm", "5").alias("live_vmm5"), of("adc_p90_per_vmm", "5").alias("adc_p90_vmm5"), of("unknown_vmm_hits", "0").alias("unknown_vmm0"), F.round(of("per_station", "P2_MID")["adc_p50"], 6).alias("mid_adc_p50"))


@query(oracle("SELECT capture_id, station, count(*) AS n_hits, round(quantile_cont(adc, 0.5), 6) AS adc_p50, round(quantile_cont(adc, 0.9), 6) AS adc_p90 FROM hits h JOIN cabling c ON c.vmm = h.vmm GROUP BY 1, 2"))
def a11_station_scalars(spark, sf_dir):
    r = scalars.station_scalars(_raw(spark, sf_dir), geometry.cabling(spark))
    return r.select("capture_id", "station", "n_hits", F.round("adc_p50", 6).alias("adc_p50"), F.round("adc_p90", 6).alias("adc_p90"))


@query(oracle("""SELECT w.capture_id, any_value(n_packets) AS n_packets, any_value(n_words) AS n_words, any_value(n_markers) AS n_markers, count(*) AS n_hits, count(DISTINCT pkt_no) AS n_vm3_packets, count(*) FILTER ("offset" < -1) AS n_invalid_offset, min("offset") = max("offset") AS offset_constant
 FROM hits h JOIN (SELECT capture_id, count(DISTINCT pkt_no) AS n_packets, count(*) AS n_words, count(*) FILTER (NOT is_hit) AS n_markers FROM fields GROUP BY 1) w ON w.capture_id = h.capture_id GROUP BY 1"""))
def a12_decode_counters(spark, sf_dir):
    return _meta(spark, sf_dir)[1]


@query(oracle("SELECT vmm, count(*) AS n FROM hits WHERE vmm NOT IN (SELECT vmm FROM cabling) AND vmm <> 0 GROUP BY ALL", corrupt=True))
def a13_corrupt_counts(spark, sf_dir):
    rows = masks.unknown_vmms(_raw(spark, sf_dir, corrupt=True), geometry.cabling(spark))
    return rows.groupBy("vmm").agg(F.sum("n").alias("n"))


@query(oracle("SELECT * FROM hot_channels"))
def a14_hot_channels(spark, sf_dir):
    return masks.auto_hot_channels(_raw(spark, sf_dir))


@query(oracle("SELECT capture_id, vmm, ch FROM (SELECT *, sum(n) OVER (PARTITION BY capture_id, vmm) AS total, median(n) OVER (PARTITION BY capture_id, vmm) AS m FROM occ_c) x WHERE total >= 50 AND n > 1.5 * m"))
def a14_warm_channels(spark, sf_dir):
    """With lower limits, so that more channels pass."""
    return masks.auto_hot_channels(_raw(spark, sf_dir), ratio=1.5, min_hits=50)


@query(oracle("SELECT vmm, ch, round(share, 9) AS share FROM (SELECT *, n / sum(n) OVER (PARTITION BY vmm) AS share FROM occ) x WHERE share >= 0.8 ORDER BY share DESC, vmm, ch LIMIT 1"))
def a15_trigger_channel(spark, sf_dir):
    return masks.find_trigger_channel(_raw(spark, sf_dir)).select("vmm", "ch", F.round("share", 9).alias("share"))


@query(oracle("SELECT capture_id, round(quantile_cont(gap, 0.5), 6) AS p50, round(quantile_cont(gap, 0.99), 6) AS p99 FROM (SELECT capture_id, vmm, (srs_timestamp - lag(srs_timestamp) OVER (PARTITION BY capture_id, vmm ORDER BY srs_timestamp)) * 25::DOUBLE AS gap, count(*) OVER (PARTITION BY capture_id, vmm) AS k FROM (SELECT DISTINCT capture_id, vmm, srs_timestamp FROM hits) d) x WHERE k > 2 AND gap IS NOT NULL GROUP BY ALL"))
def a16_marker_cadence(spark, sf_dir):
    r = scalars.marker_cadence(_raw(spark, sf_dir))
    return r.select("capture_id", F.round("marker_gap_ns_p50", 6).alias("p50"), F.round("marker_gap_ns_p99", 6).alias("p99"))


@query(oracle("SELECT capture_id % 2 AS odd, round(quantile_cont(gap, 0.5), 6) AS p50, round(quantile_cont(gap, 0.99), 6) AS p99 FROM (SELECT capture_id, vmm, (srs_timestamp - lag(srs_timestamp) OVER (PARTITION BY capture_id, vmm ORDER BY srs_timestamp)) * 25::DOUBLE AS gap, count(*) OVER (PARTITION BY capture_id, vmm) AS k FROM (SELECT DISTINCT capture_id, vmm, srs_timestamp FROM hits) d) x WHERE k > 2 AND gap IS NOT NULL GROUP BY ALL"))
def a16_merged_cadence(spark, sf_dir):
    """The cadence of many captures together, from the counts of each."""
    gaps = scalars.marker_gaps(_raw(spark, sf_dir)).withColumn("odd", F.col("capture_id") % 2)
    r = scalars.cadence_from_gaps(gaps, by=("odd",))
    return r.select("odd", F.round("marker_gap_ns_p50", 6).alias("p50"), F.round("marker_gap_ns_p99", 6).alias("p99"))


@query(oracle("SELECT * FROM dth", extra=spectra()))
def a17_dt_histogram(spark, sf_dir):
    return coincidence.dt_histogram(coincidence.group_dt(_groups(spark, sf_dir)), 1000.0)


@query(oracle("SELECT capture_id, station, bin, raw, round(mixed, 6) AS mixed, round(raw - mixed, 6) AS hist FROM spec", extra=spectra()))
def a18_mixed_subtraction(spark, sf_dir):
    groups = _groups(spark, sf_dir)
    r = coincidence.dt_spectra(coincidence.group_dt(groups), coincidence.group_dt(groups, mixed=True), 1000.0)
    return r.select("capture_id", "station", "bin", "raw", F.round("mixed", 6).alias("mixed"), F.round("hist", 6).alias("hist"))


FIT_COLUMNS = ["amplitude", "mu", "sigma", "bg", "contrast", "secondary_dt_ns", "secondary_frac", "dt_min", "dt_max", "sb_min", "sb_max"]


def _rounded(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


@query(oracle(f"SELECT capture_id, station, TRUE AS success, {_rounded(FIT_COLUMNS)} FROM fit", extra=f"{spectra()}, {fits()}"))
def a19_fit_dt_peak(spark, sf_dir):
    r = coincidence.station_fits(_hits(spark, sf_dir), geometry.cabling(spark))
    return r.select("capture_id", "station", "success", *(F.round(c, 6).alias(c) for c in FIT_COLUMNS))


@query()
def a19_curve_fit(spark, sf_dir):
    """The same peaks by bounded least squares."""
    r = coincidence.station_fits(_hits(spark, sf_dir), geometry.cabling(spark), curve=True)
    return r.select("capture_id", "station", "success", "method", *(F.round(c, 6).alias(c) for c in FIT_COLUMNS))


EFF0 = "eff0 AS (SELECT cnt.*, n_signal / n_triggers AS raw_efficiency, n_sideband / n_triggers * ((dt_max - dt_min) / (sb_max - sb_min)) AS accidental_efficiency, 0.9944578832097535::DOUBLE AS z FROM cnt JOIN {})"
EFF = EFF0.format("win ON win.station = cnt.station") + """,
eff AS (SELECT *, (raw_efficiency + z * z / n_triggers / 2) / (1 + z * z / n_triggers) AS centre, z * sqrt(raw_efficiency * (1 - raw_efficiency) / n_triggers + z * z / n_triggers / (4 * n_triggers)) / (1 + z * z / n_triggers) AS half FROM eff0)"""


@query(oracle("SELECT capture_id, station, n_marker_intervals, n_triggers, n_signal, n_sideband, round(raw_efficiency, 9) AS raw_efficiency, round(accidental_efficiency, 9) AS accidental_efficiency, round(raw_efficiency - accidental_efficiency, 9) AS efficiency, round((raw_efficiency - accidental_efficiency) / (1 - accidental_efficiency), 9) AS efficiency_corrected, round(greatest(0, greatest(0, centre - half) - accidental_efficiency), 9) AS efficiency_lo, round(least(1, least(1, centre + half) - accidental_efficiency), 9) AS efficiency_hi FROM eff", extra=f"{TRIG}, {EFF}"))
def a23_efficiency_record(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    r = coincidence.group_efficiency(coincidence.build_groups(hits, geometry.cabling(spark)), inputs.windows(hits))
    names = ["raw_efficiency", "accidental_efficiency", "efficiency", "efficiency_corrected", "efficiency_lo", "efficiency_hi"]
    return r.select("capture_id", "station", "n_marker_intervals", "n_triggers", "n_signal", "n_sideband", *(F.round(c, 9).alias(c) for c in names))


@query("SELECT l_suppkey, k, n, round(greatest(0, (k / n + zz / n / 2) / (1 + zz / n) - sqrt(zz) * sqrt(k / n * (1 - k / n) / n + zz / n / (4 * n)) / (1 + zz / n)), 9) AS lo, round(least(1, (k / n + zz / n / 2) / (1 + zz / n) + sqrt(zz) * sqrt(k / n * (1 - k / n) / n + zz / n / (4 * n)) / (1 + zz / n)), 9) AS hi FROM (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n, 0.9944578832097535::DOUBLE * 0.9944578832097535::DOUBLE AS zz FROM lineitem GROUP BY 1)")
def a24_wilson_interval(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count("*").alias("n"))
    ci = rows.withColumn("ci", fs.wilson(F.col("k"), F.col("n")))
    return ci.select("l_suppkey", "k", "n", F.round("ci.lo", 9).alias("lo"), F.round("ci.hi", 9).alias("hi"))


def _tail(x: str, k: str) -> str:
    """The probability of k or more of n at x."""
    return f"list_sum(list_transform(range({k}, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({x}) + (n - i) * ln(1 - {x}))))"


@query(f"""WITH RECURSIVE c AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n FROM lineitem GROUP BY 1),
b AS (SELECT l_suppkey, k, n, 0 AS step, 0::DOUBLE AS a0, 1::DOUBLE AS a1, 0::DOUBLE AS b0, 1::DOUBLE AS b1 FROM c
 UNION ALL SELECT l_suppkey, k, n, step + 1, CASE WHEN t < 0.15865::DOUBLE THEN (a0 + a1) / 2 ELSE a0 END, CASE WHEN t < 0.15865::DOUBLE THEN a1 ELSE (a0 + a1) / 2 END, CASE WHEN u < 0.84135::DOUBLE THEN (b0 + b1) / 2 ELSE b0 END, CASE WHEN u < 0.84135::DOUBLE THEN b1 ELSE (b0 + b1) / 2 END
 FROM (SELECT *, CASE WHEN k > 0 THEN {_tail("((a0 + a1) / 2)", "k")} ELSE 1 END AS t, CASE WHEN k < n THEN {_tail("((b0 + b1) / 2)", "k + 1")} ELSE 0 END AS u FROM b) x WHERE step < 45)
SELECT l_suppkey, k, n, round((a0 + a1) / 2, 8) AS lo, round((b0 + b1) / 2, 8) AS hi FROM b WHERE step = 45""")
def a24_exact_interval(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count("*").alias("n"))
    ci = rows.withColumn("ci", fs.clopper_pearson(F.col("k"), F.col("n")))
    return ci.select("l_suppkey", "k", "n", F.round("ci.lo", 8).alias("lo"), F.round("ci.hi", 8).alias("hi"))


ANALYSED = [c for c in FIT_COLUMNS if c not in ("mu", "sigma")] + ["mu_ns", "sigma_ns", "efficiency", "efficiency_corrected", "efficiency_lo", "efficiency_hi", "raw_efficiency", "accidental_efficiency"]


def _analysis_sql(window: float, mask: str = "mask") -> str:
    """The tables up to ``analysed``: fit, counts, efficiency and masked hits of each capture and station."""
    of_fit = "fit ON fit.capture_id = {0}.capture_id AND fit.station = {0}.station"
    return f"""{spectra(window)}, {fits(window)}, {_trig(of_fit.format("g"))}, {EFF0.format(of_fit.format("cnt"))}, {EFF.partition("),")[2].strip()},
lost AS (SELECT capture_id, count(*) AS n FROM hits h WHERE EXISTS (SELECT 1 FROM {mask} m WHERE m.capture_id = h.capture_id AND m.vmm = h.vmm AND m.ch = h.ch AND NOT (m.vmm = 0 AND m.ch = 44)) GROUP BY 1),
analysed AS (SELECT eff.* EXCLUDE (z, centre, half), fit.* EXCLUDE (capture_id, station, mu, sigma), mu AS mu_ns, sigma AS sigma_ns, z_mm, coalesce(lost.n, 0) AS n_masked_hits, raw_efficiency - accidental_efficiency AS efficiency, (raw_efficiency - accidental_efficiency) / (1 - accidental_efficiency) AS efficiency_corrected, greatest(0, greatest(0, centre - half) - accidental_efficiency) AS efficiency_lo, least(1, least(1, centre + half) - accidental_efficiency) AS efficiency_hi
 FROM eff JOIN {of_fit.format("eff")} JOIN (SELECT DISTINCT station AS st, z_mm FROM cabling) z ON st = eff.station LEFT JOIN lost ON lost.capture_id = eff.capture_id)"""


@query(oracle(f"SELECT capture_id, station, z_mm, n_marker_intervals, n_triggers, n_signal, n_sideband, n_masked_hits, {_rounded(ANALYSED)} FROM analysed", extra=_analysis_sql(2000), source="masked"))
def a25_analyse(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    r = coincidence.analyse(hits, geometry.cabling(spark), _mask(spark, hits))
    return r.select("capture_id", "station", "z_mm", "n_marker_intervals", "n_triggers", "n_signal", "n_sideband", "n_masked_hits", *(F.round(c, 6).alias(c) for c in ANALYSED))


@query(oracle(f"SELECT capture_id, station, z_mm, n_triggers, n_signal, n_sideband, {_rounded(ANALYSED)} FROM analysed", extra=_analysis_sql(1000)))
def a25_analyse_unmasked(spark, sf_dir):
    r = entry(spark, sf_dir)
    return r.select("capture_id", "station", "z_mm", "n_triggers", "n_signal", "n_sideband", *(F.round(c, 6).alias(c) for c in ANALYSED))


@query(oracle("SELECT station, CASE WHEN count(*) >= 100 THEN round(sqrt(var_pop(pad_cx) + var_pop(pad_cy)), 6) END AS spread, count(*) AS hits FROM hits h JOIN pads p ON p.vmm = h.vmm AND p.ch = h.ch WHERE mapped GROUP BY station"))
def a27_beam_spread(spark, sf_dir):
    r = maps.beam_spread(_raw(spark, sf_dir), _pads(spark))
    return r.select("station", F.round("spread", 6).alias("spread"), "hits")


ROUGH = "rough AS (SELECT lit.station, n, med.med AS m, max(med.med) OVER (PARTITION BY lit.station) AS top, sum(n) OVER (PARTITION BY lit.station) AS hits, count(*) OVER (PARTITION BY lit.station) AS npads FROM lit JOIN med ON med.vmm = lit.vmm AND med.ch = lit.ch)"


@query(oracle("SELECT station, CASE WHEN count(*) FILTER (ok) >= 10 THEN round(median(CASE WHEN ok THEN abs(n - m) / (n + m + 1) END), 9) END AS roughness FROM (SELECT *, top > 0 AND m > 0.05 * top AND hits >= 500 AND npads >= 20 AS ok FROM rough) x GROUP BY station", extra=ROUGH))
def a28_map_roughness(spark, sf_dir):
    r = maps.map_roughness(_raw(spark, sf_dir), _pads(spark))
    return r.select("station", F.round("roughness", 9).alias("roughness"))


@query(oracle("SELECT * FROM hot_pads"))
def a29_hot_pads(spark, sf_dir):
    return masks.auto_hot_pads(_raw(spark, sf_dir), _pads(spark))


@query(oracle("SELECT l.capture_id, l.vmm, l.ch FROM lit_c l JOIN med_c m ON l.capture_id = m.capture_id AND l.vmm = m.vmm AND l.ch = m.ch WHERE n >= 3 AND n > 1.5 * greatest(m.med, 1)"))
def a29_warm_pads(spark, sf_dir):
    """With lower limits, so that more pads pass."""
    return masks.auto_hot_pads(_raw(spark, sf_dir), _pads(spark), ratio=1.5, min_hits=3)


WIRING = "wire AS (SELECT strategy, lower AS bottom_half, station, CASE WHEN count(*) >= 100 THEN sqrt(var_pop(pad_cx) + var_pop(pad_cy)) END AS spread FROM in_time h JOIN all_pads p USING (vmm, ch, station) WHERE mapped GROUP BY ALL)"


@query(oracle("SELECT strategy, bottom_half, station, round(spread, 6) AS spread, round(mean, 6) AS mean_spread, coalesce(round(mean, 9) = min(round(mean, 9)) OVER (), FALSE) AS best FROM (SELECT *, avg(spread) OVER (PARTITION BY strategy, bottom_half) AS mean FROM wire) x", extra=WIRING, source="channel_masked"))
def a30_wiring_scan(spark, sf_dir):
    r = maps.scan_wiring(_scanned(spark, sf_dir), inputs.pad_geometry(spark))
    return r.select("strategy", "bottom_half", "station", F.round("spread", 6).alias("spread"), F.round("mean_spread", 6).alias("mean_spread"), "best")


HALVES = """pp AS (SELECT c.vmm, c.ch, c.station, c.connector, c.half, s.strategy, g.pad_cx, g.pad_cy FROM (SELECT DISTINCT vmm, ch, station, connector, half, sector FROM channels) c, (VALUES ('linear'), ('reverse'), ('pairswap')) s(strategy)
  JOIN geometry g ON g.channel_id = c.sector * 128 + (CASE WHEN c.half = 'top' THEN 65 ELSE 1 END + CASE s.strategy WHEN 'linear' THEN c.ch WHEN 'reverse' THEN 63 - c.ch ELSE xor(c.ch, 1) END) - 1),
ctr AS (SELECT pp.station, median(pad_cx) AS cx, median(pad_cy) AS cy FROM in_time h JOIN pp ON pp.vmm = h.vmm AND pp.ch = h.ch WHERE strategy = 'reverse' GROUP BY 1 HAVING count(*) >= 200),
tried AS (SELECT pp.station, connector, half, pp.vmm, strategy, median(sqrt((pad_cx - cx) * (pad_cx - cx) + (pad_cy - cy) * (pad_cy - cy))) AS distance FROM in_time h JOIN pp ON pp.vmm = h.vmm AND pp.ch = h.ch JOIN ctr ON ctr.station = pp.station WHERE pp.vmm IN (SELECT vmm FROM in_time GROUP BY 1 HAVING count(*) >= 50) GROUP BY ALL)"""


@query(oracle("SELECT station, connector, half, vmm, strategy, round(distance, 6) AS distance, row_number() OVER (PARTITION BY vmm ORDER BY round(distance, 9), list_position(['linear', 'reverse', 'pairswap'], strategy)) = 1 AS picked FROM tried", extra=HALVES, source="channel_masked"))
def a31_wiring_per_half(spark, sf_dir):
    r = maps.scan_wiring_per_half(_scanned(spark, sf_dir), inputs.pad_geometry(spark))
    return r.select("station", "connector", "half", "vmm", "strategy", F.round("distance", 6).alias("distance"), "picked")


@query(oracle("SELECT hv.station, connector, half, s[h + 1] AS strategy FROM w12 JOIN hv ON hv.station = w12.station", extra=greedy_wiring(), source="channel_masked"))
def a32_wiring_roughness(spark, sf_dir):
    best = maps.scan_wiring_roughness(_scanned(spark, sf_dir), inputs.pad_geometry(spark), passes=2)
    return spark.createDataFrame([(*k, v) for k, v in sorted(best.items())], "station string, connector int, half string, strategy string")


BEAM = "beam AS (SELECT h.capture_id, h.station, count(*) AS n_in_time, round(avg(pad_cx), 6) AS x_mean_mm, round(stddev_pop(pad_cx), 6) AS x_rms_mm, round(avg(pad_cy), 6) AS y_mean_mm, round(stddev_pop(pad_cy), 6) AS y_rms_mm FROM in_time h JOIN pads p ON p.vmm = h.vmm AND p.ch = h.ch WHERE mapped GROUP BY 1, 2)"


@query(oracle("SELECT * FROM beam", extra=BEAM, source="masked"))
def a33_beam_profile(spark, sf_dir):
    r = maps.beam_profile(_in_time(spark, _unmasked(spark, sf_dir)), _pads(spark))
    return r.select("capture_id", "station", "n_in_time", *(F.round(c, 6).alias(c) for c in ("x_mean_mm", "x_rms_mm", "y_mean_mm", "y_rms_mm")))


PROFILE = "pr AS (SELECT h.capture_id, h.station, 'x' AS axis, pad_cx AS v FROM in_time h JOIN pads p ON p.vmm = h.vmm AND p.ch = h.ch WHERE mapped UNION ALL SELECT h.capture_id, h.station, 'y', pad_cy FROM in_time h JOIN pads p ON p.vmm = h.vmm AND p.ch = h.ch WHERE mapped), pw AS (SELECT *, min(v) OVER w AS a, max(v) OVER w AS b FROM pr WINDOW w AS (PARTITION BY capture_id, station, axis))"


@query(oracle("SELECT capture_id, station, axis, CAST(least(floor((v - a) * 60 / (b - a)), 59) AS BIGINT) AS bin, count(*) AS n FROM pw GROUP BY ALL", extra=PROFILE, source="masked"))
def a33_profile_histogram(spark, sf_dir):
    return maps.profile_histogram(_in_time(spark, _unmasked(spark, sf_dir)), _pads(spark))


@query(oracle("SELECT l.capture_id, l.station, l.vmm, l.ch, coalesce(a.n, 0) AS n_all, coalesce(t.n, 0) AS n_in_time FROM lit_c l LEFT JOIN (SELECT capture_id, vmm, ch, count(*) AS n FROM masked WHERE vmm <> 0 GROUP BY ALL) a ON a.capture_id = l.capture_id AND a.vmm = l.vmm AND a.ch = l.ch LEFT JOIN (SELECT capture_id, vmm, ch, count(*) AS n FROM in_time GROUP BY ALL) t ON t.capture_id = l.capture_id AND t.vmm = l.vmm AND t.ch = l.ch", source="masked"))
def a34_hit_maps(spark, sf_dir):
    hits = _unmasked(spark, sf_dir)
    return maps.hit_maps(hits.where("vmm <> 0"), _in_time(spark, hits), _pads(spark)).select("capture_id", "station", "vmm", "ch", "n_all", "n_in_time")


def _fixed_sql() -> str:
    rows = [f"SELECT '{n}' AS hist, vmm, {'hit_valid' if n == 'offset' else 'CAST(NULL AS BOOLEAN)'} AS valid, CAST(least(floor((\"{c}\" - ({lo}::DOUBLE)) * {b} / {hi - lo}::DOUBLE), {b - 1}) AS INT) AS bin FROM hits WHERE \"{c}\" BETWEEN {lo} AND {hi}" for n, (c, b, lo, hi) in histograms.FIXED.items()]
    rows.append("SELECT 'ot', vmm, CAST(NULL AS BOOLEAN), CAST(over_threshold AS INT) FROM hits")
    return f"SELECT hist, vmm, valid, bin, count(*) AS n FROM ({' UNION ALL '.join(rows)}) x GROUP BY ALL"


@query(oracle(_fixed_sql()))
def a35_qa_fixed_histograms(spark, sf_dir):
    return histograms.qa_fixed(_hits(spark, sf_dir))


@query(oracle("SELECT vmm, ch, CAST(least(floor(adc * 100 / 1024::DOUBLE), 99) AS BIGINT) AS bin, count(*) AS n FROM hits GROUP BY ALL"))
def a35_qa_adc_channel(spark, sf_dir):
    return histograms.qa_adc_channel(_raw(spark, sf_dir))


RANGED = "rg AS (SELECT *, min(x) OVER w AS a, max(x) OVER w AS b FROM (" + " UNION ALL ".join(f"SELECT capture_id, '{c}' AS hist, CAST(\"{c}\" AS DOUBLE) AS x FROM hits" for c in [*histograms.RANGED, "trigger_counter"]) + ") y WINDOW w AS (PARTITION BY capture_id, hist)), rb AS (SELECT *, CASE WHEN hist = 'trigger_counter' THEN least(200, CAST(b - a + 1 AS INT)) ELSE 200 END AS bins FROM rg WHERE b > a)"


@query(oracle("SELECT capture_id, hist, CAST(least(floor((x - a) * bins / (b - a)), bins - 1) AS BIGINT) AS bin, count(*) AS n FROM rb GROUP BY ALL", "TRG", extra=RANGED))
def a36_qa_ranged_histograms(spark, sf_dir):
    return histograms.qa_ranged(_hits(spark, sf_dir, data_format="TRG"))


@query(oracle("SELECT capture_id, vmm, CAST(least(floor((x - a) * 100 / (b - a)), 99) AS BIGINT) AS bin, count(*) AS n FROM (SELECT *, min(x) OVER (PARTITION BY capture_id) AS a, max(x) OVER (PARTITION BY capture_id) AS b FROM (SELECT h.capture_id, h.vmm, CAST(CAST(adc_slope * adc + adc_offset AS FLOAT) AS DOUBLE) AS x FROM raw h JOIN cal ON cal.vmm = h.vmm AND cal.ch = h.ch) y) z GROUP BY ALL"))
def a36_qa_calibrated_adc(spark, sf_dir):
    return histograms.qa_calibrated(oh.derive(_raw(spark, sf_dir), inputs.calibration(spark)))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of each capture with efficiency and beam profile, by the windows of the masked hits."""
    hits, meta = _meta(spark, sf_dir)
    kept = masks.apply_mask(hits, _mask(spark, hits))[0]
    eff = coincidence.group_efficiency(coincidence.build_groups(kept, geometry.cabling(spark)), inputs.windows(kept))
    analysis = eff.withColumns({"mu_ns": F.lit(135.0), "sigma_ns": F.lit(20.0), "contrast": F.lit(9.0)})
    return scalars.events_summary(hits, meta, analysis, maps.beam_profile(_in_time(spark, kept), _pads(spark)))


@query(oracle("SELECT b.*, n_triggers_dedup, round(raw_efficiency - accidental_efficiency, 9) AS efficiency FROM beam b JOIN (SELECT *, max(n_triggers) OVER (PARTITION BY capture_id) AS n_triggers_dedup FROM eff) e ON e.capture_id = b.capture_id AND e.station = b.station", extra=f"{TRIG}, {EFF}, {BEAM}", source="masked"))
def a37_events_profiles(spark, sf_dir):
    names = ["n_in_time", "x_mean_mm", "x_rms_mm", "y_mean_mm", "y_rms_mm"]
    rows = _summary(spark, sf_dir).select("capture_id", "n_triggers_dedup", "efficiency", F.explode("beam_profile").alias("station", "p"))
    return rows.select("capture_id", "station", "n_triggers_dedup", F.round(F.col("efficiency")[F.col("station")]["efficiency"], 9).alias("efficiency"), "p.n_in_time", *(F.round(f"p.{c}", 6).alias(c) for c in names[1:]))


@query(oracle("SELECT capture_id, count(*) AS n_hits, count(*) FILTER (hit_valid) AS n_hits_valid, min(abs_time_ns) AS t_first_ns, max(abs_time_ns) AS t_last_ns, count(*) FILTER (vmm = 9) AS hits_vmm9 FROM hits GROUP BY 1"))
def a37_events_summary(spark, sf_dir):
    hits, meta = _meta(spark, sf_dir)
    r = scalars.events_summary(hits, meta)
    return r.select("capture_id", "n_hits", "n_hits_valid", "t_first_ns", "t_last_ns", F.try_element_at("hits_per_vmm", F.lit("9")).alias("hits_vmm9"))


@query(oracle("SELECT vmmid, CAST(least(floor((adc - a)::DOUBLE * bins / (b - a)), bins - 1) AS BIGINT) AS bin, bins, count(*) AS n FROM (SELECT *, greatest(1, CAST(floor((b - a) / 5) AS BIGINT)) AS bins FROM (SELECT vmmid, adc, min(adc) OVER w AS a, max(adc) OVER w AS b FROM sim WHERE vmmid IN (2, 3) WINDOW w AS (PARTITION BY vmmid)) x) y GROUP BY ALL", extra=f"{PKT}, {SIDE}"))
def a38_adc_spectra(spark, sf_dir):
    return histograms.width_histogram(strips.select_chips(_simple(spark, sf_dir), (2, 3)), "adc", 5, by=("vmmid",))


@query(oracle("SELECT capture_id, pkt_no, word_no, frame, bcid, adc FROM (SELECT *, count(*) OVER (PARTITION BY capture_id, frame, bcid) AS k FROM sim) x WHERE k = 1", extra=f"{PKT}, {SIDE}"))
def a39_mono_events(spark, sf_dir):
    return strips.mono_events(_simple(spark, sf_dir)).select("capture_id", "pkt_no", "word_no", "frame", "bcid", "adc")


@query(oracle("SELECT capture_id, chno, count(*) AS n FROM sim WHERE vmmid IN (0, 1) GROUP BY ALL", extra=f"{PKT}, {SIDE}"))
def a40_strip_occupancy(spark, sf_dir):
    return strips.strip_counts(_simple(spark, sf_dir), (0, 1), by=("capture_id",))


IMAGE = "SELECT {by} y.range AS y, x.range AS x, CAST(coalesce(b.n, 0) + coalesce(a.n, 0) AS DOUBLE) AS intensity FROM {groups} range(124) y CROSS JOIN range(124) x LEFT JOIN (SELECT {own} chno, count(*) AS n FROM {src} WHERE vmmid IN (0, 1) GROUP BY ALL) a ON a.chno = x.range {ja} LEFT JOIN (SELECT {own} chno, count(*) AS n FROM {src} WHERE vmmid IN (2, 3) GROUP BY ALL) b ON b.chno = y.range {jb}"


@query(oracle(IMAGE.format(by="", groups="", own="", src="rep", ja="", jb=""), extra=f"{PKT}, {SIDE}, {PINS}"))
def a41_xy_image(spark, sf_dir):
    return strips.xy_image(strips.repin(_simple(spark, sf_dir), inputs.pin_map(spark)))


BATCH = "bat AS (SELECT *, (k - 1) // 500 AS batch FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY pkt_no, word_no) AS k, count(*) OVER (PARTITION BY capture_id) AS total FROM sim) x WHERE (k - 1) // 500 < total // 500), bg AS (SELECT DISTINCT capture_id, batch FROM bat)"


@query(oracle(IMAGE.format(by="bg.capture_id, bg.batch,", groups="bg CROSS JOIN", own="capture_id, batch,", src="bat", ja="AND a.capture_id = bg.capture_id AND a.batch = bg.batch", jb="AND b.capture_id = bg.capture_id AND b.batch = bg.batch"), extra=f"{PKT}, {SIDE}, {BATCH}"))
def a42_batched_images(spark, sf_dir):
    return strips.xy_image(strips.batched(_simple(spark, sf_dir), 500), by=("capture_id", "batch"))


@query(f"WITH s AS (SELECT c1, count(*) AS n FROM (SELECT DISTINCT c1, c2, c3 FROM ({MEMBERS})) x GROUP BY 1) SELECT CASE WHEN count(*) < 640 THEN 0 ELSE min(n) END AS smallest, CAST(sum(n) AS DOUBLE) / 640 AS mean, max(n) AS largest FROM s")
def a43_bucket_occupancy(spark, sf_dir):
    return triplets.channel_occupancy(_triples(spark, sf_dir, members=True))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, meta = _meta(spark, sf_dir)
    r = scalars.build_scalars(hits, histograms.build_counts(hits), meta, geometry.cabling(spark))
    return trends.chronological(r.withColumns({"capture": F.concat(F.lit("fec_"), F.lpad(F.col("capture_id").cast("string"), 5, "0"), F.lit("_x.pcapng")), "mtime": F.col("capture_id")}))


@query(oracle("""SELECT idx, 'n_hits' AS series, CAST(n AS DOUBLE) AS value FROM (SELECT capture_id, row_number() OVER (ORDER BY capture_id) - 1 AS idx, count(*) AS n FROM hits GROUP BY capture_id) x
UNION ALL SELECT idx, 'live_' || station, CAST(count(DISTINCT h.vmm * 64 + ch) AS DOUBLE) FROM hits h JOIN cabling c ON c.vmm = h.vmm JOIN (SELECT capture_id, row_number() OVER (ORDER BY capture_id) - 1 AS idx FROM (SELECT DISTINCT capture_id FROM hits) d) k ON k.capture_id = h.capture_id GROUP BY idx, station"""))
def a44_trend_series(spark, sf_dir):
    series = {"n_hits": F.col("n_hits")} | {f"live_{s}": trends.live_of(v) for s, v in STATION_VMMS.items()}
    return trends.trend_series(_records(spark, sf_dir), series)


def _scan_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Voltage and efficiency records of a scan: each capture is a file of a sub-run, taken twice."""
    hits = _hits(spark, sf_dir)
    eff = coincidence.group_efficiency(coincidence.build_groups(hits, geometry.cabling(spark)), inputs.windows(hits))
    kind = F.when(F.col("capture_id") % 2 == 0, "meshscan_").otherwise("driftscan_")
    named = eff.withColumns({"run_no": F.explode(F.array(F.lit(0), F.lit(1))), "sub_run": F.concat(kind, F.col("capture_id").cast("string")), "mu_ns": F.lit(135.0), "sigma_ns": F.lit(20.0), "contrast": F.lit(9.0)})
    named = named.withColumns({"run": F.concat(F.lit("run_"), F.col("run_no").cast("string")), "n_trig": F.col("n_triggers") + F.col("run_no")})
    fields = F.struct("efficiency", "efficiency_lo", "efficiency_hi", "raw_efficiency", "accidental_efficiency", "mu_ns", "sigma_ns", "contrast")
    events = named.groupBy("run", "run_no", "sub_run").agg(F.max("n_trig").alias("n_triggers"), F.map_from_entries(F.collect_list(F.struct("station", fields))).alias("efficiency"))
    events = events.withColumns({"path": F.concat_ws("/", "run", "sub_run"), "file": F.concat(F.col("sub_run"), F.lit("_00"))})
    hv = named.select("run", "sub_run", "station", (400 + 10 * F.col("capture_id")).cast("double").alias("mesh_v"), (600 + 5 * F.col("capture_id")).cast("double").alias("drift_v")).distinct()
    return hv, events


@query(oracle("SELECT (CASE WHEN capture_id % 2 = 0 THEN 'meshscan_' ELSE 'driftscan_' END) || capture_id AS sub_run, 'run_1' AS run, (CASE WHEN capture_id % 2 = 0 THEN 'meshscan_' ELSE 'driftscan_' END) || capture_id || '_00' AS file, station, 400 + 10 * capture_id::DOUBLE AS mesh_v, 600 + 5 * capture_id::DOUBLE AS drift_v, max(n_triggers) OVER (PARTITION BY capture_id) + 1 AS n_triggers, round(raw_efficiency - accidental_efficiency, 9) AS efficiency FROM eff", extra=f"{TRIG}, {EFF}"))
def j12_scan_table(spark, sf_dir):
    r = trends.scan_table(*_scan_inputs(spark, sf_dir))
    return r.select("sub_run", "run", "file", "station", "mesh_v", "drift_v", "n_triggers", F.round("efficiency", 9).alias("efficiency"))


@query(oracle("SELECT station, 400 + 10 * capture_id::DOUBLE AS x, round(raw_efficiency - accidental_efficiency, 9) AS y, round(greatest(0, raw_efficiency - accidental_efficiency - greatest(0, greatest(0, centre - half) - accidental_efficiency)), 9) AS lo, round(greatest(0, least(1, least(1, centre + half) - accidental_efficiency) - (raw_efficiency - accidental_efficiency)), 9) AS hi FROM eff WHERE capture_id % 2 = 0", extra=f"{TRIG}, {EFF}"))
def a45_scan_points(spark, sf_dir):
    r = trends.scan_points(trends.scan_table(*_scan_inputs(spark, sf_dir)), "meshscan", "mesh_v")
    return r.select("station", "x", *(F.round(c, 9).alias(c) for c in ("y", "lo", "hi")))


@query(oracle("SELECT (CASE WHEN capture_id % 2 = 0 THEN 'meshscan_' ELSE 'driftscan_' END) || capture_id AS sub_run, station, printf('%.4f', round(raw_efficiency - accidental_efficiency, 4)) AS efficiency FROM eff WHERE capture_id % 2 = 0", extra=f"{TRIG}, {EFF}"))
def p15_s12_scan_summary(spark, sf_dir):
    table = trends.scan_table(*_scan_inputs(spark, sf_dir)).where(F.col("sub_run").startswith("meshscan"))
    return trends.scan_summary(table.withColumn("efficiency", F.round("efficiency", 4))).select("sub_run", "station", "efficiency")


# --- windows, order, sets, scalar functions ------------------------------------------------------------------------


@query(oracle("SELECT capture_id, station, srs_timestamp, CAST(len(triggers) * len(phases) AS BIGINT) AS n FROM (SELECT *, coalesce(sum(len(triggers) * len(phases)) OVER (PARTITION BY capture_id, station ORDER BY srs_timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM groups) x WHERE before < 2000"))
def w5_pair_cap(spark, sf_dir):
    rows = coincidence.group_dt(_groups(spark, sf_dir), max_pairs=2000)
    return rows.groupBy("capture_id", "station", "srs_timestamp").agg(F.count("*").alias("n"))


DEAD = f"dt20 AS (SELECT capture_id, srs_timestamp, list_reduce(list_transform(list_sort(list_distinct(list({pmod('timestamp_ns', '92160::DOUBLE')}))), lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[-1] > 20000::DOUBLE THEN list_concat(acc, x) ELSE acc END) AS t FROM hits WHERE vmm = 0 AND ch = 44 GROUP BY ALL)"


@query(oracle("SELECT capture_id, srs_timestamp, unnest(t) AS phase FROM dt20", extra=DEAD))
def w7_dedup_triggers(spark, sf_dir):
    return coincidence.triggers(_hits(spark, sf_dir), dead_ns=20000.0).select("capture_id", "srs_timestamp", F.explode("triggers").alias("phase"))


@query(oracle("SELECT capture_id, pkt_no, word_no, adc FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY pkt_no DESC, word_no DESC) AS k FROM sim) x WHERE k <= 1000", extra=f"{PKT}, {SIDE}"))
def w9_last_hits(spark, sf_dir):
    return strips.last_hits(_simple(spark, sf_dir), 1000).select("capture_id", "pkt_no", "word_no", "adc")


@query(oracle("SELECT capture_id, count(DISTINCT pkt_no) AS packets FROM raw GROUP BY ALL"))
def w11_packets_with_hits(spark, sf_dir):
    return _raw(spark, sf_dir).groupBy("capture_id").agg(F.count_distinct("pkt_no").alias("packets"))


@query(oracle("SELECT capture_id, pkt_no, frame FROM pk WHERE pkt_no < 20", extra=PKT))
def o2_first_packets(spark, sf_dir):
    return ow.headers(ow.first_packets(_packets(spark, sf_dir), 20)).select("capture_id", "pkt_no", "frame")


@query(oracle("SELECT capture_id, src_ip, dst_ip, count(*) AS n FROM pk WHERE pkt_no < 5000 GROUP BY ALL", extra=PKT))
def o6_top_talkers(spark, sf_dir):
    return ow.top_talkers(_packets(spark, sf_dir))


@query(oracle("SELECT capture_id, pkt_no, frame FROM pk WHERE pkt_no BETWEEN 30 AND 49", extra=PKT))
def o7_packet_range(spark, sf_dir):
    return ow.headers(ow.packet_range(_packets(spark, sf_dir), 30, 20)).select("capture_id", "pkt_no", "frame")


@query(oracle("SELECT DISTINCT capture_id, vmm, ch FROM mask"))
def u1_merge_masks(spark, sf_dir):
    return _mask(spark, _raw(spark, sf_dir))


@query(oracle("SELECT capture_id, word_no, count(*) AS n FROM (SELECT * FROM raw WHERE vmm < 10 UNION ALL SELECT * FROM raw WHERE vmm >= 10) x GROUP BY ALL"))
def u2_concatenate(spark, sf_dir):
    hits = _raw(spark, sf_dir)
    return hits.where("vmm < 10").unionByName(hits.where("vmm >= 10")).groupBy("capture_id", "word_no").agg(F.count("*").alias("n"))


@query(oracle('SELECT DISTINCT capture_id, "offset" FROM raw'))
def u5_offsets_seen(spark, sf_dir):
    return scalars.offsets_seen(_raw(spark, sf_dir)).select("capture_id", F.explode("offsets").alias("offset"))


@query(oracle("SELECT side, count(*) AS n FROM (SELECT 'a' AS side FROM raw WHERE vmm = 3 UNION ALL SELECT 'b' FROM raw WHERE vmm = 4) x GROUP BY 1"))
def u6_table_difference(spark, sf_dir):
    hits = _raw(spark, sf_dir)
    return compare.difference(hits.where("vmm <> 4"), hits.where("vmm <> 3")).groupBy("side").agg(F.count("*").alias("n"))


@query(oracle("SELECT g0 AS code, bcid AS value, count(*) AS n FROM fields WHERE is_hit GROUP BY ALL"))
def f1_gray_code(spark, sf_dir):
    code = fb.bits(F.col("d1"), 0, 4095)
    return ow.split_words(_words(spark, sf_dir)).where("is_hit").select(code.alias("code"), fb.gray2bin(code).alias("value")).groupBy("code", "value").agg(F.count("*").alias("n"))


@query(oracle(f"SELECT capture_id, pkt_no, word_no, {pmod('timestamp_ns', '92160::DOUBLE')} AS phase, {wrap('timestamp_ns - 50000::DOUBLE')} AS wrapped FROM hits"))
def f3_phases(spark, sf_dir):
    t = F.col("timestamp_ns")
    return _hits(spark, sf_dir).select("capture_id", "pkt_no", "word_no", fs.phase(t).alias("phase"), fs.wrap_phase(t - 50000.0).alias("wrapped"))


@query("SELECT user_id, (user_id * 2654435) % 4294967296 AS number, ((user_id * 2654435) % 4294967296 >> 24) || '.' || (((user_id * 2654435) % 4294967296 >> 16) & 255) || '.' || (((user_id * 2654435) % 4294967296 >> 8) & 255) || '.' || ((user_id * 2654435) % 4294967296 & 255) AS ip FROM events")
def f4_ip_text(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", (F.col("user_id") * 2654435 % 4294967296).alias("x"))
    ip = rows.withColumn("ip", fb.int_to_ip(F.col("x")))
    return ip.select("user_id", fb.ip_to_int(F.col("ip")).alias("number"), "ip")


@query(oracle("SELECT strategy, lower AS bottom_half, c.vmm, c.ch, strip, sector * 128 + strip - 1 AS channel_id, n FROM channels c JOIN occ ON occ.vmm = c.vmm AND occ.ch = c.ch"))
def f5_strip_orderings(spark, sf_dir):
    tables = [geometry.channels(spark, s, h).withColumns({"strategy": F.lit(s), "bottom_half": F.lit(h)}) for s in STRATEGIES for h in ("bot", "top")]
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.join(masks.occupancy(_raw(spark, sf_dir)), ["vmm", "ch"]).select("strategy", "bottom_half", "vmm", "ch", "strip", "channel_id", "n")


@query(f"SELECT key, key % 640 AS c1, (key // 640) % 640 AS c2, key // 409600 AS c3 FROM (SELECT DISTINCT {PACK} AS key FROM ({MEMBERS})) x")
def f8_triplet_hash(spark, sf_dir):
    keys = triplets.keyed(_triples(spark, sf_dir, members=True)).select("key").distinct()
    return keys.select("key", fb.unpack_triplet(F.col("key")).alias("t")).select("key", "t.c1", "t.c2", "t.c3")


@query(oracle("SELECT vmm, CAST(count(*) FILTER (over_threshold) AS BIGINT) AS k, printf('%.2f%%', round(100::DOUBLE * count(*) FILTER (over_threshold) / count(*), 2)) AS share FROM hits GROUP BY vmm"))
def f13_percent_text(spark, sf_dir):
    rows = _raw(spark, sf_dir).groupBy("vmm").agg(F.count_if("over_threshold").alias("k"), F.count("*").alias("n"))
    return rows.select("vmm", "k", fs.percent_text(F.col("k"), F.col("n")).alias("share"))


# --- side files -----------------------------------------------------------------------------------------------------


@query(oracle("SELECT v.range AS vmm, c.range AS ch, coalesce(n, 0) * 0.25::DOUBLE AS time_offset, 1::DOUBLE AS time_slope, 0::DOUBLE AS adc_offset, CASE WHEN c.range < 10 AND k.vmm IS NOT NULL THEN 1 + coalesce(n, 0)::DOUBLE ELSE 1 END AS adc_slope FROM range(32) v CROSS JOIN range(64) c LEFT JOIN occ ON occ.vmm = v.range AND occ.ch = c.range LEFT JOIN (SELECT DISTINCT vmm FROM occ) k ON k.vmm = v.range"))
def s3_calibration(spark, sf_dir):
    """Offsets and slopes by occupancy: slopes are too short an array, a later entry overrides, chips over 31 are no chips."""
    folder = shared_folder(spark, "calibration")
    chips = masks.occupancy(_raw(spark, sf_dir)).groupBy("vmm").agg(F.map_from_entries(F.collect_list(F.struct("ch", "n"))).alias("m"))
    channel = lambda upto, f: F.transform(F.sequence(F.lit(0), F.lit(upto - 1)), lambda c: f(F.coalesce(F.try_element_at("m", c.cast("smallint")), F.lit(0)).cast("double")))
    offsets, slopes = channel(70, lambda n: n * 0.25), channel(10, lambda n: n + 1)
    chip = F.col("vmm").cast("int")
    whole = F.struct(F.lit(1).alias("entry"), chip.alias("vmmID"), offsets.alias("time_offsets"), slopes.alias("adc_slopes"))
    early = F.struct(F.lit(0).alias("entry"), chip.alias("vmmID"), F.transform(offsets, lambda x: x + 7).alias("time_offsets"), slopes.alias("adc_slopes"))
    other = F.struct(F.lit(2).alias("entry"), (chip + 32).alias("vmmID"), offsets.alias("time_offsets"), slopes.alias("adc_slopes"))
    entries = chips.select(F.explode(F.array(whole, early, other)).alias("e")).agg(F.array_sort(F.collect_list("e")).alias("vmm_calibration"))
    entries.write.json(folder)
    return sidecar.read_calibration(spark, folder)


@query(oracle(f"SELECT channel_id, pad_cx, pad_cy, {', '.join(f'NULL::DOUBLE AS {c}' for c in PAD_FIELDS if c not in ('pad_cx', 'pad_cy', 'pad_w'))}, n::DOUBLE AS pad_w FROM pads p JOIN occ o ON o.vmm = p.vmm AND o.ch = p.ch WHERE mapped"))
def s4_pad_geometry(spark, sf_dir):
    """Hit pads as a file with some of the pad columns; their width is their number of hits."""
    folder = shared_folder(spark, "pads")
    lit = _pads(spark).where("mapped").join(masks.occupancy(_raw(spark, sf_dir)), ["vmm", "ch"])
    sinks.write_records(lit.select("channel_id", "pad_cx", "pad_cy", F.col("n").alias("pad_w")), folder, "csv")
    return sidecar.read_pads(spark, folder)


@query(oracle("SELECT axis, ch AS asic_pin, (ch * (CASE WHEN axis = 'X' THEN 5 ELSE 11 END) + n) % 128 AS detector_pin, row_number() OVER (PARTITION BY axis ORDER BY ch) - 1 AS idx FROM (SELECT ch, sum(n) AS n FROM occ GROUP BY ch) o, (VALUES ('X'), ('Y')) a(axis)"))
def s5_pin_map(spark, sf_dir):
    folder = shared_folder(spark, "pins")
    lit = masks.occupancy(_raw(spark, sf_dir)).groupBy("ch").agg(F.sum("n").alias("n"))
    for axis, step in (("X", 5), ("Y", 11)):
        pins = lit.select(F.col("ch").alias("Pin Number VMM3"), ((F.col("ch") * step + F.col("n")) % 128).alias("Pin Number Detecteur"))
        sinks.write_records(pins, f"{folder}/{axis}", "csv")
    return _placed(sidecar.read_pin_map(spark, f"{folder}/X", f"{folder}/Y"))


def _placed(pins: DataFrame) -> DataFrame:
    """pins with their place in order of the ASIC pin."""
    order = strips.pin_index(pins.withColumn("detector_pin", F.struct("asic_pin", "detector_pin")))
    return order.select("axis", "pin.asic_pin", "pin.detector_pin", "idx")


@query(oracle("""SELECT 'sub_' || (h.capture_id % 2) AS sub_run, 'fec_' || h.capture_id AS store, count(*) AS n_hits, any_value(np) AS n_packets, min("time") AS frame_first, round(avg(CAST(over_threshold AS INT)), 9) AS ot_fraction, count(*) FILTER (h.vmm = 5) AS hits_vmm5, count(*) FILTER (station = 'P2_MID') AS mid_hits
 FROM hits h LEFT JOIN cabling c ON c.vmm = h.vmm JOIN (SELECT capture_id, count(DISTINCT pkt_no) AS np FROM words GROUP BY 1) w ON w.capture_id = h.capture_id GROUP BY h.capture_id"""))
def s6_scalars_discovery(spark, sf_dir):
    """Records as scalars.json beside their captures, found again by their name; every capture has an unreadable one too."""
    root = shared_folder(spark, "runs")
    records = _records(spark, sf_dir).drop("capture", "mtime")
    at = F.concat(F.lit("sub_"), F.col("capture_id") % 2, F.lit("/reduced/fec_"), F.col("capture_id"))
    rows = records.select(at.alias("folder"), F.to_json(F.struct(*(c for c in records.columns if c != "capture_id"))).alias("text"))
    broken = records.select(F.concat(at, F.lit("_broken")).alias("folder"), F.lit("{no record").alias("text"))
    sinks.write_files(rows.unionByName(broken), root, "scalars.json")
    r = sidecar.read_scalars(spark, root)
    return r.select("sub_run", F.element_at(F.split("store", "/"), -1).alias("store"), "n_hits", "n_packets", "frame_first", F.round("ot_fraction", 9).alias("ot_fraction"), F.try_element_at("hits_per_vmm", F.lit("5")).alias("hits_vmm5"), F.try_element_at("per_station", F.lit("P2_MID"))["n_hits"].alias("mid_hits"))


@query(oracle("SELECT 'run_3' AS run, 3 AS run_no, 'sub_' || capture_id AS sub_run, 'fec_' || capture_id AS file, station, max(n_triggers) OVER (PARTITION BY capture_id) AS n_triggers, round(raw_efficiency - accidental_efficiency, 9) AS efficiency, round(accidental_efficiency, 9) AS accidental_efficiency FROM eff", extra=f"{TRIG}, {EFF}"))
def s7_events_discovery(spark, sf_dir):
    """Summaries as events.json of each capture, and some without an efficiency, which are left out."""
    root, hits = shared_folder(spark, "analysis"), _hits(spark, sf_dir)
    eff = coincidence.group_efficiency(coincidence.build_groups(hits, geometry.cabling(spark)), inputs.windows(hits))
    fields = F.struct(*(c for c in EFFICIENCY_FIELDS if c in eff.columns))
    events = eff.groupBy("capture_id").agg(F.max("n_triggers").alias("n_triggers_dedup"), F.map_from_entries(F.collect_list(F.struct("station", fields))).alias("efficiency"))
    at = F.concat(F.lit("sub_"), F.col("capture_id"), F.lit("/fec_"), F.col("capture_id"))
    rows = events.select(at.alias("folder"), F.to_json(F.struct("n_triggers_dedup", "efficiency")).alias("text"))
    empty = events.select(F.concat(at, F.lit("_empty")).alias("folder"), F.to_json(F.struct("n_triggers_dedup")).alias("text"))
    sinks.write_files(rows.unionByName(empty), root, "events.json")
    r = sidecar.read_events(spark, root, "run_3", 3).select("run", "run_no", "sub_run", "file", "n_triggers", F.explode("efficiency").alias("station", "e"))
    return r.select("run", "run_no", "sub_run", "file", "station", "n_triggers", F.round("e.efficiency", 9).alias("efficiency"), F.round("e.accidental_efficiency", 9).alias("accidental_efficiency"))


@query(oracle("SELECT 'run_9' AS run, 'sub_' || capture_id AS sub_run, station, count(*)::DOUBLE AS mesh_v, CASE WHEN capture_id % 2 = 0 THEN count(*) * 2::DOUBLE END AS drift_v FROM hits h JOIN cabling c ON c.vmm = h.vmm GROUP BY capture_id, station"))
def s8_hv_per_subrun(spark, sf_dir):
    """A run's configuration with a sub-run for each capture: voltages by its hits, and texts that are no numbers."""
    folder = shared_folder(spark, "config")
    hits = _raw(spark, sf_dir).join(F.broadcast(geometry.cabling(spark).select("vmm", "station")), "vmm")
    volts = hits.groupBy("capture_id", "station").agg(F.count("*").alias("n")).join(F.broadcast(spark.createDataFrame(SUPPLIES, "station string, what string, card string, channel string")), "station")
    text = F.when(F.col("what") == "mesh", F.col("n").cast("string")).when(F.col("capture_id") % 2 == 0, (2 * F.col("n")).cast("string")).otherwise("off")
    cards = volts.groupBy("capture_id", "card").agg(F.map_from_entries(F.collect_list(F.struct("channel", text.alias("v")))).alias("channels"))
    subs = cards.groupBy("capture_id").agg(F.map_from_entries(F.collect_list(F.struct("card", "channels"))).alias("hvs"))
    subs.agg(F.collect_list(F.struct(F.concat(F.lit("sub_"), F.col("capture_id")).alias("sub_run_name"), "hvs")).alias("sub_runs")).write.json(folder)
    return sidecar.read_hv(spark, folder, "run_9")


def _sent(columns: str, **kw) -> str:
    return oracle(f"SELECT 'capture-' || capture_id || '.pcapng' AS capture_id, {columns}", sent=True, **kw)


def _reduced(spark: SparkSession, sf_dir: str, keep_hits: bool) -> str:
    folder = shared_folder(spark, "reduced")
    sinks.reduce_captures(_packets(spark, sf_dir), folder, keep_hits=keep_hits)
    return folder


@query(oracle("SELECT capture_id, vmm, ch AS bin, count(*) AS n, FALSE AS hits_stored FROM hits GROUP BY ALL", sent=True))
def s15_reduce_without_hits(spark, sf_dir):
    folder = _reduced(spark, sf_dir, keep_hits=False)
    counts = sinks.read_counts(spark, f"{folder}/counts").where("hist = 'ch'")
    return counts.select("capture_id", "vmm", "bin", "n", F.lit(exists(spark, f"{folder}/hits")).alias("hits_stored"))


@query(oracle("SELECT capture_id, station, n_masked_hits, round(efficiency, 6) AS efficiency, round(contrast, 6) AS contrast FROM analysed", extra=_analysis_sql(2000, "channel_mask"), source="channel_masked", sent=True))
def s12_reduced_record(spark, sf_dir):
    records = spark.read.json(f"{_reduced(spark, sf_dir, keep_hits=True)}/scalars")
    stations = F.explode(F.array(*(F.struct(F.lit(s).alias("station"), F.col(f"efficiency.{s}").alias("e")) for s in STATION_VMMS)))
    r = records.select("capture_id", "n_masked_hits", stations.alias("s")).where("s.e IS NOT NULL")
    return r.select("capture_id", "s.station", "n_masked_hits", F.round("s.e.efficiency", 6).alias("efficiency"), F.round("s.e.contrast", 6).alias("contrast"))


# --- live analysis ----------------------------------------------------------------------------------------------------


def _follow(spark: SparkSession, sf_dir: str, start: Callable, first: str = "pkt_no < 10") -> str:
    """The folder of a live query over captures that grow: on their first part, then, from its checkpoint, on all."""
    folder, packets = shared_folder(spark, "live"), _packets(spark, sf_dir)
    for part in (packets.where(first), packets):
        capture.write_captures(part, f"{folder}/captures")
        running = start(capture.read_stream(spark, f"{folder}/captures/*.pcapng"), f"{folder}/out")
        running.awaitTermination()
    return f"{folder}/out"


def _append(rows: DataFrame, path: str):
    return rows.writeStream.format("parquet").option("checkpointLocation", f"{path}/_checkpoint").option("path", path).trigger(availableNow=True).start()


@query(oracle("SELECT 'capture-' || capture_id || '.pcapng' AS capture_id, pkt_no, src_ip, 16 + 6 * words AS bytes FROM pk", extra=PKT))
def t1_follow_captures(spark, sf_dir):
    rows = spark.read.parquet(_follow(spark, sf_dir, _append))
    return rows.select("capture_id", "pkt_no", "src_ip", F.octet_length("payload").alias("bytes"))


@query(_sent('pkt_no, word_no, fec, vmm, "time", ch, adc, over_threshold, "offset", bcid, tdc, srs_timestamp, trigger_time, trigger_counter FROM raw'))
def t2_marker_carry(spark, sf_dir):
    return spark.read.parquet(_follow(spark, sf_dir, lambda packets, path: _append(live.stream_hits(packets), path)))


def _running(packets: DataFrame, path: str):
    return live.keep_table(live.live_counts(live.stream_hits(packets)), path, None)


@query(oracle("SELECT vmm, ch, count(*) AS n FROM hits GROUP BY ALL", sent=True))
def t3_live_counts(spark, sf_dir):
    return live.newest(spark, _follow(spark, sf_dir, _running))


@query(oracle("SELECT vmm, count(*) AS n, count(*) FILTER (pkt_no >= 10) / 2::DOUBLE AS hits_per_s FROM hits GROUP BY GROUPING SETS ((vmm), ())", sent=True))
def t3_live_rates(spark, sf_dir):
    """Rates by chip and of all chips (null) between two refreshes, two seconds apart."""
    tables: list[DataFrame] = []

    def start(packets: DataFrame, path: str):
        if tables or exists(spark, path):
            tables.append(live.newest(spark, path))
        return _running(packets, path)

    path = _follow(spark, sf_dir, start)
    _, before = live.rates({}, tables[0], 2.0)
    return live.rates(before, live.newest(spark, path), 2.0)[0]


LAST = "last AS (SELECT * FROM hits ORDER BY pkt_no DESC, word_no DESC, 'capture-' || capture_id || '.pcapng' DESC LIMIT 3000)"


@query(oracle("SELECT 'adc' AS hist, vmm, CAST(least(floor(adc * 20 / 1024::DOUBLE), 19) AS BIGINT) AS bin, count(*) AS n FROM last GROUP BY ALL UNION ALL SELECT 'ch' AS hist, vmm, ch AS bin, count(*) AS n FROM last GROUP BY ALL", extra=LAST, sent=True))
def t4_t5_newest_hits(spark, sf_dir):
    """Histograms of the newest hits."""
    path = _follow(spark, sf_dir, lambda packets, path: live.keep_last(live.stream_hits(packets), path, 3000, None))
    return live.newest_histograms(live.newest(spark, path))

WINDOWED = "windowed AS (SELECT *, count(*) OVER (PARTITION BY capture_id) AS seen, CASE WHEN vmm < 2 THEN 'X' WHEN vmm < 4 THEN 'Y' END AS pair FROM hits QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY pkt_no DESC, word_no DESC) <= 200), paired AS (SELECT *, min(adc) OVER (PARTITION BY capture_id, pair) AS lo, max(adc) OVER (PARTITION BY capture_id, pair) AS hi FROM windowed WHERE pair IS NOT NULL)"


@query(oracle("SELECT 'capture-' || capture_id || '.pcapng' AS capture_id, * EXCLUDE (capture_id) FROM (SELECT capture_id, seen, 'adc' AS hist, vmm, CAST(least(floor(adc * 20 / 1024::DOUBLE), 19) AS BIGINT) AS bin, count(*) AS n FROM windowed GROUP BY ALL UNION ALL SELECT capture_id, seen, 'ch' AS hist, vmm, ch AS bin, count(*) AS n FROM windowed GROUP BY ALL UNION ALL SELECT capture_id, seen, pair AS hist, NULL AS vmm, CASE WHEN lo = hi THEN 2 ELSE least((adc - lo) * 5 // (hi - lo), 4) END AS bin, count(*) AS n FROM paired GROUP BY ALL)", extra=WINDOWED, sent=True))
def t4_t5_count_windows(spark, sf_dir):
    """Histograms of the newest 200 hits of each capture, from rings in state."""
    path = _follow(spark, sf_dir, lambda packets, path: windows.keep_windows(windows.count_window(live.stream_hits(packets), 200), path, None))
    return windows.window_histograms(live.newest(spark, f"{path}/windows"), pairs={"X": (0, 1), "Y": (2, 3)})


CLOSED = ["pkt_no < 10", "pkt_no < 40", "TRUE"]


@query(oracle("SELECT 'capture-' || printf('fec_%05d_x', capture_id) || '.pcapng' AS capture_id, hist, vmm, bin, bin2, n FROM counts", extra=COUNTS, sent=True))
def t6_rotated_captures(spark, sf_dir):
    """Histograms of captures that grow over three refreshes, each reduced once it is closed by a later one or at the end."""
    folder, packets = shared_folder(spark, "live"), _packets(spark, sf_dir)
    named = packets.withColumn("capture_id", F.format_string("fec_%05d_x", "capture_id"))
    reduce = lambda packets, _: sinks.write_counts(histograms.build_counts(oh.to_hits(ow.to_words(packets))), f"{folder}/counts")
    for k, part in enumerate(CLOSED):
        capture.write_captures(named.where(part), f"{folder}/captures")
        closed = capture.read_closed(spark, f"{folder}/captures/*.pcapng", still=0 if k == len(CLOSED) - 1 else 1000)
        live.each_closed(closed, f"{folder}/out", reduce, None).awaitTermination()
    return sinks.read_counts(spark, f"{folder}/counts")


def _sent_twice(spark: SparkSession, sf_dir: str, keep: Callable) -> DataFrame:
    """The last table of a stream of histograms by capture: first of some hits of each, then of every second capture, then of all, one of them twice."""
    folder, hits = shared_folder(spark, "live"), stored(_raw(spark, sf_dir), "hits")
    for part in ("pkt_no < 30", "capture_id % 2 = 0", "TRUE", "capture_id = 0"):
        counts = histograms.build_counts(hits.where(part)).coalesce(1)
        counts.write.mode("append").parquet(f"{folder}/counts")
        sent = spark.readStream.schema(counts.schema).parquet(f"{folder}/counts")
        keep(sent, f"{folder}/out").awaitTermination()
    return live.newest(spark, f"{folder}/out/totals")


@query(oracle("SELECT hist, vmm, bin, bin2, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL", extra=COUNTS))
def t7_resent_captures(spark, sf_dir):
    """Running totals over captures; those that are reduced again replace their part."""
    return _sent_twice(spark, sf_dir, lambda sent, path: live.keep_totals(sent, path, None))


@query(oracle("SELECT hist, vmm, bin, bin2, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL", extra=COUNTS))
def t7_live_histograms(spark, sf_dir):
    """Histograms of further captures merged into running ones."""
    folder, counts = shared_folder(spark, "live"), stored(histograms.build_counts(_raw(spark, sf_dir)), "counts")
    for part in ("capture_id % 2 = 0", "capture_id % 2 = 1"):
        counts.where(part).write.mode("append").parquet(f"{folder}/counts")
        merged = live.live_histograms(spark.readStream.schema(counts.schema).parquet(f"{folder}/counts"))
        live.keep_table(merged, f"{folder}/out", None).awaitTermination()
    return live.newest(spark, f"{folder}/out")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: efficiency of every capture and station, with fitted windows."""
    return coincidence.analyse(_hits(spark, sf_dir), geometry.cabling(spark), window_ns=1000.0)
