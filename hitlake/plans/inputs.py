"""Detector inputs that Spark derives from the ``events`` table, with the same SQL for both engines.

Every 100 events make a block: 20 markers (chips 0-19), then 20 groups of one trigger hit and one hit in each station.
Four fifths of the station hits are in time with their trigger, one in a hundred has an invalid offset. In every second
capture one channel of the second station is hot: every thirteenth of the station's hits is its.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_CTES = """
e AS (SELECT event_id AS i, user_id AS u, CAST(round(value*100) AS BIGINT) AS v,
             CAST(regexp_extract(props,'[0-9]+',0) AS BIGINT) AS k FROM {events}),
p AS (SELECT i,u,v,k, CAST(floor(i/5000) AS BIGINT) AS capture_id, CAST(floor((i%5000)/50) AS BIGINT) AS pkt_no, i%50 AS word_no,
             CAST(floor(i/100) AS BIGINT) AS blk, i%100 AS r, CAST(floor(((i%100)-20)/4) AS BIGINT) AS g, ((i%100)-20)%4 AS role FROM e),
q AS (SELECT *, ((blk*20+g)*389)%3800 + 10 AS t FROM p),
h AS (SELECT *, CASE WHEN role=0 THEN 0 WHEN role=2 AND v%13=0 AND capture_id%2=0 THEN 10 ELSE role*6-4+u%6 END AS vmm,
             CASE WHEN role=0 THEN 44 WHEN role=2 AND v%13=0 AND capture_id%2=0 THEN 33 ELSE k%64 END AS ch,
             CASE WHEN role=0 THEN t WHEN v%10<2 THEN (v*37)%4096 ELSE t+(CASE WHEN role=1 THEN 8 ELSE 5 END)+v%3-1 END AS b,
             CASE WHEN v%97=0 THEN CAST(16 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS rawoff FROM q WHERE r>=20),
hw AS (SELECT capture_id,pkt_no,word_no,
              rawoff*134217728 + (CASE WHEN v%101=0 THEN {corrupt} ELSE vmm END)*4194304 + (v%1024)*4096 + (b + CAST(floor(b/2) AS BIGINT) - 2*(b & CAST(floor(b/2) AS BIGINT))) AS d1,
              32768 + (CASE WHEN v%1024>900 THEN 16384 ELSE 0 END) + ch*256 + v%32 AS d2 FROM h),
mw AS (SELECT capture_id,pkt_no,word_no, {marker_d1} AS d1, r*1024 + {marker_low} AS d2 FROM q WHERE r<20),
words AS (SELECT capture_id,pkt_no,word_no, CAST(2 AS BIGINT) AS fec, capture_id*1000 + pkt_no AS frame, CAST(d1 AS BIGINT) AS d1, CAST(d2 AS BIGINT) AS d2 FROM (SELECT * FROM hw UNION ALL SELECT * FROM mw) x)
"""
SRS = {"marker_d1": "CAST(floor((65536*(1+blk))/1024) AS BIGINT)", "marker_low": "(65536*(1+blk))%1024"}
TRG = {"marker_d1": "CASE WHEN r<16 THEN blk%5 WHEN (blk+r)%2=0 THEN 15*CAST(268435456 AS BIGINT) + blk%64 ELSE blk*64+r END", "marker_low": "(blk*7)%1024"}


def ctes(events: str, data_format: str = "SRS", corrupt: bool = False) -> str:
    """The common table expressions from events to words."""
    return EVENT_CTES.format(events=events, corrupt="25" if corrupt else "vmm", **(SRS if data_format == "SRS" else TRG))


def words(spark: SparkSession, sf_dir: str, data_format: str = "SRS", corrupt: bool = False) -> DataFrame:
    """capture_id, pkt_no, word_no, fec, frame, d1, d2; corrupt: about one hit in a hundred has an unknown chip."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(f"WITH {ctes('{events}', data_format, corrupt)} SELECT * FROM words", events=events)


def packets(words: DataFrame) -> DataFrame:
    """The packets that hold the words: every seventh from another source, every tenth without the magic."""
    text = F.concat(F.lpad(F.hex("d1"), 8, "0"), F.lpad(F.hex("d2"), 4, "0"))
    grouped = words.groupBy("capture_id", "pkt_no", "frame", "fec").agg(F.array_sort(F.collect_list(F.struct("word_no", text.alias("t")))).alias("ws"))
    magic = F.when(F.col("pkt_no") % 10 == 9, F.lit("585858")).otherwise(F.lit("564D33"))
    payload = F.unhex(F.concat(F.lpad(F.hex("frame"), 8, "0"), magic, F.lpad(F.hex(F.col("fec") * 16), 2, "0"), F.lit("00" * 8), F.array_join(F.transform("ws", lambda w: w["t"]), "")))
    source = F.when(F.col("pkt_no") % 7 == 0, "10.0.0.7").otherwise("10.0.0.2")
    return grouped.select("capture_id", "pkt_no", source.alias("src_ip"), F.lit("10.0.0.3").alias("dst_ip"), payload.alias("payload"))


def calibration(spark: SparkSession) -> DataFrame:
    rows = spark.range(32).select(F.col("id").cast("int").alias("vmm")).crossJoin(spark.range(64).select(F.col("id").cast("int").alias("ch")))
    return rows.select("vmm", "ch", ((F.col("vmm") % 5) * F.lit(0.25)).alias("time_offset"), F.lit(1.0).alias("time_slope"), (F.col("ch") % 4).cast("double").alias("adc_offset"), (1 + F.col("vmm") % 3 * F.lit(0.5)).alias("adc_slope")).coalesce(1)


def pad_geometry(spark: SparkSession) -> DataFrame:
    sector, strip = F.floor(F.col("id") / 128), F.col("id") % 128
    rows = spark.range(1280).where("id % 37 <> 5")
    return rows.select(F.col("id").cast("int").alias("channel_id"), (100 + 4 * sector + strip % 16 * 5).cast("double").alias("pad_cx"), (F.floor(strip / 16) * 6).cast("double").alias("pad_cy"), F.lit(5.0).alias("pad_w"), F.lit(5.0).alias("pad_h"), (sector * 3).cast("double").alias("pad_angle")).coalesce(1)


def pin_map(spark: SparkSession) -> DataFrame:
    rows = spark.range(128).crossJoin(spark.createDataFrame([("X",), ("Y",)], "axis string"))
    step = F.when(F.col("axis") == "X", 5).otherwise(11)
    return rows.select("axis", (F.col("id") * 7 % 128).cast("int").alias("asic_pin"), ((F.col("id") * step + 3) % 128).cast("int").alias("detector_pin"))


# Windows of the derived captures, as the coincidence queries state them to both engines.
WINDOWS = [("P2_IN", 155.0, 20.0), ("P2_MID", 135.0, 20.0), ("P2_OUT", 135.0, 20.0)]


def windows(hits: DataFrame) -> DataFrame:
    """Fits of all captures and stations with the WINDOWS above."""
    rows = hits.sparkSession.createDataFrame(WINDOWS, "station string, mu double, sigma double").coalesce(1)
    c = F.col
    fits = rows.select("station", "mu", "sigma", (c("mu") - 3 * c("sigma")).alias("dt_min"), (c("mu") + 3 * c("sigma")).alias("dt_max"), (c("mu") + 4 * c("sigma")).alias("sb_min"), (c("mu") + 10 * c("sigma")).alias("sb_max"), F.lit(True).alias("success"))
    return hits.select("capture_id").distinct().crossJoin(fits)
