"""From packets (capture_id, pkt_no, src_ip, dst_ip, payload) to 6-byte words (capture_id, pkt_no, word_no, fec, frame, d1, d2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import bits, gray2bin
from ..lineage import small

HEADER = 16
MAGIC = b"VM3"


def _number(data: Column, first: int, length: int) -> Column:
    """Big-endian number of ``length`` bytes from byte ``first`` (0 is the first)."""
    return F.conv(F.hex(F.substring(data, first + 1, length)), 16, 10).cast("long")


def has_magic() -> Column:
    return F.substring("payload", 5, 3) == F.lit(MAGIC)


def select_packets(packets: DataFrame, src_ips: list[str] | DataFrame | None = None) -> DataFrame:
    """Packets that hold hit words: longer than 22 bytes, with the magic, of the given sources if any.

    Sources are addresses, or a table by capture (detect_sources), however many it has.
    """
    out = packets.where((F.octet_length("payload") > 22) & has_magic())
    if isinstance(src_ips, DataFrame):
        return out.join(small(src_ips.select("capture_id", "src_ip").distinct()), ["capture_id", "src_ip"], "left_semi").select(packets.columns)
    return out.where(F.col("src_ip").isin(*src_ips)) if src_ips is not None else out


def detect_sources(packets: DataFrame, n_probe: int = 500) -> DataFrame:
    """capture_id, src_ip, n: sources of packets with the magic among each capture's first n_probe packets."""
    probed = packets.where((F.col("pkt_no") < n_probe) & (F.octet_length("payload") > 6) & has_magic())
    return probed.groupBy("capture_id", "src_ip").agg(F.count("*").alias("n"))


def known_sources(packets: DataFrame, n_probe: int = 500, most: int = 1000) -> list[str]:
    """Addresses of detect_sources; raises if there are none, or more than ``most``: then select packets by that table."""
    found = sorted(r["src_ip"] for r in detect_sources(packets, n_probe).select("src_ip").distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} sources: give detect_sources itself to select_packets or to_words")
    if not found:
        raise ValueError(f"no packet with the magic in the first {n_probe} packets")
    return found


def top_talkers(packets: DataFrame, n_probe: int = 5000) -> DataFrame:
    """capture_id, src_ip, dst_ip, n over each capture's first n_probe packets, most frequent first."""
    return packets.where(F.col("pkt_no") < n_probe).groupBy("capture_id", "src_ip", "dst_ip").agg(F.count("*").alias("n")).orderBy("capture_id", F.desc("n"), "src_ip", "dst_ip")


def first_packets(packets: DataFrame, n: int) -> DataFrame:
    """The first n packets of each capture."""
    return packets.where(F.col("pkt_no") < n)


def packet_range(packets: DataFrame, start: int, n: int) -> DataFrame:
    """At most n packets of each capture from number ``start``."""
    return packets.where(F.col("pkt_no").between(start, start + n - 1))


def headers(packets: DataFrame) -> DataFrame:
    """packets with frame (bytes 0-3) and fec (upper half of byte 7)."""
    return packets.withColumns({"frame": _number(F.col("payload"), 0, 4), "fec": bits(_number(F.col("payload"), 7, 1), 4, 15)})


def to_words(packets: DataFrame, src_ips: list[str] | DataFrame | None = None, mode: str = "main") -> DataFrame:
    """One row per word.

    mode ``main`` reads ceil((length - 22) / 6) words, which leaves out a packet's last whole one; ``simple`` reads
    every whole or begun word, as the simple decoder does.
    """
    if mode not in ("main", "simple"):
        raise ValueError(f"mode must be 'main' or 'simple', not {mode!r}")
    chosen = headers(select_packets(packets, src_ips))
    span = F.octet_length("payload") - (22 if mode == "main" else HEADER)
    count = F.ceil(span / 6).cast("int")
    at = HEADER + 6 * F.col("word_no").cast("int")
    d1, d2 = (F.conv(F.hex(F.substring(F.col("payload"), at + k, F.lit(n))), 16, 10).cast("long") for k, n in ((1, 4), (5, 2)))
    words = chosen.where(count > 0).withColumn("word_no", F.explode(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long"))))
    return words.select("capture_id", "pkt_no", "word_no", "fec", "frame", F.coalesce(d1, F.lit(0)).alias("d1"), F.coalesce(d2, F.lit(0)).alias("d2"))


def split_words(words: DataFrame) -> DataFrame:
    """words with is_hit: the top bit of d2."""
    return words.withColumn("is_hit", F.col("d2").bitwiseAND(F.lit(32768).cast("long")) != 0)


def hit_fields(words: DataFrame, gray: bool = True) -> DataFrame:
    """words with vmm, adc, bcid, raw_offset, ch, over_threshold and tdc of the hit layout."""
    d1, d2 = F.col("d1"), F.col("d2")
    code = bits(d1, 0, 4095)
    return words.withColumns({"vmm": bits(d1, 22, 31), "adc": bits(d1, 12, 1023), "bcid": gray2bin(code) if gray else code, "raw_offset": bits(d1, 27, 31), "ch": bits(d2, 8, 63), "over_threshold": bits(d2, 14, 1) == 1, "tdc": bits(d2, 0, 255)})


def simple_hits(words: DataFrame) -> DataFrame:
    """The simple decoder's table, from words of mode ``simple``: every word is a hit, the offset has no sign and the BCID stays Gray-coded."""
    f = hit_fields(words, gray=False)
    return f.select("capture_id", "pkt_no", "word_no", "frame", F.col("vmm").alias("vmmid"), F.col("raw_offset").alias("offset"), "adc", "bcid", F.col("over_threshold").cast("int").alias("overthreshold"), F.col("ch").alias("chno"), "tdc")
