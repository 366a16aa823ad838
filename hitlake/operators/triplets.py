"""Membership of channel triplets in a reference set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import CHANNELS, pack_triplet


def keyed(rows: DataFrame) -> DataFrame:
    """rows (c1, c2, c3) with their key."""
    return rows.withColumn("key", pack_triplet(F.col("c1"), F.col("c2"), F.col("c3")))


def is_physical(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows with physical: whether their triplet is a member. Spark picks the join by the members' size."""
    known = keyed(members).select("key").distinct().withColumn("physical", F.lit(True))
    return keyed(rows).join(known, "key", "left").withColumn("physical", F.coalesce("physical", F.lit(False)))


def channel_occupancy(members: DataFrame, channels: int = CHANNELS) -> DataFrame:
    """smallest, mean, largest number of distinct members of a first channel, those without members included."""
    sizes = members.select("c1", "c2", "c3").distinct().groupBy("c1").agg(F.count("*").alias("n"))
    out = sizes.agg(F.count("*").alias("used"), F.coalesce(F.min("n"), F.lit(0)).alias("low"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    return out.select(F.when(F.col("used") < channels, 0).otherwise(F.col("low")).alias("smallest"), (F.col("total") / channels).alias("mean"), "largest")
