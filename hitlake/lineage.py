"""Cutting lineage, and folders for what lies between jobs, in storage that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEW = 500_000  # rows of a few numbers that are broadcast


def _base(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder where that is unset and Spark runs in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(_base(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in shared storage: later uses read only the columns they need."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, computed once, to be broadcast in joins if it has at most ``most`` rows; else they shuffle."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= most else df


def numbered(df: DataFrame, order: list[str], name: str, tasks: int | None = None) -> DataFrame:
    """df with ``name``: the place (from 0) of each row in the order of the columns ``order``, nulls first.

    Rows are dealt out by ranges of the order and sorted there, each task counts its own, and the tasks' counts before
    are added, so no task holds them all. Rows that are equal in ``order`` are numbered in any order, once.
    """
    ranges = df.repartitionByRange(tasks, *order) if tasks else df.repartitionByRange(*order)
    rows = cut_lineage(ranges.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)  # the task, by the function's definition; the rest is the row's place in it
    own = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a task
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = own.select("_part", F.coalesce(before, F.lit(0)).alias("_first"))
    out = rows.withColumn("_part", part).join(F.broadcast(firsts), "_part")
    return out.withColumn(name, F.col("_first") + F.col("_at") - F.shiftleft("_part", 33)).drop("_at", "_part", "_first")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name in shared storage."""
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of shared_folder that are no longer read."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
