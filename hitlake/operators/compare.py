"""Column-by-column comparison of two hit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import HIT_COLUMNS, KEY


def compare_hits(a: DataFrame, b: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n_rows, n_diff, max_delta by a full outer join on the row's place; a row of one side only differs in every column."""
    names = [c for c in columns or HIT_COLUMNS if c in a.columns and c in b.columns]
    left, right = (d.select(*KEY, F.struct(*names).alias(s)) for d, s in ((a, "a"), (b, "b")))
    both = left.join(right, KEY, "full")
    one = F.col("a").isNull() | F.col("b").isNull()
    aggs = []
    for c in names:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        aggs += [F.count_if(one | ~x.eqNullSafe(y)).alias(f"{c}_n"), F.max(F.abs(x.cast("double") - y.cast("double"))).alias(f"{c}_d")]
    row = both.agg(F.count("*").alias("rows"), *aggs)
    entries = F.array(*(F.struct(F.lit(c).alias("column"), F.col("rows").alias("n_rows"), F.col(f"{c}_n").alias("n_diff"), F.coalesce(f"{c}_d", F.lit(0.0)).alias("max_delta")) for c in names))
    return row.select(F.explode(entries).alias("e")).select("e.*")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with side."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
