"""Exact row numbers in a global order, without a window that one task must sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citemill.runtime import materialize


def numbered(df: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """`df` with its 1-based number in `order` as `name`.

    Rows are dealt by range and written with their range and their number within it; ranges are counted. Rows
    that are equal in `order` lie in one range, so `order` should tell rows apart.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id counts a partition's rows in their order, from the partition's number times 2**33
    ranged = materialize(ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranged")
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # one row a range
    return ranged.join(F.broadcast(counts), "_range").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")
