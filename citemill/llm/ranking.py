"""Exact global ranks without a global window: count per key range, then number rows within each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Key ranges per ranking: three hexadecimal digits of an md5. It bounds the tables of offsets, not the rows.
RANGES = 4096


def seeded_key(*parts: Column, seed: int) -> Column:
    """A uniform 128-bit hexadecimal key of the parts (nulls count as their own value) and the seed."""
    texts = [F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]
    return F.md5(F.concat_ws(":", *texts, F.lit(str(seed))).cast("binary"))


def key_range(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def hot_safe_rank(df: DataFrame, group: list[str], key: str, ties: list[str]) -> DataFrame:
    """Add `_rank` (1-based, by `key` then `ties` within `group`) and `_of` (rows of the group).

    A group may hold any share of the rows: its rows are dealt over `RANGES` key ranges, counted per
    range with partial aggregation, and only numbered within a range. The offsets are one row per
    group and range.
    """
    # with one row in each range that occurs; ranges that don't occur add nothing to an offset
    df = df.withColumn("_range", key_range(F.col(key)))
    counts = df.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*group).orderBy("_range")
    offsets = counts.select(
        *group,
        "_range",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("_of"),
    )
    within = Window.partitionBy(*group, "_range").orderBy(key, *ties)
    numbered = df.withColumn("_row", F.row_number().over(within))
    return (
        numbered.join(offsets, [*group, "_range"])
        .withColumn("_rank", F.col("_before") + F.col("_row"))
        .drop("_range", "_before", "_row")
    )
