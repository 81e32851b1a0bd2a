"""Whole rows by a hash of their id and text (what a filtering stage decides on), and joins with hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashes (16 bytes each) that are sent to all executors at most; beyond it a join is shuffled.
SMALL_KEYS = 500_000
#: Rows of a table of groups that are sent to all executors at most, and rows that make a group a hot one.
SMALL_GROUPS, HOT = 250_000, 1_000


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits; rows that share it have the same id and text; nulls count as values of their own."""
    body = F.when(F.col(text).isNull(), F.lit("n")).otherwise(F.concat(F.lit("t"), F.col(text)))
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")), F.lit(":"), body)))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with further underscores in front while a column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small(keys: DataFrame) -> DataFrame:
    """`keys`, to be sent to all executors if it has few rows; count it first on a written table."""
    return F.broadcast(keys) if keys.count() <= SMALL_KEYS else keys


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `docs` whose key isn't in `keys` (one column of hashes, in a written table)."""
    key = free_name(docs, "_row")
    gone = small(keys.toDF(key))
    return docs.withColumn(key, row_key()).join(gone, key, "left_anti").select(*docs.columns)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by `keys` over the session's number of shuffle partitions: for rows that are small but much work each,
    which partitions sized by bytes would put into a few long tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def meet(rows: DataFrame, groups: DataFrame, on: list[str], size: str, how: str = "inner") -> DataFrame:
    """`rows` joined with `groups`, a written table of one row for each value of `on`, with its number of rows as `size`.

    A group of any size is dealt as its rows lie: few groups are sent to all executors; of many groups, those
    with more than `HOT` rows are (there are `rows` / `HOT` at most), and the others meet in a shuffled join.
    """
    if groups.count() <= SMALL_GROUPS:
        return rows.join(F.broadcast(groups), on, how)
    hot = groups.where(F.col(size) > HOT)
    n = hot.count()
    if not n:
        return rows.join(groups, on, how)
    hot = F.broadcast(hot) if n <= SMALL_GROUPS else hot
    others = rows.join(hot.select(*on), on, "left_anti").join(groups.where(F.col(size) <= HOT), on, how)
    return rows.join(hot, on).unionByName(others)
