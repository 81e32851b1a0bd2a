"""Operator 5, sharding by proportional stratified interleaving. Main path: DataFrame functions only.

Rows of each source are ranked in a seeded random order; the rank over the source's size is the row's
place in [0, 1). Sorted by that place, every stretch of the table holds every source in proportion, so
cutting the sorted order into equal stretches gives shards that all match the mixture. The law is
`rows`: shard sizes differ by one row at most. Ranks are exact at any skew (see `ranking`), the sorted
position is found the same way: how many rows of a source fall in each of 4096 place ranges follows
from its size alone, so no second pass over the rows is needed.

Equal texts aren't held together: under the law `rows` a shard has its exact share of every source, and a group
of copies with a third of all rows fits into no shard. Where copies must share a shard, dedup them first.

Nulls: a null source is a source of its own; a null text has size 16, checksum null and is still
placed. Rows that repeat in full are interchangeable. An empty table gives an empty result.
Extra columns pass through; names starting with `_` are reserved, and input columns named `shard` or `slot` are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill.llm.ranking import RANGES, hot_safe_rank, seeded_key
from citemill.runtime import table

SHARDS = 40
SEED = 5


def text_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(16)


def stratified_shards(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, source: str = "source", keys: tuple[str, ...] = ("doc_id", "_crc")
) -> DataFrame:
    """Add `shard` (0 to shards - 1) and `slot` (gapless from 0 within its shard) to `docs`.

    `keys` are the columns whose values seed the shuffle; rows that agree in all of them are alike
    as far as the order is concerned.
    """
    rows = docs.withColumn("_stratum", F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("null")))
    rows = rows.withColumn("_key", seeded_key(*[F.col(k) for k in keys], seed=seed))
    ranked = hot_safe_rank(rows, ["_stratum"], "_key", list(keys))
    ranked = ranked.withColumn("_odd", 2 * F.col("_rank") - 1).withColumn(
        "_place", F.expr(f"(_odd * {RANGES}) div (2 * _of)").cast("int")
    )
    # rows of a source of n rows before range b: ranks r with (2r-1) * RANGES < 2 * n * b
    sizes = rows.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_n"))
    steps = sizes.select("_n", F.explode(F.sequence(F.lit(0), F.lit(RANGES))).alias("_place"))
    below = steps.select(
        "_place", F.expr(f"if(_place = 0, 0L, ((2 * _n * _place - 1) div {RANGES} + 1) div 2)").alias("_below")
    )
    starts = below.groupBy("_place").agg(F.sum("_below").alias("_start"))
    whole = Window.partitionBy(F.lit(0)).orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = starts.withColumn("_all", F.max("_start").over(whole))  # RANGES + 1 rows at any input size
    within = Window.partitionBy("_place").orderBy(F.col("_odd") / (2 * F.col("_of")), "_stratum", "_key", *keys)
    placed = ranked.withColumn("_row", F.row_number().over(within)).join(starts, "_place")
    placed = placed.withColumn("_at", F.col("_start") + F.col("_row") - 1)
    placed = placed.withColumn("shard", F.expr(f"(_at * {shards}) div _all").cast("int"))
    placed = placed.withColumn("slot", F.col("_at") - F.expr(f"(shard * _all + {shards - 1}) div {shards}"))
    helpers = [c for c in placed.columns if c.startswith("_") and c not in docs.columns]
    return placed.drop(*helpers)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` in 40 shards: doc_id, size, text_crc32, law, shard, slot, grown_shard, source."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", text_size().alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32")
    )
    out = stratified_shards(docs, keys=("doc_id", "size"))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write whole rows as one folder per shard, each in slot order."""
    out = stratified_shards(docs, **options)
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


ORACLE_SQL = """
with crc_table as (
  select list(c order by i) as t from (
    select i, list_reduce([i::ubigint, 0,0,0,0,0,0,0,0], lambda a, b: xor(a >> 1, case when a & 1 = 1 then 3988292384::ubigint else 0::ubigint end)) as c
    from range(256) r(i))),
bytes as (
  select doc_id, source, coalesce(octet_length(encode(text)), 0) + 16 as size, text from documents),
crcs as (
  select b.*, case when text is null then null
      when text = '' then 0
      else xor(list_reduce(
        list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::ubigint),
        lambda a, x: xor(a >> 8, t[(xor(a, x) & 255)::int + 1]), 4294967295::ubigint), 4294967295::ubigint)::bigint end as text_crc32
  from bytes b, crc_table),
keyed as (
  select doc_id, source, size, text_crc32, coalesce('s' || source, 'null') as stratum,
    md5(concat_ws(':', coalesce(doc_id::varchar, chr(0)), size::varchar, '5')) as k from crcs),
ranked as (
  select *, row_number() over (partition by stratum order by k, doc_id, size) as r,
    count(*) over (partition by stratum) as n, count(*) over () as total from keyed),
placed as (
  select *, row_number() over (order by ((2*r-1) * 4096) // (2*n), (2*r-1)::double / (2*n), stratum, k, doc_id, size) - 1 as place from ranked),
cut as (select *, (place * 40) // total as shard from placed)
select doc_id, size::bigint as size, text_crc32, 'rows' as law, shard::int as shard,
  (place - (shard * total + 39) // 40)::bigint as slot, null::int as grown_shard, source
from cut
"""
