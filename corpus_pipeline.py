"""A training corpus from `documents` in five stages, each a written table that the next one reads.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`. Low-quality documents go, one document of each group of near duplicates stays, documents
that hold a benchmark item go, sources are replicated or thinned to their target weights, and what is
left is dealt out to shards that all match the mixture.

Rows with a null or repeated doc_id, a null or empty text or a null source are rows like others: the
classifier scores them by their own text, rows without words are in no group and leak nothing, rows that
repeat in full are one group and otherwise one row each, and null sources are a source that no target
names. Texts are read whole, however long. An empty table stays empty. Further columns pass through all
stages as they are, whatever their names, except that the last stage replaces `shard` and `slot`, and keeps
names that start with `_` for itself.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill.llm.decontam import decontaminated
from citemill.llm.mixing import OTHER, TARGETS, mixture
from citemill.llm.neardup import without_near_duplicates
from citemill.llm.quality import without_rejected
from citemill.llm.sharding import SHARDS, stratified_shards
from citemill.runtime import materialize, release, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_rejected(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture(docs, TARGETS, OTHER)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # copies of a document are numbered, so that each has its own place in the shuffle; places are found for these
    # keys alone, and whole rows then meet theirs
    alike = Window.partitionBy("source", "doc_id", "_crc").orderBy("lang", "n_chars")
    rows = docs.withColumn("_crc", F.crc32(F.col("text").cast("binary"))).withColumn("_nth", F.row_number().over(alike))
    keys = ("source", "doc_id", "_crc", "_nth")
    placed = stratified_shards(rows.select(*keys), SHARDS, keys=keys[1:])
    placed = placed.select(*[F.col(k).alias(f"_at_{k}") for k in keys], "shard", "slot")
    met = rows.drop("shard", "slot").join(placed, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys]))
    return met.drop("_crc", "_nth", *[f"_at_{k}" for k in keys])


STAGES = [
    ("quality classifier", quality),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: No SQL: the classifier and the near-duplicate groups can't be expressed in it; `tests/llm/test_pipeline.py`
#: compares every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`: its columns, shard and slot."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = written()
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k}")
        release(before, but_last=True)  # what the stage wrote on its way
    return docs
