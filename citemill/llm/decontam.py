"""Operator 2, benchmark decontamination by spaced seeds. Main path: DataFrame functions only.

Tokens are lower-cased words. A benchmark item of 13 or more tokens is leaked into a document if some
13 consecutive tokens of it meet 13 of the document with at most 2 substituted; an item of 8 to 12
tokens if it occurs with at most 1 substituted, a shorter one if it occurs exactly. Items of under five
tokens, which hold no mask, are looked up by their whole sequence; as such a sequence often occurs by chance,
`decontaminated` removes no document for it alone unless told to. Two fixed masks of five tokens, `11111` and
`1110011`, are hashed at every position of both sides. For each length from five and every choice of
substituted places one of the masks fits in between, so every leak has a seed in common (tests try all
choices). Seeds that meet give an alignment; the aligned tokens are then compared and counted.

The benchmark's seeds are sent to all executors if there are at most `SMALL_SEEDS` of them, 40 bytes
each, else the join is shuffled. Documents with a hit are fetched again by a hash of id and text; texts
are not shuffled unless a great many documents have hits. A null doc_id takes part as an id of its own.
Null and empty texts leak nothing, null items are skipped, rows that share an id count as one document,
repeated items each as themselves. Empty tables give an empty result. Extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm.rows import row_key, small, without
from citemill.runtime import materialize, table

MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 5, 6))
SPAN = 7
WINDOW, LEAST_TOKENS = 13, 5
SMALL_SEEDS = 500_000


def tokens(text: str = "text") -> Column:
    """Hashes of the lower-cased words of a text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, id_col: str) -> DataFrame:
    """(id_col, at, seed): the hash of each mask at each position of `h`, where it fits."""
    shifted = [F.slice("h", i + 1, F.size("h")).alias(f"h{i}") for i in range(SPAN)]
    zipped = rows.select(id_col, F.posexplode(F.arrays_zip(*shifted)).alias("at", "w"))
    keys = [
        F.when(F.col(f"w.h{mask[-1]}").isNotNull(), F.xxhash64(F.lit(k), *[F.col(f"w.h{i}") for i in mask])) for k, mask in enumerate(MASKS)
    ]
    return zipped.select(id_col, "at", F.explode(F.array(*keys)).alias("seed")).where("seed is not null")


def allowed(n: Column) -> Column:
    """Substitutions that are allowed in a window of an item of n tokens."""
    return F.when(n >= WINDOW, 2).when(n >= 8, 1).otherwise(0)


def _short(rows: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """The columns of `leaks` for items of one to `LEAST_TOKENS` - 1 tokens, by their exact sequences."""
    items = benchmark.select("item_id", tokens().alias("h")).withColumn("n", F.size("h")).where(F.col("n").between(1, LEAST_TOKENS - 1))
    items = materialize(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "n", F.xxhash64("h").alias("sequence")), "short")
    lengths = sorted(r.n for r in items.select("n").distinct().collect())  # LEAST_TOKENS - 1 at most
    if not lengths:
        return None
    whole = rows.select("row", "doc_id", tokens().alias("h"))

    def sequences(n: int) -> Column:
        at = F.when(F.size("h") >= n, F.sequence(F.lit(1), F.size("h") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(F.slice("h", i, n)).alias("sequence"))))

    found = whole.select("row", "doc_id", F.explode(F.concat(*[sequences(n) for n in lengths])).alias("s")).select("row", "doc_id", "s.n", "s.sequence")
    met = found.join(F.broadcast(items) if items.count() <= SMALL_SEEDS else items, ["n", "sequence"])
    return met.groupBy("row", "doc_id", "item", "item_id").agg(F.max("n").alias("window")).withColumn("matched", F.col("window")).drop("item")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, doc_id, item_id, window, matched): the best window of every row (its key) and item that leaks."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text")
    long, short = _long(rows, benchmark), _short(rows, benchmark)
    return long if short is None else long.unionByName(short)


def _long(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    items = benchmark.select("item_id", tokens().alias("h")).where(F.size("h") >= LEAST_TOKENS)
    items = items.withColumn("item", F.monotonically_increasing_id())
    items = materialize(items, "items")
    wanted = materialize(seeds(items, "item").withColumnRenamed("at", "item_at"), "seeds")
    found = seeds(rows.select("row", tokens().alias("h")), "row")
    hits = found.join(F.broadcast(wanted) if wanted.count() <= SMALL_SEEDS else wanted, "seed")
    hits = hits.select("row", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = materialize(hits, "hits")

    texts = rows.join(small(hits.select("row").distinct()), "row", "left_semi").dropDuplicates(["row"])
    texts = texts.select("row", "doc_id", tokens().alias("h"))
    met = hits.join(texts, "row").join(items.select("item", "item_id", F.col("h").alias("b")), "item")
    size = F.least(F.size("b"), F.lit(WINDOW))
    same = F.transform("b", lambda t, i: F.when(F.get(F.col("h"), i + F.col("shift")) == t, 1).otherwise(0))
    met = met.withColumns({"window": size, "need": size - allowed(F.size("b"))}).withColumn("same", same)
    best = F.array_max(
        F.transform(
            F.sequence(F.lit(1), F.size("same") - F.col("window") + 1),
            lambda s: F.aggregate(F.slice("same", s, F.col("window")), F.lit(0), lambda a, x: a + x),
        )
    )
    met = met.where(F.aggregate("same", F.lit(0), lambda a, x: a + x) >= F.col("need")).withColumn("matched", best).where("matched >= need")
    return met.groupBy("row", "doc_id", "item", "item_id").agg(F.max("window").alias("window"), F.max("matched").alias("matched")).drop("item")


def decontaminated(docs: DataFrame, benchmark: DataFrame, least_window: int = LEAST_TOKENS) -> DataFrame:
    """The rows of `docs` that leak no benchmark item in a window of `least_window` tokens or more."""
    found = leaks(docs, benchmark).where(F.col("window") >= least_window)
    return without(docs, materialize(found.select("row").distinct(), "leaky"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a `benchmark` item in `documents`: doc_id, item_id, window (tokens), matched (of them)."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("window").alias("window"), F.max("matched").alias("matched"))


ORACLE_SQL = """
with d as (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as h from documents),
b as (
  select item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as h from benchmark),
bt as (select item_id, len(h) as n, least(len(h), 13) as win, generate_subscripts(h, 1) as j, unnest(h) as w from b where len(h) >= 1),
dt as (select doc_id, generate_subscripts(h, 1) as i, unnest(h) as w from d),
same as (select distinct doc_id, item_id, n, win, i - j as shift, j from dt join bt using (w)),
diag as (
  select doc_id, item_id, n, win, shift, list(j order by j) as js from same group by all
  having count(*) >= win - case when n >= 13 then 2 when n >= 8 then 1 else 0 end),
starts as (select *, unnest(range(1, n - win + 2)) as s from diag),
scored as (
  select doc_id, item_id, n, win, len(list_filter(js, lambda j: j >= s and j < s + win)) as matched from starts)
select doc_id, item_id, max(win)::int as "window", max(matched)::int as matched from scored
where matched >= win - case when n >= 13 then 2 when n >= 8 then 1 else 0 end
group by doc_id, item_id
"""
