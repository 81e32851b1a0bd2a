"""Operator 8, mixing sources to target weights by Poisson replication. Main path: DataFrame functions only.

A source with weight w and n of the table's N rows gets the mean repetition rate w * N / n. Each row's
count is the inverse of the Poisson distribution of that mean at a uniform number hashed from the row
and the seed, so a rate of 2.5 gives 2.5 copies on average, rates below one thin a source, and the same
row gets the same count on every run. A rate of over `AT_ONCE` is cut into equal parts, and the count is
the sum of one draw a part, each with its own hash, which is Poisson of the whole rate. Copies are then
put in a global random order: every copy has its own hashed key, and its position is its exact rank.

The weights are configuration: a dictionary of a size that doesn't depend on the data. Sources that it
doesn't name share `other` in proportion to their rows (0: they go). Null sources count as unnamed.
Null or empty texts are rows like others. Rows without an id and rows that share an id are told apart by
a hash of their source and text, which joins the id in their seeds. Rows that repeat in full get equal
counts. An empty table gives an empty result. Extra columns pass through; names starting with `_` are
reserved. `mixture` returns the columns it was given as they were, whatever their names; the functions that
add `copy` or `position` put it in the place of an input column of that name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm.ranking import hot_safe_rank, seeded_key
from citemill.llm.rows import small
from citemill.runtime import materialize, table

SEED = 8
#: The mixture of the query: ten sources raised or lowered, the others keep what is left.
TARGETS = {f"src{i}": w for i, w in enumerate((0.10, 0.08, 0.08, 0.06, 0.06, 0.06, 0.04, 0.04, 0.04, 0.04))}
OTHER = 0.40
#: The inversion stops where the upper tail is below what 52 bits of hash can reach.
TAIL = 2.0**-52
#: The largest rate of one draw; exp(-rate) is far from underflow there.
AT_ONCE = 600.0
#: Copies of a row that are made from one array.
RUN = 1 << 16


def poisson_steps(rate: float) -> list[float]:
    """Cumulated Poisson probabilities P(X <= k) for k = 0, 1, ... until the tail is out of reach."""
    steps, k, term = [], 0, math.exp(-rate)
    total = term
    while True:
        steps.append(total)
        if k > rate and term < TAIL:
            return steps
        k += 1
        term = term * rate / k
        total += term


def draws_of(rate: float) -> int:
    """Draws of `AT_ONCE` at most that make up a rate."""
    return max(1, math.ceil(rate / AT_ONCE))


def step_array(rate: float) -> Column:
    """The steps of one draw of the rate."""
    return F.array(*[F.lit(x) for x in poisson_steps(rate / draws_of(rate))])


def uniform(key: Column) -> Column:
    """52 bits of a hexadecimal key as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def repetition_rates(counts: dict[str, int], total: int, targets: dict[str, float], other: float) -> tuple[dict[str, float], float]:
    """Mean copies of a row of each named source, and of a row of any other."""
    rest = total - sum(counts.values())
    named = {s: (w * total / counts[s] if counts.get(s) else 0.0) for s, w in targets.items()}
    return named, (other * total / rest if rest else 0.0)


def content(source: str = "source", text: str = "text") -> Column:
    """A hash of a row's source and text; nulls count as values of their own."""
    return F.xxhash64(F.coalesce(source, F.lit("\x00")), F.coalesce(text, F.lit("\x00")))


def told_apart(docs: DataFrame, version: Column) -> DataFrame:
    """Add `_id`: the doc_id as text where rows of one `version` only have it, else the doc_id and the version."""
    rows = docs.withColumn("_version", version)
    met = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("_version").alias("_least"), F.max("_version").alias("_most"))
    shared = small(materialize(met.where("_least <> _most").select(F.col("doc_id").alias("_shared")), "shared_ids"))
    # rows without an id are dealt by version if the join is shuffled; should they meet an id, nothing changes
    rows = rows.join(shared, F.coalesce("doc_id", "_version") == F.col("_shared"), "left")
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00"))
    alone = F.col("doc_id").isNotNull() & F.col("_shared").isNull()
    return rows.withColumn("_id", F.when(alone, id_).otherwise(F.concat_ws(":", id_, "_version"))).drop("_shared", "_version")


def poisson_replicate(
    docs: DataFrame,
    targets: dict[str, float],
    other: float = 0.0,
    seed: int = SEED,
    source: str = "source",
    keys: tuple[str, ...] | None = None,
    copy: str = "copy",
) -> DataFrame:
    """`docs` with each row as often as its Poisson count says, plus the column `copy` (0-based).

    `keys` are the columns that tell rows apart; by default doc_id, source and text do.
    """
    if keys is None:
        return poisson_replicate(told_apart(docs, content(source)), targets, other, seed, source, ("_id",), copy).drop("_id")
    named = docs.where(F.col(source).isin(*targets)).groupBy(source).count()
    counts = {r[0]: r[1] for r in named.collect()}  # one row per configured source
    rates, rest = repetition_rates(counts, docs.count(), targets, other)
    steps, draws = step_array(rest), F.lit(draws_of(rest))
    for name, rate in rates.items():
        steps = F.when(F.col(source) == name, step_array(rate)).otherwise(steps)
        draws = F.when(F.col(source) == name, draws_of(rate)).otherwise(draws)
    parts = [F.col(k) for k in keys]
    rows = docs.withColumn("_u", uniform(seeded_key(*parts, seed=seed))).withColumn("_steps", steps)

    def drawn(u: Column) -> Column:
        return F.size(F.filter("_steps", lambda c: c < u))

    if max(rest, *rates.values(), 0.0) <= AT_ONCE:
        rows = rows.withColumn("_times", drawn(F.col("_u")))
        rows = rows.where("_times > 0").drop("_steps", "_u")
        return rows.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col("_times") - 1))).drop("_times")
    more = F.aggregate(F.sequence(F.lit(1), F.col("_draws")), F.lit(0), lambda n, i: n + drawn(uniform(seeded_key(*parts, F.lit("draw"), i, seed=seed))))
    rows = rows.withColumn("_draws", draws).withColumn("_times", F.when(F.col("_draws") == 1, drawn(F.col("_u"))).otherwise(more))
    rows = rows.where("_times > 0").drop("_steps", "_u", "_draws")
    rows = rows.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_times") - 1, F.lit(RUN))))
    rows = rows.withColumn(copy, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (RUN - 1), F.col("_times") - 1))))
    return rows.drop("_from", "_times")


def global_shuffle(rows: DataFrame, keys: tuple[str, ...], seed: int = SEED) -> DataFrame:
    """Add `position`, the row's exact place in a seeded random order of all rows.

    `keys` should tell rows apart; rows equal in them are interchangeable. The result is dealt and
    sorted by key range, so files written from it are in random order too.
    """
    keyed = rows.withColumn("_key", seeded_key(*[F.col(k) for k in keys], F.lit("order"), seed=seed)).withColumn("_whole", F.lit(0))
    ranked = hot_safe_rank(keyed, ["_whole"], "_key", list(keys))
    return ranked.withColumn("position", F.col("_rank") - 1).drop("_key", "_whole", "_rank", "_of")


def mixture(docs: DataFrame, targets: dict[str, float], other: float = 0.0, seed: int = SEED) -> DataFrame:
    """`docs` replicated to the target weights, dealt and sorted in a seeded random order of all copies."""
    copies = poisson_replicate(told_apart(docs, content()), targets, other, seed, keys=("_id",), copy="_copy")
    ordered = copies.orderBy(seeded_key(F.col("_id"), F.col("_copy"), F.lit("order"), seed=seed), "_id", "_copy")
    return ordered.select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all `documents`: doc_id, source, copy, n_bytes (of the text), position."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", size, content().alias("_content"))
    mixed = poisson_replicate(told_apart(docs, F.col("_content")), TARGETS, OTHER, keys=("_id",)).drop("_content")
    return global_shuffle(mixed, ("_id", "copy")).select("doc_id", "source", "copy", "n_bytes", "position")


_WEIGHTS = ", ".join(f"('{s}', {w!r})" for s, w in TARGETS.items())
ORACLE_SQL = f"""
with recursive targets(source, w) as (values {_WEIGHTS}),
sizes as (
  select coalesce(t.source, '') as name, any_value(coalesce(t.w, {OTHER!r})) as w, count(*) as n, (select count(*) from documents) as total
  from documents d left join targets t on d.source = t.source group by 1),
steps(name, rate, k, term, cdf) as (
  select name, w * total / n, 0, exp(-(w * total / n)), exp(-(w * total / n)) from sizes
  union all
  select name, rate, k + 1, term * rate / (k + 1), cdf + term * rate / (k + 1) from steps where not (k > rate and term < pow(2.0, -52))),
drawn as (
  select d.doc_id, d.source, coalesce(octet_length(encode(d.text)), 0) as n_bytes, coalesce(t.source, '') as name,
    ('0x' || md5(concat_ws(':', coalesce(d.doc_id::varchar, chr(0)), '{SEED}'))[1:13])::bigint / pow(2.0, 52) as u
  from documents d left join targets t on d.source = t.source),
times as (
  select doc_id, any_value(source) as source, any_value(n_bytes) as n_bytes, count(*) filter (where cdf < u) as times
  from drawn join steps using (name) group by doc_id),
copies as (select doc_id, source, n_bytes, unnest(range(times))::int as copy from times),
keyed as (select *, md5(concat_ws(':', coalesce(doc_id::varchar, chr(0)), copy::varchar, 'order', '{SEED}')) as k from copies)
select doc_id, source, copy, n_bytes::int as n_bytes, (row_number() over (order by k, doc_id, copy) - 1)::bigint as position from keyed
"""
