"""Operator 6, line dedup by a deletion-neighbourhood join. Main path: DataFrame functions only.

Lines are trimmed; blank lines are layout and always stay. Of equal lines the earliest stays, in the
order of (doc_id, line number); of different lines, one goes if an earlier one lies within one edit
(insertion, deletion or substitution of a character). Different lines are first narrowed without loss:
if two strings are within one edit, they share their first or their last half, so a line with neither
in common with another has no partner; and where they share one half, the edit lies in the other, so
only the rest counts, which is halved again until `REST` characters are left. Then every deletion
variant of the rest is emitted as a hashed key: with its place, equal keys are one substitution apart,
and a variant that equals a whole rest is one insertion apart. No pairs are made: a key's earliest line
is the only partner that matters to the others. Partners are verified with `levenshtein`.

Null texts have no lines. A null doc_id comes last. Rows that repeat in full count as one document and
each get its result; rows that only share an id are ordered by a hash of their text. An empty table
gives an empty result. Extra columns don't matter, or pass through `deduplicated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill.runtime import materialize, table

#: The edit bound. Halving without loss and the variants with one character left out are both made for it.
EDITS = 1
REST = 48
PARTS = ("p0", "p1", "p2", "p3")
#: Keys of 8 bytes that are sent to all executors at most.
SMALL_IDS = 2_000_000


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, version (hash of the text), line (number from 0), s (trimmed) of every line that isn't blank."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("line", "s"))
    return rows.withColumn("s", F.trim("s")).where("s <> ''")


def _when() -> Column:
    """The order of first uses, as a struct whose minimum is the earliest."""
    return F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "version", "line")


def _halves(context: Column, s: Column) -> Column:
    """Keys of the halves of `s` within a context, with the rest that each leaves.

    Two strings within one edit, n the shorter's length, share their first or last n div 2 characters;
    a string may be the shorter or the longer one of a pair, hence two sizes of half.
    """
    n = F.char_length(s)
    short, long = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    out = []
    for half, wanted in ((short, F.lit(True)), (long, long != short)):
        first, last = F.substring(s, F.lit(1), half), F.substring(s, n - half + 1, half)
        for side, (shared, at) in enumerate(((first, half + 1), (last, F.lit(1)))):
            key = F.xxhash64(context, F.lit(side), half, shared)
            out.append(F.when(wanted, F.struct(key.alias("context"), at.cast("int").alias("at"), (n - half).alias("size"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _half_keys(s: str) -> list[Column]:
    """The keys of the halves of a column, null where the two sizes of half are the same: plain expressions, which are compiled,
    for the one pass over all lines."""
    n = F.char_length(s)
    short, long = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    keys = [F.xxhash64(F.lit(side), half, F.substring(s, F.lit(1) if side == 0 else n - half + 1, half)) for half in (short, long) for side in (0, 1)]
    return [*keys[:2], *[F.when(long != short, k) for k in keys[2:]]]


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose context holds more than one line."""
    groups = rows.groupBy("context").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("context")
    return rows.join(groups, "context", "left_semi")


def near_lines(first_uses: DataFrame, lines: DataFrame) -> DataFrame:
    """(h, partner): lines with an earlier line within one edit, of (h, h2, when, p0 to p3) and where to find their text."""
    parts = first_uses.select("h", F.explode(F.array(*PARTS)).alias("context")).where("context is not null").distinct()
    wanted = materialize(_shared(parts), "halves")
    ids = wanted.select("h").distinct()
    known = first_uses.join(ids, "h", "left_semi").select("h", "when")
    known = materialize(known, "known")
    places = known.select("h", F.col("when.doc_id").alias("doc_id"), F.col("when.version").alias("version"), F.col("when.line").alias("line"))
    docs = places.select("version").distinct()
    small = docs.count() <= SMALL_IDS
    found = lines.join(F.broadcast(docs) if small else docs, "version", "left_semi").withColumn("h", F.xxhash64("s"))
    found = found.join(places.select("h", "version", "line"), ["h", "version", "line"], "left_semi")
    texts = materialize(found.groupBy("h").agg(F.first("s").alias("s")), "texts")

    start = texts.select("h", F.col("s").alias("rest"), F.explode(_halves(F.lit(0), F.col("s"))).alias("p"))
    step = start.select("h", "p.context", F.col("rest").substr(F.col("p.at"), F.col("p.size")).alias("rest"))
    rows = materialize(_shared(step), "rests")
    done = None
    while True:
        # strings of a context may differ in length by one: those of REST + 1 meet shorter and longer ones
        fine = rows.where(F.char_length("rest") <= REST + 1)
        done = fine if done is None else done.unionByName(fine)
        rows = rows.where(F.char_length("rest") > REST)
        if not rows.limit(1).count():
            break
        cut = rows.select("h", "rest", F.explode(_halves(F.col("context"), F.col("rest"))).alias("p"))
        cut = cut.select("h", "p.context", F.col("rest").substr(F.col("p.at"), F.col("p.size")).alias("rest"))
        rows = materialize(_shared(cut), "rests")

    n = F.char_length("rest")
    places_ = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    without = lambda i: F.concat(F.substring("rest", F.lit(1), i - 1), F.substring("rest", i + 1, n))
    keys = F.concat(
        F.transform(places_, lambda i: F.struct(F.xxhash64("context", F.lit(0), n, i, without(i)).alias("key"), F.lit(0).alias("role"))),
        F.transform(places_, lambda i: F.struct(F.xxhash64("context", F.lit(1), without(i)).alias("key"), F.lit(1).alias("role"))),
        F.array(F.struct(F.xxhash64("context", F.lit(1), F.col("rest")).alias("key"), F.lit(2).alias("role"))),
    )
    variants = done.distinct().select("h", F.explode(keys).alias("k")).select("h", "k.key", "k.role").distinct()
    variants = variants.join(known, "h")
    by_key = Window.partitionBy("key")
    least = [F.min(F.when(F.col("role") == r, F.struct("when", "h"))).over(by_key) for r in range(3)]
    met = variants.withColumns({f"m{r}": m for r, m in enumerate(least)})
    met = met.withColumn("m", F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1")))
    pairs = met.where("m is not null and m.when < when").select("h", "when", F.col("m.h").alias("partner"), F.col("m.when").alias("since")).distinct()
    both = pairs.join(texts, "h").join(texts.select(F.col("h").alias("partner"), F.col("s").alias("t")), "partner")
    both = both.where(F.levenshtein("s", "t", EDITS) == EDITS)
    return both.groupBy("h").agg(F.min_by("partner", "since").alias("partner"))


def kept_lines(docs: DataFrame) -> DataFrame:
    """doc_id, version, line and size of every line that isn't blank and stays, and per document what went.

    One row per document version that loses or keeps such lines: doc_id, version, kept (line numbers),
    kept_chars, near (lines that went although no equal line came before).
    """
    lines = _lines(docs)
    keyed = lines.select(
        F.xxhash64("s").alias("h"),
        F.xxhash64(F.lit(1), F.col("s")).alias("h2"),
        F.char_length("s").alias("size"),
        *[k.alias(p) for k, p in zip(_half_keys("s"), PARTS, strict=True)],
        _when().alias("when"),
    )
    first_uses = materialize(keyed.groupBy("h", "h2", "size", *PARTS).agg(F.min("when").alias("when")), "lines")
    gone = materialize(near_lines(first_uses, lines).select("h"), "gone")
    gone = gone.withColumn("near", F.lit(1))
    marked = first_uses.join(F.broadcast(gone) if gone.count() <= SMALL_IDS else gone, "h", "left")
    stays = F.col("near").isNull()
    return marked.groupBy(F.col("when.doc_id").alias("doc_id"), F.col("when.version").alias("version")).agg(
        F.collect_list(F.when(stays, F.col("when.line"))).alias("kept"),
        F.sum(F.when(stays, F.col("size")).otherwise(0)).alias("kept_chars"),
        F.count("near").alias("near"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """`docs` with the lines that go cut out of `text`; blank lines stay."""
    kept = kept_lines(docs).select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.col("kept").alias("_kept"))
    rows = docs.withColumn("_hash", F.xxhash64("text"))
    rows = rows.join(kept, rows["doc_id"].cast("long").eqNullSafe(kept["_id"]) & (rows["_hash"] == kept["_version"]), "left")
    stay = F.filter(F.split("text", "\n"), lambda s, i: (F.trim(s) == "") | F.coalesce(F.array_contains("_kept", i), F.lit(False)))
    return rows.withColumn("text", F.when(F.col("text").isNotNull(), F.array_join(stay, "\n"))).drop("_id", "_version", "_kept", "_hash")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `documents`: doc_id, n_lines (not blank), n_kept, n_near (went for an edit), kept_chars."""
    docs = table(spark, sf_dir, "documents")
    full = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: F.trim(s) != ""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), full.alias("n_lines"))
    kept = kept_lines(docs).select(
        F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.size("kept").alias("_n"), "near", F.col("kept_chars").alias("_chars")
    )
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_id"]) & (rows["version"] == kept["_version"]), "left")
    return rows.select(
        "doc_id",
        "n_lines",
        F.coalesce("_n", F.lit(0)).alias("n_kept"),
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce("_chars", F.lit(0)).cast("long").alias("kept_chars"),
    )


ORACLE_SQL = """
with l as (
  select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line, trim(unnest(string_split(text, chr(10))), ' ') as s from documents),
used as (select * from l where s <> ''),
firsts as (select s, length(s) as n, min((doc_id, line)) as since from used group by s),
keys as (
  select s, n, since, unnest([n // 2, (n - 1) // 2]) as h from firsts),
halves as (
  select distinct s, n, since, h, side, case when side = 0 then left(s, h) else right(s, h) end as part
  from keys, (values (0), (1)) t(side)),
near as (
  select distinct a.s from halves a join halves b
  on a.h = b.h and a.side = b.side and a.part = b.part and abs(a.n - b.n) <= 1 and a.s <> b.s and b.since < a.since
  where len(list_filter(range(0, least(a.n, b.n) + 1), lambda k: left(a.s, k) = left(b.s, k) and (
    (a.n = b.n and substr(a.s, k + 2) = substr(b.s, k + 2)) or (a.n = b.n + 1 and substr(a.s, k + 2) = substr(b.s, k + 1))
    or (a.n + 1 = b.n and substr(a.s, k + 1) = substr(b.s, k + 2))))) > 0),
marked as (select f.*, near.s is not null as gone from firsts f left join near on f.s = near.s),
per as (
  select since[1] as doc_id, count(*) filter (where not gone) as n_kept, count(*) filter (where gone) as n_near,
    coalesce(sum(n) filter (where not gone), 0) as kept_chars from marked group by 1)
select d.doc_id, (select count(*) from used u where u.doc_id = d.doc_id)::int as n_lines, coalesce(p.n_kept, 0)::int as n_kept,
  coalesce(p.n_near, 0)::bigint as n_near, coalesce(p.kept_chars, 0)::bigint as kept_chars
from documents d left join per p using (doc_id)
"""
