"""Deduplication of bibliographic records: match keys, ordered merge and reference resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citemill.functions import text as fx
from citemill.operators.components import connected_components


#: A merged record takes these keys of a newcomer where it has none of its own; its title and id stay.
SINGLE = ("doi", "arxiv")


def match_slots(doi: Column, arxiv: Column, title: Column, own_id: Column, native: Column) -> Column:
    """All keys of a record as (slot, key), most reliable first: DOI, arXiv, title, own id, native ids by name space."""
    ids = F.transform(F.map_entries(F.coalesce(native, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.concat(F.lit("native:"), e["key"]).alias("slot"), F.concat(e["key"], F.lit(":"), F.nullif(e["value"], F.lit(""))).alias("key")))
    reliable = F.transform(fx.dedup_keys(doi, arxiv, title), lambda k: F.struct(F.substring_index(k, ":", 1).alias("slot"), k.alias("key")))
    own = F.array(F.struct(F.lit("id").alias("slot"), own_id.alias("key")))
    return F.filter(F.concat(reliable, own, ids), lambda x: x["key"].isNotNull() & (x["key"] != ""))


def match_keys(doi: Column, arxiv: Column, title: Column, own_id: Column, native: Column) -> Column:
    """The different keys of `match_slots`, in its order."""
    return F.array_distinct(F.transform(match_slots(doi, arxiv, title, own_id, native), lambda x: x["key"]))


def clusters(records: DataFrame, seq: str = "ingest_seq", keys: str = "keys") -> DataFrame:
    """(ingest_seq, cluster): records that share a key, transitively; a cluster is its earliest record.

    A key links each record to the first one that has it, a star instead of all pairs, so a key that a
    third of the records share costs one link a record.
    """
    exploded = records.select(F.col(seq).alias("seq"), F.explode(keys).alias("key"))
    first = exploded.groupBy("key").agg(F.min("seq").alias("first"))
    links = exploded.join(first, "key").where("seq <> first").select(F.col("seq").alias("a"), F.col("first").alias("b"))
    label = connected_components(links)
    return records.select(F.col(seq).alias("seq")).join(label.withColumnRenamed("id", "seq"), "seq", "left").select("seq", F.coalesce("component", "seq").alias("cluster"))


#: How a merged record gets each of its fields, apart from its id and title, which are the earliest record's.
LONGEST_TEXT, LONGEST_LIST = ("abstract",), ("authors",)
FIRST_TEXT, FIRST_KNOWN = ("venue", "doi", "arxiv_id", "url"), ("year", "relevance_score")
UNITED = ("sources", "keywords", "references", "citations")


def _placed(field: str):
    def element(value: Column, place: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), value.cast("string").alias("key"), F.lit(None).cast("string").alias("value"), place.alias("place"))

    return element


def _entry(field: str):
    return lambda e: F.struct(F.lit(field).alias("field"), e["key"].alias("key"), e["value"].alias("value"), F.lit(0).alias("place"))


def merged(records: DataFrame, cluster: DataFrame) -> DataFrame:
    """One row per cluster, field by field, of the fields that `records` has.

    The earliest record's id and title; the longest abstract and author list (earliest on ties); the first
    venue, DOI, arXiv id and url that isn't empty; the first known year and score; the largest citation count;
    `external_ids` with the earliest value of each name space; the other lists' ordered distinct union.
    Lists are united value by value first, so a cluster of any size costs a partial aggregate and one row for
    each of its different values.
    """
    rows = records.join(cluster.withColumnRenamed("seq", "ingest_seq"), "ingest_seq")
    has = set(records.columns)
    earlier = -F.col("ingest_seq")

    def longest(c: str, size: Column) -> Column:
        return F.max_by(c, F.struct(size.alias("n"), earlier.alias("s"))).alias(c)

    def first(c: str, known: Column) -> Column:
        return F.min_by(c, F.when(known, F.col("ingest_seq"))).alias(c)

    fields = [F.min_by(c, "ingest_seq").alias(c) for c in ("id", "title") if c in has]
    fields += [longest(c, F.length(F.coalesce(c, F.lit("")))) for c in LONGEST_TEXT if c in has]
    fields += [longest(c, F.greatest(F.size(c), F.lit(0))) for c in LONGEST_LIST if c in has]
    fields += [first(c, F.col(c) != "") for c in FIRST_TEXT if c in has]
    fields += [first(c, F.col(c).isNotNull()) for c in FIRST_KNOWN if c in has]
    fields += [F.max("citation_count").alias("citation_count")] if "citation_count" in has else []
    whole = rows.groupBy("cluster").agg(*fields, F.count(F.lit(1)).alias("n_records"))
    lists = [c for c in UNITED if c in has]
    maps = ["external_ids"] if "external_ids" in has else []
    if not lists + maps:
        return whole
    value = [F.transform(F.col(c), _placed(c)) for c in lists] + [F.transform(F.map_entries(c), _entry(c)) for c in maps]
    none = F.array().cast("array<struct<field:string,key:string,value:string,place:int>>")
    each = rows.select("cluster", "ingest_seq", F.explode(F.concat(*[F.coalesce(v, none) for v in value])).alias("v"))
    seen = each.groupBy("cluster", "v.field", "v.key").agg(F.min(F.struct("ingest_seq", "v.place", "v.value")).alias("at"))
    held = seen.groupBy("cluster").agg(*[F.array_sort(F.collect_list(F.when(F.col("field") == c, F.struct("at", "key")))).alias(c) for c in lists + maps])
    held = held.select("cluster", *[F.transform(c, lambda x: x["key"]).alias(c) for c in lists], *[F.map_from_entries(F.transform(c, lambda x: F.struct(x["key"], x["at"]["value"]))).alias(c) for c in maps])
    out = whole.join(held, "cluster", "left")
    empty = {c: F.coalesce(c, F.array().cast("array<string>")) for c in lists} | {c: F.coalesce(c, F.create_map().cast("map<string,string>")) for c in maps}
    return out.withColumns(empty)


def first_match(records: DataFrame, cluster: DataFrame) -> DataFrame:
    """(ingest_seq, survivor): the ordered fold over `slots`, in which a record joins the cluster of its first known key.

    A cluster's record takes a newcomer's DOI, arXiv id and native ids where it has none, keeps its own title
    and id, and registers all keys that it then has anew, taking over those that another cluster held. Keys that
    it doesn't take are not known afterwards. Transitive components bound what a fold must see together; within
    each, records go in order. The fold is sequential by nature: a component is folded by one task, which sees
    keys alone; use `clusters` where components can be very large.
    """
    import pandas as pd

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        owner: dict[str, int] = {}
        held: dict[int, dict[str, str]] = {}
        out = []
        for seq, slots in part.sort_values("ingest_seq")[["ingest_seq", "slots"]].itertuples(index=False):
            own = [(s["slot"], s["key"]) for s in slots]
            survivor = next((owner[k] for _, k in own if k in owner), seq)
            kept = held.setdefault(survivor, {} if survivor != seq else dict(own))
            kept.update((s, k) for s, k in own if s not in kept and (s in SINGLE or s.startswith("native:")))
            owner.update((k, survivor) for k in kept.values())
            out.append((seq, survivor))
        return pd.DataFrame(out, columns=["ingest_seq", "survivor"])

    rows = records.select("ingest_seq", "slots").join(cluster.withColumnRenamed("seq", "ingest_seq"), "ingest_seq")
    return rows.groupBy("cluster").applyInPandas(fold, "ingest_seq long, survivor long")


def resolve_references(refs: DataFrame, index: DataFrame) -> DataFrame:
    """(id, pos, ref, target): each reported reference with the record it names, or null.

    `refs` is (id, pos, ref); `index` is (key, target). A reference is tried as it is, as a DOI, and under
    each name space; the first that is known counts. References to oneself count as unresolved.
    """
    doi = fx.normalise_doi(F.col("ref"))
    spaces = ("s2", "openalex", "arxiv", "dblp", "crossref")
    tries = [F.col("ref"), F.when(doi != "", F.concat(F.lit("doi:"), doi))]
    tries += [F.when(~F.contains(F.col("ref"), F.lit(":")), F.concat(F.lit(s + ":"), "ref")) for s in spaces]
    candidates = refs.select("id", "pos", "ref", F.posexplode(F.array(*tries)).alias("prio", "key")).where("key is not null")
    met = candidates.join(index, "key", "left")
    return met.groupBy("id", "pos", "ref").agg(F.min_by("target", F.when(F.col("target").isNotNull(), F.col("prio"))).alias("t")).select(
        "id", "pos", "ref", F.when(F.col("t") != F.col("id"), F.col("t")).alias("target")
    )


def rewritten_references(papers: DataFrame, index: DataFrame, fields: tuple[str, ...] = ("references", "citations")) -> DataFrame:
    """`papers` with each of `fields` as ids of known papers (first mention first, each once), and `resolved` and `dropped`.

    Unknown references and those to the paper itself are dropped and counted, as are repeated mentions that resolve.
    """
    given = F.concat(*[F.transform(F.coalesce(c, F.array().cast("array<string>")), _placed(c)) for c in fields])
    each = papers.select("id", F.explode(given).alias("g")).select("id", F.concat_ws(":", "g.field", "g.place").alias("pos"), F.col("g.key").alias("ref"))
    met = resolve_references(each, index).withColumns({"field": F.substring_index("pos", ":", 1), "place": F.substring_index("pos", ":", -1).cast("int")})
    once = met.groupBy("id", "field", "target").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    known = F.col("target").isNotNull()
    lists = [F.transform(F.array_sort(F.collect_list(F.when(known & (F.col("field") == c), F.struct("place", "target")))), lambda x: x["target"]).alias(f"_{c}") for c in fields]
    per = once.groupBy("id").agg(*lists, F.sum(F.when(known, F.col("n")).otherwise(0)).alias("resolved"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("dropped"))
    rows = papers.join(per, "id", "left")
    none = F.array().cast("array<string>")
    return rows.withColumns({c: F.coalesce(f"_{c}", none) for c in fields} | {c: F.coalesce(c, F.lit(0)) for c in ("resolved", "dropped")}).drop(*[f"_{c}" for c in fields])


def source_yield(records: DataFrame) -> DataFrame:
    """(source, n): the records that each source reported, before they are merged."""
    return records.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def key_index(records: DataFrame, cluster: DataFrame, papers: DataFrame) -> DataFrame:
    """(key, target): every key of a record, with the id of the paper that its cluster became; the earliest has a key."""
    of = records.select(F.col("ingest_seq").alias("seq"), F.explode("keys").alias("key")).join(cluster, "seq")
    first = of.groupBy("key").agg(F.min_by("cluster", "seq").alias("cluster"))
    return first.join(papers.select("cluster", F.col("id").alias("target")), "cluster").select("key", "target")


def candidate_window(papers: DataFrame, cap: int) -> DataFrame:
    """The best three times `cap` papers: complete ones first, then most cited, then by id."""
    whole = (fx.text_or_empty(F.col("abstract")) != "") & F.col("year").isNotNull()
    return papers.orderBy(F.desc(whole), F.desc("citation_count"), "id").limit(cap * 3)


def trimmed(papers: DataFrame, cap: int, keep: int = 3) -> DataFrame:
    """Papers of relevance `keep` or more (unscored count as 3 here, as 0 in the order), best `cap`."""
    whole = (fx.text_or_empty(F.col("abstract")) != "") & F.col("year").isNotNull()
    passing = papers.where(F.coalesce(F.nullif("relevance_score", F.lit(0)), F.lit(3)) >= keep)
    return passing.orderBy(F.desc(F.coalesce("relevance_score", F.lit(0))), F.desc(whole), F.desc("citation_count"), "ingest_seq").limit(cap)


def first_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def last_per_key(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Upsert by reading: the latest row of each key wins."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


