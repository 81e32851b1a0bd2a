"""A whole build from captured payloads: records, papers, extractions, concepts, graph, each a written relation, and its events."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.functions import text as fx
from citemill.operators import boundary, dedup, graph, resolve
from citemill.operators.routing import Settings
from citemill.runtime import materialize
from citemill.sources import payloads as parsers
from citemill.sources import store
from citemill.streaming.fold import EVENT, event

#: What an extractor gives: see `boundary.extraction`.
Extractor = Callable[[DataFrame], DataFrame]


def offline_extractor(papers: DataFrame) -> DataFrame:
    """Facts without a model: keywords as concepts that a paper uses, and the limitation that the rules find."""
    used = F.transform("keywords", lambda k: F.struct(k.alias("name"), F.lit("").alias("description"), F.lit("uses").alias("role")))
    found = boundary.rule_extraction(papers)
    text = F.lit("").alias
    return papers.select(F.col("id").alias("paper_id"), F.col("content_hash").alias("paper_hash"), F.lit("").alias("summary"), used.alias("concepts"), F.array().cast("array<string>").alias("builds_on"), F.lit(None).cast("string").alias("relation"), text("relation_target"), text("inferred_open_problem")).join(
        found, "paper_id"
    )


def acquired(payloads: DataFrame, settings: Settings, scores: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(papers, failures, counts): records of all payloads in the order of their requests, merged by the ordered fold, their
    references rewritten to papers, scored (3 without a score) and cut to the corpus' size."""
    found, failures = parsers.fan_out(payloads)
    records = parsers.ingested(found)
    slots = dedup.match_slots(F.col("doi"), F.col("arxiv_id"), F.col("title"), F.col("id"), F.col("external_ids"))
    records = records.withColumn("slots", slots).withColumn("keys", F.array_distinct(F.transform("slots", lambda x: x["key"])))
    records = materialize(records.withColumn("citations", F.array().cast("array<string>")), "records")
    cluster = materialize(dedup.first_match(records, dedup.clusters(records)).toDF("seq", "cluster"), "clusters")
    papers = materialize(dedup.merged(records.drop("slots", "keys"), cluster), "merged")
    linked = dedup.rewritten_references(papers, dedup.key_index(records, cluster, papers))
    linked = materialize(linked.withColumn("content_hash", fx.content_hash(F.lower("title"), F.col("year"), F.col("abstract"))), "papers")
    window = dedup.candidate_window(linked, settings.corpus_cap)
    given = boundary.scored_in_batches(window, given=scores).select("id", F.col("score").alias("relevance_score"))
    kept = dedup.trimmed(window.join(given, "id").withColumn("ingest_seq", F.col("cluster")), settings.corpus_cap)
    row = linked.agg(F.count(F.lit(1)).alias("unique"), F.sum("resolved").alias("resolved"), F.sum("dropped").alias("dropped")).first()
    counts = {"records": records.count(), "unique": row.unique, "resolved": row.resolved or 0, "dropped": row.dropped or 0}
    return materialize(kept, "corpus"), failures, counts


def build(spark: SparkSession, payloads: DataFrame, title: str, out: str, settings: Settings | None = None, extractor: Extractor = offline_extractor, judged: DataFrame | None = None, run_id: str = "run") -> dict[str, DataFrame]:
    """Build a corpus and its graph below the folder `out`: papers, extractions, concepts, graph and events.

    Papers whose content was extracted before are not extracted again. Returns the relations.
    """
    settings = settings or Settings()
    events: list[dict] = []

    def tell(phase: str, message: str, kind: str = "ok", **payload) -> None:
        events.append(event(run_id, len(events), phase, message, kind, time.time(), **payload))

    tell("search", f"building {title!r}", "info", sources=settings.sources())
    papers, failures, counts = acquired(payloads, settings)
    for r in parsers.failed_sources(failures).collect():  # a row a source
        tell("fetch", f"{r.source}: {r.reason}", "error", source=r.source, n=r.n)
    tell("fetch", f"{counts['unique']} papers of {counts['records']} records", **counts)
    size = papers.count()
    tell("score", f"{size} papers stay", papers=size)
    store.save_records(papers, f"{out}/papers")

    path = f"{out}/extractions"
    stored = store.load_extractions(spark, path) if store._exists(spark, path) else None
    todo = papers if stored is None else store.missing(papers.withColumn("paper_hash", F.col("content_hash")), stored, ["paper_hash"])
    todo = materialize(todo, "todo")
    pending = todo.count()
    tell("extract", f"{pending} papers to extract", "info", pending=pending)
    if pending:
        before = stored.agg(F.max("seq")).first()[0] if stored is not None else None
        made = boundary.extraction(extractor(todo)).withColumn("seq", F.monotonically_increasing_id() + F.lit((before or 0) + 1))
        store.append_extractions(materialize(made, "extracted"), path)
    extractions = materialize(store.load_extractions(spark, path).join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi"), "extractions")
    done = extractions.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("stated_limitation") != "").alias("limits"), F.sum(F.size("concepts")).alias("concepts")).first()
    tell("extract", f"{done.n} of {size} extracted", extracted=done.n, total=size, limitations=done.limits, concepts=done.concepts or 0)

    said = boundary.mentions(extractions, papers).withColumn("seq", F.xxhash64("paper_id", "place"))
    none = judged if judged is not None else spark.createDataFrame([], "i long, j long, score double, decision string, rule string")
    found = resolve.resolved_concepts(said, none)
    concepts = materialize(found.select(F.concat(F.lit("concept:"), "slug").alias("id"), "name", "description", "aliases", "paper_ids", F.col("first_seen_year").alias("year"), F.col("place").alias("seq")), "concepts")
    tell("resolve", "concepts resolved", concepts=concepts.count())
    store.save_records(concepts, f"{out}/concepts")

    relations, _ = resolve.derived_relations(extractions, resolve.name_index(concepts))
    cites = graph.citation_relations(papers)
    nodes = materialize(graph.make_nodes(papers.withColumn("seq", F.col("cluster")), concepts), "nodes")
    edges, refused, dropped = graph.make_edges(relations.select("src", "dst", "type").unionByName(cites.select("src", "dst", "type")), nodes)
    edges = materialize(edges, "edges")
    store.save_graph(nodes, edges, f"{out}/graph")
    sizes = {"nodes": nodes.count(), "edges": edges.count()}
    tell("graph", f"{sizes['nodes']} nodes, {sizes['edges']} edges", stats=sizes, refused=refused.count(), dropped=dropped.count())
    tell("done", "built", graph=sizes)
    rows = [tuple(e[c] for c in ("run_id", "seq", "phase", "kind", "message", "payload", "ts")) for e in events]
    store.save_records(spark.createDataFrame(rows, EVENT), f"{out}/events")
    return {"papers": papers, "extractions": extractions, "concepts": concepts, "nodes": nodes, "edges": edges, "failures": failures}


NODES = "id string, type string, label string, year int, aliases array<string>, description string"
EDGES = "src string, dst string, type string, ground_truth boolean"


def loaded(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """What `build` wrote."""
    nodes, edges = store.load_graph(spark, f"{out}/graph", NODES, EDGES)
    papers = spark.read.schema("id string, title string, abstract string, year int, doi string, sources array<string>").json(f"{out}/papers")
    return {"papers": papers, "extractions": store.load_extractions(spark, f"{out}/extractions"), "nodes": nodes, "edges": edges, "events": spark.read.schema(EVENT).json(f"{out}/events")}
