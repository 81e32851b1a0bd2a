"""A typed property graph as two relations, nodes and edges, with its integrity rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citemill.functions import text as fx

LINEAGE = ("EXTENDS", "REPLACES")


def make_nodes(papers: DataFrame, concepts: DataFrame) -> DataFrame:
    """id, type, label, year, aliases, description, abstract; the first row of an id stays, papers before concepts."""
    none = F.array().cast("array<string>")
    p = papers.select(
        "id", F.lit("Paper").alias("type"), F.col("title").alias("label"), "year", none.alias("aliases"), F.lit("").alias("description"), F.struct(F.lit(0).alias("part"), "seq").alias("at")
    )
    c = concepts.select(
        "id", F.lit("Concept").alias("type"), F.col("name").alias("label"), "year", "aliases", "description", F.struct(F.lit(1).alias("part"), "seq").alias("at")
    )
    return p.unionByName(c).groupBy("id").agg(*[F.min_by(k, "at").alias(k) for k in ("type", "label", "year", "aliases", "description")])


def known(year: Column) -> Column:
    """A year, with 0 as missing."""
    return F.nullif(year, F.lit(0))


def make_edges(relations: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, refused, dropped): one edge per (src, dst, type) with known ends, relations with an unknown end,
    and lineage between concepts that runs against their years."""
    a = nodes.select(F.col("id").alias("src"), F.col("type").alias("st"), F.col("year").alias("sy"))
    b = nodes.select(F.col("id").alias("dst"), F.col("type").alias("dt"), F.col("year").alias("dy"))
    # distinct first: joins then see each edge once
    joined = relations.select("src", "dst", "type").distinct().join(a, "src", "left").join(b, "dst", "left")
    refused = joined.where("st is null or dt is null").select("src", "dst", "type")
    known_ends = joined.where("st is not null and dt is not null")
    backwards = F.col("type").isin(*LINEAGE) & (F.col("st") == "Concept") & (F.col("dt") == "Concept") & F.coalesce(known(F.col("sy")) >= known(F.col("dy")), F.lit(False))
    edges = known_ends.where(~backwards).select("src", "dst", "type", (F.col("type") == "CITES").alias("ground_truth"))
    return edges, refused, known_ends.where(backwards).select("src", "dst", "type")


def citation_relations(papers: DataFrame) -> DataFrame:
    """CITES candidates of reference lists and, reversed, of citation lists."""
    out = papers.select(F.col("id").alias("src"), F.explode("references").alias("dst"))
    back = papers.select(F.explode("citations").alias("src"), F.col("id").alias("dst"))
    return out.unionByName(back).where("src <> dst").distinct().withColumn("type", F.lit("CITES"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, type, n): totals (type null) and counts per node and edge type, in one pass each."""
    n = nodes.rollup("type").count().select(F.lit("node").alias("kind"), "type", F.col("count").alias("n"))
    e = edges.rollup("type").count().select(F.lit("edge").alias("kind"), "type", F.col("count").alias("n"))
    return n.unionByName(e)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per concept: papers that use it, concepts it descends from, concepts that descend from it, distinct neighbours."""
    kinds = nodes.select("id", F.col("type").alias("kind"))
    # parallel edges first become one row, so that nothing needs a distinct count
    pairs = edges.groupBy("src", "dst").agg(F.max((F.col("type") == "USES").cast("int")).alias("use"), F.max(F.col("type").isin(*LINEAGE).cast("int")).alias("line"))
    typed = pairs.join(kinds.toDF("src", "src_kind"), "src").join(kinds.toDF("dst", "dst_kind"), "dst")
    from_concept, to_concept = ((F.col(k) == "Concept").cast("int") for k in ("src_kind", "dst_kind"))
    inward = typed.where("dst_kind = 'Concept'").groupBy(F.col("dst").alias("id")).agg(
        F.sum("use").alias("used_by"), F.sum(F.col("line") * from_concept).alias("lineage_in"), F.count(F.lit(1)).alias("before")
    )
    outward = typed.where("src_kind = 'Concept'").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("line") * to_concept).alias("lineage_out"), F.count(F.lit(1)).alias("after"))
    zero = lambda k: F.coalesce(k, F.lit(0)).alias(k)
    return nodes.where("type = 'Concept'").select("id").join(inward, "id", "left").join(outward, "id", "left").select(
        "id", zero("used_by"), zero("lineage_in"), zero("lineage_out"), (F.coalesce("before", F.lit(0)) + F.coalesce("after", F.lit(0))).alias("degree")
    )


def induced(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes whose id is in `keep` (id), and all edges between them."""
    ids = keep.select("id").distinct()
    kept = nodes.join(ids, "id", "left_semi")
    return kept, edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")


def edge_types(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(type, n): edges by type, of all of them or of those that start in `sources` (id)."""
    some = edges if sources is None else edges.join(sources.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    return some.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def limitation_targets(edges: DataFrame) -> DataFrame:
    """(paper, concept): what papers state a limitation of."""
    return edges.where("type = 'HAS_LIMITATION'").select(F.col("src").alias("paper"), F.col("dst").alias("concept")).distinct()


def named_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, type): edges but for citations, concepts by name; between a paper and a concept, the paper first."""
    n = nodes.select("id", "label", F.col("type").alias("kind"))
    met = edges.where("type <> 'CITES'").join(n.toDF("src", "sl", "sk"), "src").join(n.toDF("dst", "dl", "dk"), "dst")
    swapped = (F.col("sk") == "Concept") & (F.col("dk") == "Paper")
    source = F.when(swapped, F.col("dst")).when(F.col("sk") == "Paper", F.col("src")).otherwise(F.col("sl"))
    return met.where("sk = 'Concept' or dk = 'Concept'").select(source.alias("source"), F.when(swapped, F.col("sl")).otherwise(F.col("dl")).alias("target"), "type")


def coverage(papers: DataFrame, extractions: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """Papers without an extraction, extractions without a concept (both paper_id), and relations by type."""
    return {
        "papers_without_extraction": papers.select(F.col("id").alias("paper_id")).join(extractions.select("paper_id").distinct(), "paper_id", "left_anti"),
        "extractions_without_concepts": extractions.where(F.coalesce(F.size("concepts"), F.lit(0)) <= 0).select("paper_id"),
        "relations": edge_types(relations),
    }


def broken_rules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, n): how often a built graph breaks its rules; none does if it came from `make_edges`."""
    _, refused, dropped = make_edges(edges, nodes)
    parallel = edges.groupBy("src", "dst", "type").count().where("count > 1")
    out = refused.agg(F.lit("unknown end").alias("rule"), F.count(F.lit(1)).alias("n"))
    for rule, rows in (("lineage against the years", dropped), ("repeated edge", parallel)):
        out = out.unionByName(rows.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n")))
    return out


def payloads(nodes: DataFrame) -> DataFrame:
    """id, type, name, year, detail: what an answer shows of a node; 280 characters of an abstract, aliases behind a description."""
    also = F.when(F.size("aliases") > 0, F.concat(F.lit(" (also: "), F.array_join("aliases", ", "), F.lit(")"))).otherwise("")
    about = F.trim(F.concat(fx.text_or_empty(F.col("description")), also))
    abstract = F.left(fx.text_or_empty(F.col("abstract")), F.lit(280)) if "abstract" in nodes.columns else F.lit("")
    name = F.coalesce(F.nullif("label", F.lit("")), F.col("id"))
    return nodes.select("id", "type", name.alias("name"), known(F.col("year")).alias("year"), F.when(F.col("type") == "Paper", abstract).otherwise(about).alias("detail"))


def labelled(nodes: DataFrame) -> DataFrame:
    """Stable labels: P1.. for papers, newest first, then title and id; C1.. for concepts by id. For answer-sized slices."""
    by = Window.partitionBy("type").orderBy(
        F.when(F.col("type") == "Paper", -F.coalesce("year", F.lit(0))), F.when(F.col("type") == "Paper", F.col("label")), "id"
    )
    return nodes.withColumn("mark", F.concat(F.when(F.col("type") == "Paper", "P").otherwise("C"), F.row_number().over(by)))


def lineage_ends(nodes: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    """(id): concepts at the `end` (src or dst) of a lineage edge between concepts."""
    kinds = nodes.where("type = 'Concept'").select("id")
    line = edges.where(F.col("type").isin(*LINEAGE)).join(kinds.toDF("src"), "src", "left_semi").join(kinds.toDF("dst"), "dst", "left_semi")
    return line.select(F.col(end).alias("id")).distinct()


def structural_gaps(nodes: DataFrame, edges: DataFrame, min_age: int = 3, direction: str = "in") -> DataFrame:
    """Concepts with a known year, old enough, that no lineage edge reaches (`in`) or leaves (`out`)."""
    top = nodes.agg(F.max(known(F.col("year"))).alias("newest"))
    line = lineage_ends(nodes, edges, "dst" if direction == "in" else "src")
    old = nodes.where("type = 'Concept'").withColumn("year", known(F.col("year"))).join(F.broadcast(top)).where(F.col("year") <= F.col("newest") - min_age)
    return old.join(line, "id", "left_anti").select("id", F.col("label").alias("name"), "year")


def concept_scores(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, id, score): lexical relevance of concepts to questions, by shared words.

    Words of the name weigh 1.0, of an alias 0.6, of the rest of the node's text 0.25, over the question's words.
    """
    c = nodes.where("type = 'Concept'")
    words = lambda col: fx.question_tokens(col)
    have = c.select(
        "id",
        words(F.col("label")).alias("in_name"),
        words(F.array_join("aliases", " ")).alias("in_alias"),
        F.explode(words(fx.node_text(F.col("label"), F.col("aliases"), F.col("description")))).alias("word"),
    )
    have = have.withColumn("weight", F.when(F.array_contains("in_name", F.col("word")), 1.0).when(F.array_contains("in_alias", F.col("word")), 0.6).otherwise(0.25))
    want = questions.select("question_id", words(F.col("question")).alias("words")).withColumn("n", F.size("words")).select("question_id", "n", F.explode("words").alias("word"))
    met = want.join(have.select("id", "word", "weight"), "word")
    return met.groupBy("question_id", "id").agg((F.sum("weight") / F.max("n")).alias("score"), F.max("n").alias("n"))


def find_concepts(nodes: DataFrame, questions: DataFrame, limit: int = 3) -> DataFrame:
    """(question_id, id, score, rank): the best concepts, cut at 0.6 of the best and of one full match."""
    by = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "id")
    ranked = concept_scores(nodes, questions).withColumns({"rank": F.row_number().over(by), "best": F.max("score").over(Window.partitionBy("question_id"))})
    good = (F.col("rank") <= limit) & (F.col("score") >= F.col("best") * 0.6 - 1e-12) & (F.col("score") >= 0.6 / F.greatest("n", F.lit(1)) - 1e-12)
    return ranked.where(good).select("question_id", "id", F.round("score", 6).alias("score"), "rank")
