"""Bibliographic relations as declared stand-ins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill.functions import text as fx
from citemill.runtime import table


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    # twelve words are cut out before blanks collapse, so that the rest of a text isn't rewritten
    blank = fx.SPACE[1:-1]
    title = fx.collapse(F.regexp_extract("text", f"^[{blank}]*+((?:[^{blank}]++[{blank}]++){{0,11}}[^{blank}]*+)", 1))
    return d.select(
        F.concat(F.lit("doc:"), "doc_id").alias("id"),
        title.alias("title"),
        (1995 + F.col("doc_id") % 30).cast("int").alias("year"),
        F.col("text").alias("abstract"),
        F.array("source").alias("sources"),
        F.array(F.col("lang")).alias("keywords"),
        (F.col("n_chars") % 97).alias("citation_count"),
        F.col("doc_id").alias("ingest_seq"),
    )


PAPERS_SQL = r"""papers as (select 'doc:' || doc_id as id, array_to_string(string_split(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')), ' ')[1:12], ' ') as title,
  (1995 + doc_id % 30)::int as year, text as abstract, [source] as sources, [lang] as keywords, n_chars % 97 as citation_count, doc_id as ingest_seq from documents)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with every field of a bibliographic record; DOIs, arXiv ids and native ids repeat over rows."""
    d = table(spark, sf_dir, "documents")
    p = papers(spark, sf_dir).join(d.select(F.col("doc_id").alias("ingest_seq"), "source", "n_chars"), "ingest_seq")
    made = {
        "authors": "transform(sequence(1, cast(ingest_seq % 4 + 1 as int)), i -> concat('Author ', (ingest_seq + i) % 9))",
        "venue": "if(ingest_seq % 3 = 0, '', concat('Venue ', source))",
        "doi": "if(ingest_seq % 5 = 1, concat('10.1/', n_chars % 211), '')",
        "arxiv_id": "if(ingest_seq % 7 = 2, concat('2101.', n_chars % 173), '')",
        "url": "if(ingest_seq % 2 = 0, '', concat('http://x/', ingest_seq))",
        "external_ids": "map(concat('ns', ingest_seq % 3), cast(n_chars % 307 as string))",
        "references": "array(concat('doc:', ingest_seq % 50), concat('10.1/', ingest_seq % 211), 'nowhere', concat('doc:', ingest_seq))",
        "citations": "array(concat('doc:', ingest_seq % 20))",
        "relevance_score": "if(ingest_seq % 4 = 0, null, cast(ingest_seq % 5 + 1 as int))",
    }
    return p.withColumns({c: F.expr(e) for c, e in made.items()}).drop("source", "n_chars")


RECORDS_SQL = PAPERS_SQL + """, records as (select p.*, list_transform(range(1, ingest_seq % 4 + 2), lambda i: 'Author ' || ((ingest_seq + i) % 9)) as authors,
    case when ingest_seq % 3 = 0 then '' else 'Venue ' || source end as venue, case when ingest_seq % 5 = 1 then '10.1/' || (n_chars % 211) else '' end as doi,
    case when ingest_seq % 7 = 2 then '2101.' || (n_chars % 173) else '' end as arxiv_id, case when ingest_seq % 2 = 0 then '' else 'http://x/' || ingest_seq end as url,
    'ns' || (ingest_seq % 3) as ns, (n_chars % 307)::varchar as native, ['doc:' || (ingest_seq % 50), '10.1/' || (ingest_seq % 211), 'nowhere', 'doc:' || ingest_seq] as refs, ['doc:' || (ingest_seq % 20)] as cits,
    case when ingest_seq % 4 = 0 then null else (ingest_seq % 5 + 1)::int end as relevance_score from papers p join documents on ingest_seq = doc_id)"""


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("concept:"), "p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("description"),
        F.array("p_brand").alias("aliases"),
        (1990 + (F.col("p_partkey") * 7919) % 30).cast("int").alias("year"),
        F.col("p_partkey").alias("seq"),
        "p_brand",
        "p_type",
        "p_size",
    )


CONCEPTS_SQL = """concepts as (select 'concept:' || p_partkey as id, p_name as name, p_type as description, [p_brand] as aliases,
  (1990 + (p_partkey * 7919) % 30)::int as year, p_partkey as seq, p_brand, p_type, p_size from part)"""


def graph_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("order:"), "o_orderkey").alias("id"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("seq"))


GRAPH_PAPERS_SQL = "gpapers as (select 'order:' || o_orderkey as id, 'Order ' || o_orderkey as title, year(o_orderdate)::int as year, o_orderkey as seq from orders)"


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate edges: uses, limitations, introductions, lineage (before the rules) and citations."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    pair = [F.concat(F.lit("order:"), "l_orderkey").alias("src"), F.concat(F.lit("concept:"), "l_partkey").alias("dst")]
    uses = li.select(*pair, F.lit("USES").alias("type"))
    limits = li.where("l_returnflag = 'R'").select(*pair, F.lit("HAS_LIMITATION").alias("type"))
    first = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_partkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("f"))
    intro = first.select(F.concat(F.lit("order:"), "f.o_orderkey").alias("src"), F.concat(F.lit("concept:"), "l_partkey").alias("dst"), F.lit("INTRODUCES").alias("type"))
    w = Window.partitionBy("p_brand", "p_type").orderBy("p_size", "seq")
    line = concepts(spark, sf_dir).withColumn("parent", F.lag("id").over(w)).where("parent is not null")
    line = line.select(F.col("parent").alias("src"), F.col("id").alias("dst"), F.when(F.col("p_size") % 2 == 0, "EXTENDS").otherwise("REPLACES").alias("type"))
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    cites = o.withColumn("prev", F.lag("o_orderkey").over(by)).where("prev is not null")
    cites = cites.select(F.concat(F.lit("order:"), "o_orderkey").alias("src"), F.concat(F.lit("order:"), "prev").alias("dst"), F.lit("CITES").alias("type"))
    out = uses
    for more in (limits, intro, line, cites):
        out = out.unionByName(more)
    return out


RELATIONS_SQL = """relations as (
  select 'order:' || l_orderkey as src, 'concept:' || l_partkey as dst, 'USES' as type from lineitem
  union all select 'order:' || l_orderkey, 'concept:' || l_partkey, 'HAS_LIMITATION' from lineitem where l_returnflag = 'R'
  union all select 'order:' || f, 'concept:' || l_partkey, 'INTRODUCES' from (select l_partkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as f from lineitem join orders on l_orderkey = o_orderkey group by 1)
  union all select parent, id, case when p_size % 2 = 0 then 'EXTENDS' else 'REPLACES' end from (select id, p_size, lag(id) over (partition by p_brand, p_type order by p_size, seq) as parent from concepts) where parent is not null
  union all select 'order:' || o_orderkey, 'order:' || prev, 'CITES' from (select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as prev from orders) where prev is not null)"""

NODES_SQL = "nodes as (select id, 'Paper' as type, title as label, year, cast([] as varchar[]) as aliases, '' as description from gpapers union all select id, 'Concept', name, year, aliases, description from concepts)"

EDGES_SQL = """edges as (
  select src, dst, r.type, bool_or(r.type = 'CITES') as ground_truth from relations r join nodes a on r.src = a.id join nodes b on r.dst = b.id
  where not (r.type in ('EXTENDS', 'REPLACES') and a.type = 'Concept' and b.type = 'Concept' and coalesce(nullif(a.year, 0) >= nullif(b.year, 0), false))
  group by src, dst, r.type)"""

GRAPH_SQL = ", ".join([CONCEPTS_SQL, GRAPH_PAPERS_SQL, RELATIONS_SQL, NODES_SQL, EDGES_SQL])
