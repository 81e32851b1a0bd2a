"""Operators on small hand-made relations."""

import json
import random

from citemill.operators import boundary, dedup, gaps, graph, metrics, resolve, traverse
from citemill.operators.components import connected_components
from citemill.sources import payloads, store
from pyspark.sql import functions as F


def test_components_of_chains_cycles_and_loops(spark):
    edges = [(i + 1, i) for i in range(20)] + [(30, 31), (31, 32), (32, 30), (40, 40), (50, None)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {30: 30, 31: 30, 32: 30}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_few_passes_on_an_ordered_chain(spark):
    chain = spark.range(1, 10_001).selectExpr("id as a", "id - 1 as b")
    passes = []
    got = connected_components(chain, one_task=0, rounds=passes)
    assert got.count() == 10_001 and got.where("component <> 0").count() == 0 and sum(passes) <= 16
    mixed = spark.range(1, 3000).selectExpr("id as a", "xxhash64(id) % 500 as b")
    assert sorted(connected_components(mixed, one_task=0).collect()) == sorted(connected_components(mixed).collect())


def _records(spark, rows):
    kind = "ingest_seq long, id string, doi string, arxiv string, title string, native map<string,string>"
    df = spark.createDataFrame([(i, f"r{i}", *r) for i, r in enumerate(rows)], kind)
    slots = dedup.match_slots(F.col("doi"), F.col("arxiv"), F.col("title"), F.col("id"), F.col("native"))
    return df.withColumn("slots", slots).withColumn("keys", F.array_distinct(F.transform("slots", lambda x: x["key"])))


def _plain_fold(records):
    """Survivor of each record: keys of the merged record are registered again after every merge."""
    state, index, out = {}, {}, {}
    for r in records:
        keys = lambda x: [k for k in ("doi:" + x["doi"] if x["doi"] else "", "arxiv:" + x["arxiv"] if x["arxiv"] else "", "title:" + x["title"], x["id"]) if k] + [f"{n}:{v}" for n, v in x["native"].items() if v]
        hit = [index[k] for k in keys(r) if k in index]
        if hit:
            base = state[hit[0]]
            base["doi"], base["arxiv"] = base["doi"] or r["doi"], base["arxiv"] or r["arxiv"]
            base["native"] = {**r["native"], **base["native"]}
        else:
            base = state[r["seq"]] = dict(r)
        out[r["seq"]] = base["seq"]
        index.update(dict.fromkeys(keys(base), base["seq"]))
    return out


def test_fold_follows_the_keys_of_merged_records(spark):
    rows = _records(spark, [("", "", "alpha", {}), ("10.1/a", "", "alpha", {}), ("10.1/a", "", "beta", {}), ("", "", "beta", {})])
    folded = {r.ingest_seq: r.survivor for r in dedup.first_match(rows, dedup.clusters(rows)).collect()}
    assert folded == {0: 0, 1: 0, 2: 0, 3: 3}  # the title that the cluster didn't take isn't known
    rnd = random.Random(11)
    for _ in range(3):
        given = [(rnd.choice(["", "", f"10.1/{rnd.randrange(9)}"]), rnd.choice(["", "", f"21.{rnd.randrange(9)}"]), f"t{rnd.randrange(12)}", {f"n{rnd.randrange(2)}": str(rnd.randrange(12))}) for _ in range(60)]
        df = _records(spark, given)
        want = _plain_fold([{"seq": i, "id": f"r{i}", "doi": d, "arxiv": a, "title": t, "native": n} for i, (d, a, t, n) in enumerate(given)])
        assert {r.ingest_seq: r.survivor for r in dedup.first_match(df, dedup.clusters(df)).collect()} == want


def _graph(spark):
    p = spark.createDataFrame([(f"p{i}", f"Paper {i}", 2014 + i, i) for i in range(1, 4)], "id string, title string, year int, seq long")
    rows = [("c1", "alpha net", "", ["an"], 2015, 1), ("c2", "beta net", "", [], 2017, 2), ("c3", "gamma net", "", [], 2018, 3), ("c4", "island", "", [], None, 4)]
    c = spark.createDataFrame(rows, "id string, name string, description string, aliases array<string>, year int, seq long")
    rel = [("c1", "c2", "EXTENDS"), ("c2", "c3", "REPLACES"), ("c3", "c1", "EXTENDS"), ("c4", "c1", "EXTENDS"), ("p1", "c1", "USES"), ("p1", "c1", "USES"), ("p2", "c3", "INTRODUCES"), ("p2", "p1", "CITES"), ("p9", "c1", "USES")]
    nodes = graph.make_nodes(p, c)
    return nodes, *graph.make_edges(spark.createDataFrame(rel, "src string, dst string, type string"), nodes)


def test_graph_rules(spark):
    nodes, edges, refused, dropped = _graph(spark)
    assert [tuple(r) for r in refused.collect()] == [("p9", "c1", "USES")]
    assert [tuple(r) for r in dropped.collect()] == [("c3", "c1", "EXTENDS")]
    assert edges.count() == 6
    assert {r.id for r in graph.structural_gaps(nodes, edges, min_age=0).collect()} == set()
    assert {r.id for r in graph.structural_gaps(nodes, edges, 0, "out").collect()} == {"c3"}


def test_lineage_depth_and_papers(spark):
    nodes, edges, *_ = _graph(spark)
    assert {r.id for r in traverse.lineage(nodes, edges, "how did beta evolve").collect()} == {"c1", "c2", "c3", "c4", "p1", "p2"}
    assert {r.id for r in traverse.lineage(nodes, edges, "how did gamma evolve", 1).collect()} == {"c2", "c3", "p2"}


def test_reach_ends_on_cycles(spark):
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    got = {r.id: r.depth for r in traverse.reach(steps, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {"b": 1, "c": 2, "a": 3}


def test_later_paper_closes_a_gap(spark):
    g = spark.createDataFrame([(1, "graph memory scaling problem", 2018, ["p1"]), (2, "graph memory", 2021, ["p2"])], "gap int, text string, newest int, sources array<string>")
    c = spark.createDataFrame([("p1", 2019, "we address graph memory"), ("p3", 2019, "graph memory"), ("p4", 2020, "We address memory of a graph"), ("p5", 2020, "overcomes graph memory")], "paper_id string, year int, text string")
    assert [tuple(r) for r in gaps.suppressed(g, c).collect()] == [(1, "p4", ["graph", "memory"])]


def test_scores_stay_unknown_on_empty_sets(spark):
    none = spark.createDataFrame([], "key string")
    r = metrics.score_items(none, none).first()
    assert (r.tp, r.precision, r.recall, r.f1) == (0, None, None, None)


def test_merge_budget_and_components(spark):
    pairs = spark.createDataFrame([(1, 2, 0.95), (2, 3, 0.8), (4, 5, 0.75), (6, 7, 0.74)], "i long, j long, score double")
    judged = spark.createDataFrame([(2, 3, True), (6, 7, True)], "i long, j long, same boolean")
    made = resolve.decisions(pairs, budget=2, judged=judged)
    assert {(r.i, r.j): (r.decision, r.rule) for r in made.collect()} == {(1, 2): ("same", "auto-similarity"), (2, 3): ("same", "judge"), (4, 5): ("different", "judge"), (6, 7): ("different", "over-budget")}
    assert {r.id: r.component for r in resolve.entities(made).collect()} == {1: 1, 2: 1, 3: 1}


PAYLOADS = {
    "semantic_scholar": json.dumps({"data": [{"paperId": "s1", "title": " A title ", "year": 2020, "externalIds": {"DOI": "10.1/X"}, "authors": [{"name": "Ann"}], "references": [{"paperId": "s2"}]}, {"title": ""}]}),
    "openalex": json.dumps({"results": [{"id": "https://openalex.org/W1", "display_name": "Works", "abstract_inverted_index": {"b": [1], "a": [0]}, "concepts": [{"display_name": str(i)} for i in range(7)]}]}),
    "arxiv": '<feed xmlns="x"><entry><id>http://arxiv.org/abs/2101.00001v2</id><title>An\n entry</title><summary>S</summary><published>2021-01-01</published><author><name>Bo</name></author></entry></feed>',
    "dblp": json.dumps({"result": {"hits": {"hit": {"info": {"title": {"text": "One hit."}, "year": "2019", "authors": {"author": {"text": "Cy"}}}}}}}),
    "crossref": json.dumps({"message": {"items": [{"DOI": "10.2/y", "title": ["Cross"], "author": [{"given": "D", "family": "E"}], "issued": {"date-parts": [[2018, 2]]}}, {"title": ["no doi"]}]}}),
    "serpapi": json.dumps({"organic_results": [{"title": "Found", "link": "http://l", "publication_info": {"summary": "Venue, 2017"}}]}),
}


def test_payload_parsers(spark):
    rows = [(s, 0, b) for s, b in PAYLOADS.items()] + [("openalex", 1, "<html>"), ("arxiv", 1, "<feed><entry>")]
    found, failures = payloads.fan_out(spark.createDataFrame(rows, "source string, query_ord int, body string"))
    got = {r.source: r for r in found.collect()}
    assert set(got) == set(PAYLOADS) and found.count() == 6
    assert (got["semantic_scholar"].title, got["semantic_scholar"].id, got["semantic_scholar"].references) == ("A title", "doi:10.1/x", ["s2"])
    assert (got["openalex"].abstract, got["openalex"].external_ids, len(got["openalex"].keywords)) == ("a b", {"openalex": "W1"}, 5)
    assert (got["arxiv"].title, got["arxiv"].year, got["arxiv"].arxiv_id, got["arxiv"].venue) == ("An entry", 2021, "2101.00001", "arXiv preprint")
    assert (got["dblp"].title, got["dblp"].year, got["dblp"].authors) == ("One hit", 2019, ["Cy"])
    assert (got["crossref"].authors, got["crossref"].year) == (["D E"], 2018)
    assert got["serpapi"].id.startswith("gs:") and got["serpapi"].year == 2017
    assert {(r.source, r.query_ord) for r in failures.collect()} == {("openalex", 1), ("arxiv", 1)}


def test_extraction_store_skips_bad_lines_and_keeps_the_last(spark, tmp_path):
    path = tmp_path / "x"
    path.mkdir()
    (path / "a.json").write_text('{"paper_id":"p","paper_hash":"h","seq":1}\n{broken\n{"paper_id":"q","paper_hash":"h","seq":2}\n')
    assert [(r.paper_id, r.seq) for r in store.load_extractions(spark, str(path)).collect()] == [("q", 2)]


def test_graph_round_trip_and_graphml(spark, tmp_path):
    nodes, edges, *_ = _graph(spark)
    n, e = nodes.select("id", "type", "year"), edges.select("src", "dst", "type")
    store.save_graph_json(n, e, str(tmp_path / "g"))
    back_n, back_e = store.load_graph_json(spark, str(tmp_path / "g"), "id STRING, type STRING, year INT", "src STRING, dst STRING, type STRING")
    assert sorted(map(tuple, back_n.collect()), key=str) == sorted(map(tuple, n.collect()), key=str)
    assert sorted(map(tuple, back_e.collect())) == sorted(map(tuple, e.collect()))
    store.save_graphml(n, e, str(tmp_path / "m"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "m")).collect())
    assert text.count("<edge ") == e.select("src", "dst").distinct().count() and text.count("<node ") == n.count()


def test_event_stream_folds_like_the_batch(spark, tmp_path):
    from citemill.streaming.fold import fold_stream

    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate([[(1, 1, 1, "info"), (2, 1, 1, "error")], [(1, 3, 3, "info"), (1, 2, 2, "error")]]):
        (source / f"{i}.json").write_text("".join(json.dumps(dict(zip(("run_id", "seq", "phase", "kind"), r, strict=True))) + "\n" for r in rows))
    events = spark.readStream.schema("run_id long, seq long, phase int, kind string").option("maxFilesPerTrigger", 1).json(str(source))
    q = fold_stream(events).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.run_id: r for r in spark.sql("select * from folded order by n_events").collect()}
    assert (last[1].n_events, last[1].furthest, last[1].current, last[1].errors) == (3, 3, 3, 1)
    assert (last[2].n_events, last[2].errors) == (1, 1)
