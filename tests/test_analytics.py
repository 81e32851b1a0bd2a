"""Gaps, graph slices, resolution, evaluation, stores, readers and run states on small hand-made relations."""

import json
import math
import random

import pytest
from citemill.operators import evaluate, gaps, graph, metrics, order, rank, resolve, traverse
from citemill.sources import payloads, readers, store
from citemill.streaming import fold
from pyspark.sql import functions as F

from tests.test_operators import PAYLOADS, _graph


def test_numbers_are_exact_and_in_order(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("x"), (F.col("id") % 7).alias("g")).repartition(5)
    rows = order.numbered(df, F.desc("g"), "x").collect()
    want = sorted(((-r.g, r.x) for r in rows))
    assert [(-r.g, r.x) for r in sorted(rows, key=lambda r: r.n)] == want and sorted(r.n for r in rows) == list(range(1, 1001))


@pytest.mark.parametrize("few", [0, 100])
def test_gaps_close_on_two_shared_words(spark, monkeypatch, few):
    monkeypatch.setattr(gaps, "SMALL_WORDS", few)
    rnd = random.Random(3)
    vocabulary = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}xyz" for i in range(40)] + ["common"]
    g = [(i, " ".join(["common", *rnd.sample(vocabulary, 3)]), rnd.choice([None, 2005, 2010]), [f"p{i}"]) for i in range(12)]
    c = [(f"p{i}", rnd.choice([None, 2000, 2008, 2012]), " ".join(["common", *rnd.sample(vocabulary, 4), rnd.choice(["we address it", ""])])) for i in range(60)]
    got = {r.gap: (r.closer, r.shared) for r in gaps.suppressed(spark.createDataFrame(g, "gap int, text string, newest int, sources array<string>"), spark.createDataFrame(c, "paper_id string, year int, text string")).collect()}
    want = {}
    for i, text, newest, sources in g:
        for p, year, said in sorted(c, key=lambda x: (x[1] or 0, x[0])):
            shared = sorted(set(text.split()) & {w for w in said.split() if len(w) > 4}) if "we address" in said else []
            if i not in want and len(shared) >= 2 and p not in sources and (newest is None or year is None or year > newest):
                want[i] = (p, shared)
    assert got == want and len(want) > 3


def test_gap_report(spark):
    nodes, edges, *_ = _graph(spark)
    papers = spark.createDataFrame([("a", "Old paper", 2010), ("b", "New paper", 2020)], "id string, title string, year int")
    ex = spark.createDataFrame([("a", "training cost is large", ""), ("b", "", "We address training cost here"), ("zz", "labelled data is scarce", "x"), ("d", " ", "y")], "paper_id string, stated_limitation string, summary string")
    rules = (("cost_theme", ("cost",)), ("data_theme", ("data",)))
    parts = gaps.gap_report(ex, papers, nodes, edges, rules, ("we address",), min_age=0)
    assert [(r.mark, r.title, r.theme) for r in parts["rows"].orderBy("place").collect()] == [("L1", "Old paper", "cost_theme"), ("L2", "zz", "data_theme")]
    closed = parts["closed"].collect()
    assert [(r.key, r.closer, r.closer_title, r.shared) for r in closed] == [("theme:cost_theme", "b", "New paper", ["paper", "training"])]
    kept = {r.key for r in parts["kept"].collect()}
    assert "theme:data_theme" in kept and not kept & {r.key for r in closed}
    lines = [r.line for r in gaps.report_lines(parts).orderBy("section", "place").collect()]
    assert lines[0] == "# Research gaps" and any("data theme" in x for x in lines) and gaps.citation_index(parts).count() >= 2
    assert gaps.gap_report(ex, papers, theme_rules=rules)["stats"].first().structural == 0


def test_slices_are_dispatched_rendered_and_nested(spark):
    nodes, edges, *_ = _graph(spark)
    kind, some, between = traverse.traverse(nodes, edges, "How did beta evolve over time")
    assert kind == "lineage" and {r.id for r in some.collect()} >= {"c1", "c2", "c3"}
    text = "\n".join(r.line for r in traverse.rendered(kind, "q", some, between).orderBy("section", "place").collect())
    assert "- [C2] concept (2017): beta net" in text and "-[EXTENDS]-> [C2] (inferred)" in text
    assert "Question: q" in traverse.answer_prompt("q", text.split("\n"))
    tree = {(r.id, r.parent): r for r in traverse.forest(some, between).collect()}
    assert ("c2", "c1") in tree and ("c3", "c2") in tree and tree["c3", "c2"].depth == tree["c2", "c1"].depth + 1
    loop = spark.createDataFrame([("c1", "c2"), ("c2", "c1"), ("c3", "c1")], "src string, dst string")
    paths = traverse.forest(some.where("type = 'Concept'"), loop).collect()
    assert {(r.id, r.depth) for r in paths if r.id != "c4"} == {("c3", 0), ("c1", 1), ("c2", 2)}
    with pytest.raises(ValueError):
        traverse.traverse(nodes, edges, "q", "no such type")
    for question in ("compare alpha and beta", "open problems in gamma", "major methods for alpha", "anything else"):
        assert traverse.traverse(nodes, edges, question)[1].count() >= 0
    p = graph.payloads(nodes.withColumn("abstract", F.lit("x" * 400))).collect()
    assert {len(r.detail) for r in p if r.type == "Paper"} == {280} and {r.detail for r in p if r.id == "c1"} == {"(also: an)"}


def test_graphs_are_checked_saved_and_exported(spark, tmp_path):
    nodes, edges, *_ = _graph(spark)
    store.save_graph(nodes.select("id", "type", "year"), edges, str(tmp_path / "g"))
    _, back = store.load_graph(spark, str(tmp_path / "g"), "id string, type string, year int", "src string, dst string, type string, ground_truth boolean")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, edges.select("src", "dst", "type", "ground_truth").collect()))
    bad = edges.unionByName(spark.createDataFrame([("c3", "c1", "EXTENDS", False), ("x", "c1", "USES", False)], edges.schema))
    with pytest.raises(ValueError, match="unknown end: 1"):
        store.save_graph(nodes, bad, str(tmp_path / "h"))
    parallel = spark.createDataFrame([("a", "b", "USES", "first", 1), ("a", "b", "EXTENDS", None, 2)], "src string, dst string, type string, evidence string, edge_seq long")
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    line = next(r.value for r in store.graphml_lines(ids, parallel).collect() if r.value.startswith("<edge"))
    assert '<data key="type">EXTENDS</data>' in line and '<data key="evidence">first</data>' in line
    named = {tuple(r) for r in graph.named_edges(nodes, edges).collect()}
    assert ("p1", "alpha net", "USES") in named and ("alpha net", "beta net", "EXTENDS") in named
    c = graph.coverage(spark.createDataFrame([("p1",), ("p9",)], "id string"), spark.createDataFrame([("p1", [])], "paper_id string, concepts array<string>"), edges)
    assert [r.paper_id for r in c["papers_without_extraction"].collect()] == ["p9"] and c["extractions_without_concepts"].count() == 1 and c["relations"].count() == 5
    store.empty_reference_set(spark, str(tmp_path / "r"))
    store.empty_reference_set(spark, str(tmp_path / "r"))  # over a blank one
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.json").write_text('{"name":"n","nodes":[{"name":"a","provenance":"hand_labelled","paper_ids":["p"]}],"edges":[]}')
    with pytest.raises(ValueError):
        store.empty_reference_set(spark, str(tmp_path / "s"))
    gate = store.reference_gate(*store.load_reference_set(spark, str(tmp_path / "s"))).first()
    assert (gate.n_nodes, gate.hand_labelled, gate.blocked, len(gate.warnings)) == (1, 1.0, False, 1)
    assert store.reference_gate(*store.load_reference_set(spark, str(tmp_path / "r"))).first().blockers == ["the reference set is empty"]
    store.save_lines(spark.createDataFrame([(2, "", "b"), (1, "", "a")], "section int, place string, line string"), str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a", "b"]
    stored = spark.createDataFrame([("k", 1, "x"), ("l", 1, "y")], "key string, seq int, v string")
    fresh = spark.createDataFrame([("k", 2, "z")], "key string, seq int, v string")
    assert {(r.key, r.v) for r in store.upserted(stored, fresh, ["key"], "seq").collect()} == {("k", "z"), ("l", "y")}
    with pytest.raises(ValueError):
        store.append_extractions(spark.createDataFrame([("p", "")], "paper_id string, paper_hash string"), str(tmp_path / "e"))


def test_concepts_after_resolution(spark):
    rows = [(1, "Graph Net", "p1", "short", 2015), (2, "graph net", "p2", "a longer text", 2012), (3, "graph net", "p3", "", 0), (4, "GNN", "p1", "x", 2018), (5, "GNN", "p4", "", None), (6, "other", "p5", "o", 2020)]
    m = spark.createDataFrame(rows, "seq long, name string, paper_id string, description string, year int")
    made = spark.createDataFrame([(1, 4, 0.95, "same", "auto-similarity")], "i long, j long, score double, decision string, rule string")
    got = [tuple(r) for r in resolve.resolved_concepts(m, made).orderBy("place").select("name", "aliases", "paper_ids", "description", "first_seen_year", "place").collect()]
    assert got == [("graph net", ["Graph Net", "graph net", "GNN"], ["p1", "p2", "p3", "p4"], "a longer text", 2012, 1), ("other", ["other"], ["p5"], "o", 2020, 2)]
    voted = spark.createDataFrame([("gnn", "GNN"), ("graph net", "GNN")], "key string, name string")
    assert resolve.resolved_concepts(m, made, voted).orderBy("place").first().name == "GNN"


def test_similar_pairs_are_those_of_all_pairs(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) + (3 if i % 3 else -3) for _ in range(5)]) for i in range(90)] + [(200, [0.0] * 5), (201, [1.0] * 5), (202, [2.0] * 5)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (math.hypot(*a) * math.hypot(*b)) if any(a) and any(b) else 0.0
    want = {(i, j) for i, a in rows for j, b in rows if i < j and cos(a, b) >= 0.9}
    df = spark.createDataFrame(rows, "seq long, v array<double>")
    assert {(r.i, r.j) for r in resolve.similar_pairs(df, 0.9, block=10).collect()} == want and len(want) > 100
    assert resolve.similar_pairs(df.where("false"), 0.9).count() == 0


def test_names_fold_by_compatibility(spark):
    rows = [("Erdős Dvořák", "erdos dvorak"), ("ﬁne-tuned Ｎets", "fine tuned net"), ("Straße", "stra e"), ("", ""), (None, "")]
    got = spark.createDataFrame(rows, "name string, want string").select(metrics.comparison_key(F.col("name")).alias("k"), "want").collect()
    assert [r.k for r in got] == [r.want for r in got]


def test_extraction_scores(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    edges = lambda *x: spark.createDataFrame(list(x), "source string, target string, type string")
    papers = spark.createDataFrame([("p1",), ("p2",)], "id string")
    predicted = edges(("Alpha Nets", "beta", "EXTENDS"), ("p1", "beta", "USES"), ("p1", "gamma", "USES"), ("p2", "beta", "USES"))
    reference = edges(("alpha net", "Beta", "EXTENDS"), ("p1", "Beta", "USES"), ("p1", "Beta", "INTRODUCES"))
    out = {r.part: r for r in metrics.score_extraction(names("Alpha Nets", "beta", "gamma"), predicted, names("alpha net", "Beta"), reference, papers).collect()}
    assert (out["nodes"].tp, out["nodes"].fp, out["nodes"].fn) == (2, 1, 0) and out["concept edges"].f1 == 1.0
    assert (out["paper-concept edges"].tp, out["paper-concept edges"].fp, out["paper-concept edges"].fn, out["paper-concept edges"].unmatched) == (1, 1, 1, 1)
    gate = spark.createDataFrame([(True, ["not by hand"])], "blocked boolean, blockers array<string>")
    blocked = metrics.score_extraction(names("a"), predicted, names("a"), reference, papers, gate).collect()
    assert {(r.tp, r.precision, r.reason) for r in blocked} == {(None, None, "not by hand")}


def test_evaluation_run(spark):
    nodes, edges, *_ = _graph(spark)
    texts = {"p1": "alpha net studied", "p2": "gamma net made", "p3": "nothing"} | {f"h{i}": f"alpha net again {i}" for i in range(6)}
    papers = spark.createDataFrame([(k, f"Title {k}", v, 2030) for k, v in texts.items()], "id string, title string, abstract string, year int")
    ex = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "paper_id string")
    parts = evaluate.run_eval(papers, ex, nodes, edges, ["how did alpha evolve", "what is gamma"])
    assert tuple(parts["counts"].first())[:3] == (9, 3, 6)
    shared = {r.query_id: r.shared for r in parts["overlap"].collect()}
    assert shared[0] == ["p1"]
    assert {r.dimension for r in parts["arms"].collect()} == {"citation_validity", "citation_support", "completeness"}
    assert {r.favours for r in parts["arms"].where("dimension = 'completeness'").collect()} == {"unknown"}
    lines = [r.line for r in evaluate.report_lines(parts).orderBy("section", "place").collect()]
    assert lines[0] == "# Evaluation" and any("no reference set" in x for x in lines)
    only = rank.bm25_top(spark.createDataFrame([("a", "x y"), ("b", "x x")], "id string, text string"), spark.createDataFrame([(0, "x")], "query_id int, query string"), 5, spark.createDataFrame([("b",)], "id string"))
    assert [(r.id, r.score) for r in only.collect()] == [("b", round(math.log(1 + 0.5 / 1.5) * 2 * 2.5 / 3.5, 6))]


def _get(url, params):
    _get.calls.append((url, params))
    if "openalex" in url:
        return 200, {}, PAYLOADS["openalex"]
    if "crossref" in url:
        return (503, {"Retry-After": "0"}, "") if len([c for c in _get.calls if "crossref" in c[0]]) < 2 else (200, {}, PAYLOADS["crossref"])
    if "dblp" in url:
        return 429, {"retry-after": "7200"}, ""
    return 404, {}, ""


_get.calls = []


def test_requests_and_retries(spark):
    assert readers.request("openalex", "citations", "W1", 99) == ("https://api.openalex.org/works", {"filter": "cites:W1", "per-page": "50"})
    assert readers.request("semantic_scholar", "references", "a/b c")[0].endswith("/paper/a/b%20c/references") and readers.request("dblp", "citations", "x") is None
    assert readers.expanded("T") == ["T"] == readers.expanded("T", lambda _: "oops")
    assert readers.expanded("T", lambda _: '{"queries": [" a ", "a", "", "b", "c", "d", "e"]}') == ["a", "b", "c", "d"]
    waits = []
    assert readers.got(_get, "http://crossref", {}, 4, waits.append)[1:] == (None, 2) and waits == [1.0]
    assert readers.got(_get, "http://dblp", {}, 4, waits.append)[1:] == ("rate limited for 7200 s", 1)
    assert readers.got(_get, "http://x", {}, 4, waits.append)[1:] == ("status 404", 1)

    def broken(url, params):
        raise ConnectionError("refused")

    assert readers.got(broken, "u", {}, 3, waits.append) == (None, "network_error: refused", 3)


def _plain(url, params):
    name = next(k for k in PAYLOADS if k.split("_")[0] in url.replace("semanticscholar", "semantic"))
    return (200, {}, PAYLOADS[name]) if name != "dblp" else (500, {}, "")


def test_payloads_are_fetched_once_and_numbered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "QUERIES", 2)
    asked = readers.requests(spark, ["semantic_scholar", "openalex", "arxiv", "dblp", "crossref"], ["one", "two"])
    assert asked.count() == 10 and asked.select("key").distinct().count() == 10
    cache = asked.where("source = 'openalex' and query_ord = 1").select("key", F.lit(PAYLOADS["openalex"]).alias("body"))
    found = readers.fetched(asked, _plain, cache, retries=1)
    assert found.where("cached").count() == 1 and found.where("body is null").count() == 2
    records, failures = payloads.fan_out(found)
    rows = payloads.ingested(records).orderBy("ingest_seq").collect()
    assert [r.source for r in rows] == [s for s in ("semantic_scholar", "openalex", "arxiv", "crossref") for _ in range(2)] and [r.ingest_seq for r in rows] == list(range(8))
    assert all(r.sources == [r.source] and len(r.content_hash) == 32 for r in rows)
    assert [tuple(r) for r in payloads.failed_sources(failures).collect()] == [("dblp", "status 500", 2)]
    (tmp_path / "openalex").mkdir()
    (tmp_path / "openalex" / "3.json").write_text(PAYLOADS["openalex"])
    assert [(r.source, r.query_ord, r.body) for r in readers.captured(spark, str(tmp_path)).collect()] == [("openalex", 3, PAYLOADS["openalex"])]
    spark.dataSource.register(readers.IndexSource)
    live = spark.read.format("citemill_index").option("source", "openalex").option("queries", '["a", "b"]').option("getter", "tests.test_analytics:_plain").load()
    assert sorted((r.query_ord, r.body) for r in live.collect()) == [(0, PAYLOADS["openalex"]), (1, PAYLOADS["openalex"])]


def test_wrapped_records_and_snowball(spark):
    body = json.dumps({"data": [{"citedPaper": {"paperId": "s9", "title": "Cited", "year": 2001}}, {"citedPaper": {"title": ""}}]})
    df = spark.createDataFrame([(body,)], "body string")
    assert [(r.title, r.external_ids.get("s2")) for r in payloads.semantic_scholar(df, wrapped="citedPaper").collect()] == [("Cited", "s9")]
    papers = spark.createDataFrame([(f"p{i}", 100 - i, ["openalex"] if i % 2 else ["arxiv"]) for i in range(10)], "id string, citation_count long, sources array<string>")
    edges = spark.createDataFrame([("p1", f"x{i:02d}") for i in range(20)] + [("y", "p3"), ("p0", "z")], "src string, dst string")
    got = payloads.snowball(papers, edges).collect()
    assert len([r for r in got if r.seed == "p1"]) == 12 and ("p3", "citations", "y") in {tuple(r) for r in got} and not [r for r in got if r.seed == "p0"]


def test_run_states(spark):
    made = [
        fold.event("r", 0, "fetch", "go", unique=9, ts=10.0),
        fold.event("r", 1, "score", "scored", papers=7),
        fold.event("r", 2, "extract", "todo", pending=7),
        fold.event("r", 3, "extract", "done", extracted=5, total=6, limitations="x"),
        fold.event("r", 4, "graph", "built", stats={"nodes": 4, "edges": 3}),
        *fold.answer_events("r", iter(["see [P", "1] and ", "[C9]"]), {"P1"}, 5),
        fold.event("r", 9, "done", "end"),
        fold.event("s", 0, "extract", "todo", pending=3),
        fold.event("s", 1, "answer", "model failed", kind="error"),
        fold.event("s", 2, "error", "all failed", kind="error"),
    ]
    for i, e in enumerate(made):
        e["ts"] = 10.0 + i
    random.Random(1).shuffle(made)
    got = {r.run_id: r for r in fold.run_states(spark.createDataFrame([tuple(e[c] for c in ("run_id", "seq", "phase", "kind", "message", "payload", "ts")) for e in made], fold.EVENT)).collect()}
    r, s = got["r"], got["s"]
    assert r.seen == ["fetch", "score", "extract", "graph", "answer", "done"] and r.phase == "answer" and r.answer == "see [P1] and [C9]"
    assert r.counters == {"papers": 7, "extracted": 5, "extract_total": 6, "nodes": 4, "edges": 3} and (r.complete, r.citations, r.elapsed) == (True, ["P1"], 9.0)
    assert (s.error, s.phase, s.finished_at, s.counters) == ("all failed", "error", None, {"extract_total": 3}) and s.seen == ["extract", "answer"]
    assert fold.counter_line(r.counters, 30) == "papers=7   nodes=4   (+3 more)" and fold.counter_line({}) == "no counters yet"
    with pytest.raises(ValueError):
        fold.event("r", 1, "nowhere", "x")


def test_progress_stops_on_systemic_failures(spark):
    seen = []
    items = spark.createDataFrame([(f"i{k}",) for k in range(10)], "id string")
    work = lambda df: df.withColumn("bad", F.col("id") == "i4")
    out = fold.progress(items, work, 3, lambda d: d.where("bad").limit(1).count() > 0, lambda k, d: seen.append((k, d.count())))
    assert seen == [(0, 3), (1, 3)] and out.count() == 6


@pytest.mark.parametrize("first", [2, 256])
def test_gaps_of_many_words_collect_none_of_them(spark, first):
    """Above SMALL_WORDS no row holds all words of a gap, whether the first candidates answer every gap or not."""
    words = spark.range(150_002).select((F.col("id") % 2).alias("gap"), F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit("xyz")).alias("word"))
    of = lambda *ids: " ".join("w" + "".join("abcdefghij"[int(d)] for d in str(i)) + "xyz" for i in ids)
    c = [("p1", None, f"we address {of(10, 20)}"), ("p2", None, f"we address {of(11)}"), ("p3", 2001, of(11, 13, 15)), ("p4", 2002, f"we address {of(11, 13, 14)}"), ("p5", 2003, f"we address {of(11, 15, 17, 20, 30)}")]
    old, gaps.SMALL_WORDS, gaps.FIRST = (gaps.SMALL_WORDS, getattr(gaps, "FIRST", None)), 100_000, first
    try:
        found = gaps.closed_by(spark.createDataFrame([(0, 2000), (1, 2000)], "gap long, newest int"), words, spark.createDataFrame([(0, "p9")], "gap long, paper_id string"), spark.createDataFrame(c, "paper_id string, year int, text string"))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert {r.gap: (r.closer, r.shared) for r in found.collect()} == {0: ("p1", [of(10), of(20)]), 1: ("p4", [of(11), of(13)])}
    finally:
        gaps.SMALL_WORDS, gaps.FIRST = old
    assert "array_intersect" not in plan


def test_arms_without_shared_papers_are_null_as_in_sql(spark, monkeypatch):
    from citemill.plans import catalog

    monkeypatch.setattr(evaluate, "graph_arm", lambda *_: (None, spark.createDataFrame([], "id string")))
    assert [r.shared for r in catalog.u5_arm_overlap(spark, "/root/testdata/sf0.001").collect()] == [None]


def test_themes_close_without_an_array_of_their_words(spark, monkeypatch):
    monkeypatch.setattr(gaps, "SMALL_WORDS", 0)
    papers = spark.createDataFrame([("a", "Old paper", 2010), ("b", "New paper", 2020)], "id string, title string, year int")
    ex = spark.createDataFrame([("a", "training cost is large", ""), ("b", "", "We address training cost here"), ("d", "data is scarce", "y")], "paper_id string, stated_limitation string, summary string")
    rows = gaps.limitation_rows(ex, papers, (("cost", ("cost",)), ("data", ("data",))))
    texts = []
    monkeypatch.setattr(gaps, "materialize", lambda df, label, cut=gaps.materialize: (texts.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df, label))[1])
    kept, closed = gaps.kept_and_closed(gaps.ranked(gaps.themes(rows), spark.createDataFrame([], "id string, name string, year int")), rows, ex, papers, ("we address",))
    assert [(r.key, r.closer, r.shared) for r in closed.collect()] == [("theme:cost", "b", ["paper", "training"])] and [r.key for r in kept.collect()] == ["theme:data"]
    assert not any("collect_set" in t and "array_intersect" in t and "AS words" in t for t in texts)


def test_report_lines_collect_no_texts(spark):
    ex = spark.createDataFrame([("a", "training cost is large", ""), ("b", "its cost", "x"), ("d", "data is scarce", "y")], "paper_id string, stated_limitation string, summary string")
    papers = spark.createDataFrame([("a", "Old paper", 2010)], "id string, title string, year int")
    parts = gaps.gap_report(ex, papers, theme_rules=(("cost", ("cost",)), ("data", ("data",))))
    lines = gaps.report_lines(parts)
    import re

    assert not [x for x in re.findall(r"collect_list\(([^\n]*?)\) AS", lines._jdf.queryExecution().optimizedPlan().toString()) if "limitation" in x]
    assert [r.line for r in lines.where("section = 6").orderBy("place").collect()][0].endswith("- evidence: training cost is large")
    assert {r.theme: (r.labels, r.evidence) for r in parts["themes"].collect()}["cost"] == (["L1", "L2"], ["training cost is large", "its cost"])


def test_themes_are_closed_by_what_the_first_candidates_say(spark, monkeypatch):
    """Of whole texts, only words that the first candidates say are written, and only these candidates' texts are split into words."""
    papers = spark.createDataFrame([("a", "Old", 2010), ("b", "New", 2020), ("c", "Newer", 2021), ("e", "Older", 2011)], "id string, title string, year int")
    said = [("a", "training costs grow", ""), ("b", "", "We address training costs here"), ("c", "", "We address scarce labels where data remains"), ("e", "data remains scarce", "")]
    ex = spark.createDataFrame(said, "paper_id string, stated_limitation string, summary string")
    rows = gaps.limitation_rows(ex, papers, (("cost", ("cost",)), ("data", ("data",))))
    found = gaps.ranked(gaps.themes(rows), spark.createDataFrame([], "id string, name string, year int"))
    words, plans = [], {}

    def noted(df, label, cut=gaps.materialize):
        plans[label], out = df._jdf.queryExecution().optimizedPlan().toString(), cut(df, label)
        words.extend([(r.gap, r.word) for r in out.collect()] if label in ("gap_words", "words_left") else [])
        return out

    monkeypatch.setattr(gaps, "materialize", noted)
    for first, few in ((256, 100_000), (1, 100_000), (1, 0)):
        monkeypatch.setattr(gaps, "FIRST", first)
        monkeypatch.setattr(gaps, "SMALL_WORDS", few)
        words.clear(), plans.clear()
        kept, closed = gaps.kept_and_closed(found, rows, ex, papers, ("we address",))
        assert sorted((r.key, r.closer, r.shared) for r in closed.collect()) == [("theme:cost", "b", ["costs", "training"]), ("theme:data", "c", ["remains", "scarce"])]
        plan = plans["first_words"]
        assert not kept.count() and 0 < plan.index("LeftOuter") < plan.index("LeftSemi")  # texts are picked before they are joined and split
        assert first == 1 or sorted(words) == [("theme:cost", "costs"), ("theme:cost", "training"), ("theme:data", "remains"), ("theme:data", "scarce")]
