"""A build from captured payloads, and the command line over it."""

import json

import pytest
from citemill import __main__ as cli
from citemill.plans import build as plan
from citemill.sources import readers
from pyspark.sql import functions as F

from tests.test_operators import PAYLOADS


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("captured")
    more = {
        "openalex": json.dumps({"results": [
            {"id": "https://openalex.org/W7", "display_name": "A title", "publication_year": 2021, "doi": "https://doi.org/10.1/x", "cited_by_count": 5, "concepts": [{"display_name": "Graph Net"}], "referenced_works": ["https://openalex.org/W8"]},
            {"id": "https://openalex.org/W8", "display_name": "Base work", "publication_year": 2015, "concepts": [{"display_name": "graph net"}, {"display_name": "Memory"}]},
        ]}),
        "semantic_scholar": PAYLOADS["semantic_scholar"],
        "dblp": "<html>",
    }
    for name, body in more.items():
        (root / name).mkdir()
        (root / name / "0.json").write_text(body)
    out = str(tmp_path_factory.mktemp("out") / "b")
    return str(root), out, plan.build(spark, readers.captured(spark, str(root)), "T", out)


def test_build_merges_extracts_and_links(spark, made):
    _, out, parts = made
    papers = {r.title: r for r in parts["papers"].collect()}
    assert set(papers) == {"A title", "Base work"}
    both = papers["A title"]
    assert both.sources == ["semantic_scholar", "openalex"] and both.citation_count == 5 and both.references == [papers["Base work"].id]
    assert (both.resolved, both.dropped) == (1, 1) and both.relevance_score == 3
    assert {r.name: len(r.paper_ids) for r in parts["concepts"].collect()} in ({"graph net": 2, "Memory": 1}, {"Graph Net": 2, "Memory": 1})
    kinds = {r.type: r["count"] for r in parts["edges"].groupBy("type").count().collect()}
    assert kinds == {"USES": 3, "CITES": 1}
    assert [tuple(r) for r in parts["failures"].collect()] == [("dblp", 0, "bad body")]
    again = plan.build(spark, readers.captured(spark, made[0]), "T", out + "2")
    assert again["extractions"].count() == 2


def test_a_second_build_extracts_nothing_again(spark, made):
    root, out, _ = made
    before = spark.read.text(f"{out}/extractions").count()

    def refuse(papers):
        raise AssertionError("nothing is pending")

    plan.build(spark, readers.captured(spark, root), "T", out, extractor=refuse)
    assert spark.read.text(f"{out}/extractions").count() == before
    states = plan.loaded(spark, out)["events"].where("phase = 'extract'").select(F.get_json_object("payload", "$.pending").alias("p")).where("p is not null").first().p
    assert states == "0"


def test_commands(spark, made, tmp_path):
    root, out, _ = made
    said = []
    for command in (["stats"], ["events"], ["doctor"], ["sources"], ["ask", "how did graph net evolve"], ["report"], ["eval", "--write", str(tmp_path / "e")], ["build", root], ["run", root]):
        said.clear()
        assert cli.main(["--out", out, *command], spark, said.append) == 0
        assert said
        if command[0] == "stats":
            assert "edge CITES: 1" in said
        if command[0] == "ask":
            assert any("concept" in x and "raph" in x for x in said)
    assert spark.read.text(str(tmp_path / "e")).count() > 5
