"""Scalar rules on literal rows."""

import pytest
from pyspark.sql import functions as F

from citemill.functions import text as fx


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.mark.parametrize(
    ("given", "want"),
    [("https://doi.org/10.1/A", "10.1/a"), (" DOI:10.2/b ", "10.2/b"), ("https://doi.org/doi:10.3/c", "10.3/c"), ("11.1/x", ""), (None, ""), ("", "")],
)
def test_doi(spark, given, want):
    assert one(spark, x=fx.normalise_doi(F.lit(given).cast("string"))).x == want


def test_title_key_ignores_articles_marks_and_order(spark):
    r = one(spark, a=fx.title_key(F.lit("The Graph-Attention, a Survey")), b=fx.title_key(F.lit("survey of graph attention")))
    assert r.a == r.b == "attention graph survey"


@pytest.mark.parametrize(
    ("question", "kind"),
    [
        ("How do GAT and GCN compare?", "comparison"),
        ("What remains unsolved?", "gap"),
        ("How did attention evolve", "lineage"),
        ("Which methods are commonly used", "approaches"),
        ("Tell me", "full_report"),
        ("GAT vs. GCN: open problems", "comparison"),
        (None, "full_report"),
    ],
)
def test_question_kinds(spark, question, kind):
    assert one(spark, x=fx.classify_question(F.lit(question).cast("string"))).x == kind


def test_limitation_polarity(spark):
    own, prior = "Our model needs much memory.", "We address limitations of existing methods."
    r = one(spark, own=fx.prior_work_limitation(F.lit(own)), prior=fx.prior_work_limitation(F.lit(prior)))
    assert (r.own, r.prior) == (False, True)


def test_themes_first_rule_wins(spark):
    r = one(spark, a=fx.classify_theme(F.lit("does not scale to benchmarks")), b=fx.classify_theme(F.lit("few knowledge")), c=fx.classify_theme(F.lit("odd")))
    assert (r.a, r.b, r.c) == ("scalability", "real_world_deployment", "other")


def test_citations_are_checked(spark):
    checked, unknown = fx.checked_citations(F.lit("As [P1] shows [C7] and [P1]."), F.array(F.lit("P1")))
    r = one(spark, c=checked, u=unknown)
    assert (r.c, r.u) == ("As [P1] shows and [P1].", ["C7"])


def test_inverted_index_last_word_of_a_place_wins(spark):
    index = F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2)), F.lit("c"), F.array(F.lit(2)))
    assert one(spark, x=fx.abstract_from_index(index)).x == "a b c"


def test_unknown_poisons_strict_aggregates(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, 3.0)], "k int, v double")
    got = {r.k: (r.s, r.a) for r in df.groupBy("k").agg(fx.strict_sum(F.col("v")).alias("s"), fx.strict_avg(F.col("v")).alias("a")).collect()}
    assert got == {1: (None, None), 2: (3.0, 3.0)}


def test_cosine_of_zero_and_unlike_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, x=fx.cosine(v(0, 0), v(1, 0))).x == 0.0
    with pytest.raises(Exception, match="unlike width"):
        one(spark, x=fx.cosine(v(1), v(1, 2)))


def test_claim_support_needs_two_terms(spark):
    r = one(spark, a=fx.claim_supported(F.lit("may graph"), F.lit("graph")), b=fx.claim_supported(F.lit("graph attention wins"), F.lit("graph attention")))
    assert (r.a, r.b) == (None, True)
