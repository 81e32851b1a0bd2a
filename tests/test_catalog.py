"""Every registered query of the library agrees with its SQL on the smallest tables."""

import pytest

from citemill.plans import captures, catalog  # noqa: F401
from tests.conftest import SF, agrees


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_sql(spark, name):
    agrees(spark, catalog.QUERIES[name], catalog.SQL[name])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_fold_merges_no_more_than_components(spark):
    from citemill.operators import dedup
    from citemill.plans import testdata as td
    from pyspark.sql import functions as F

    p = td.records(spark, SF)
    keys = dedup.match_keys(F.col("doi"), F.col("arxiv_id"), F.col("title"), F.col("id"), F.col("external_ids"))
    parts = {r.seq: r.cluster for r in dedup.clusters(p.withColumn("keys", keys)).collect()}
    rows = catalog.j1_first_match_fold(spark, SF).collect()
    assert len(rows) == len(parts) and any(r.survivor != r.ingest_seq for r in rows)
    assert all(parts[r.ingest_seq] == parts[r.survivor] and r.survivor <= r.ingest_seq for r in rows)
