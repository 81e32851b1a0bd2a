import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from citemill.runtime import get_session

    session = get_session("tests", 4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return [_plain(x) for x in v]
    return v


def as_set(rows, columns):
    return sorted(str([_plain(r[c]) for c in columns]) for r in rows)


def agrees(spark, query, sql, sf=SF):
    """Asserts that a query and its SQL give the same columns and rows."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = query(spark, sf)
    got = [r.asDict(True) for r in df.collect()]
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = [dict(zip(names, r, strict=True)) for r in res.fetchall()]
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    assert as_set(got, columns) == as_set(want, columns)
