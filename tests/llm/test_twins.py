"""Every opN_ query with a SQL twin gives the twin's rows on the small tables."""

import os

import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def shown(names, rows):
    cols = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda x: "" if x is None else f"{x:.9g}" if isinstance(x, float) else repr(x)
    return [names[i] for i in cols], sorted(tuple(cell(r[i]) for i in cols) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.execute(SQL[name])
    assert shown(got.columns, got.collect()) == shown([c[0] for c in want.description], want.fetchall())
