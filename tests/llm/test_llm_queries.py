from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import oracle_check
from tests.conftest import hollow
from tidemark.llm.queries import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.mark.parametrize("name", catalog.queries)
def test_query(spark, name):
    df = entry.queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in catalog.sql:
        con = duckdb.connect()
        oracle_check.views(con, DATA)
        cur = con.execute(catalog.sql[name])
        cols = [d[0] for d in cur.description]
        assert oracle_check.bag(df.columns, rows) == oracle_check.bag(cols, cur.fetchall())


@pytest.mark.parametrize("rows", [0, 3])
def test_empty_tables_and_tables_of_nulls(spark, tmp_path, rows):
    d = hollow(Path(DATA), tmp_path / "d", rows)
    for name in catalog.queries:
        assert catalog.queries[name](spark, d).collect() == [], name
