"""Every query against its SQL at the smallest scale, and the contract of the entry module."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import oracle_check
from tests.conftest import hollow

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
CORE = [n for n, f in entry.queries().items() if ".llm" not in f.__module__]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    oracle_check.views(c, DATA)
    return c


@needs_data
@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    have = oracle_check.bag(df.columns, [tuple(r) for r in df.collect()])
    if name in entry.oracle_sql():
        cur = con.execute(entry.oracle_sql()[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert have == oracle_check.bag(cols, cur.fetchall())


@needs_data
def test_entry(spark):
    assert len(entry.entry(spark).collect()) == 1


def test_nothing_outside_imports_the_llm_package():
    root = Path(entry.__file__).parent / "tidemark"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "tidemark.llm" in p.read_text()]


@needs_data
@pytest.mark.parametrize("rows", [0, 3])
def test_empty_tables_and_tables_of_nulls(spark, tmp_path, rows):
    """The dealt problems and the readers of published formats find nothing there, and do not fail."""
    d = hollow(Path(DATA), tmp_path / "d", rows)
    for name in ("p1_found", "p2_found", "p2_pruning", "p5_found", "p6_found", "p7_found", "listed_tickers", "index_parse", "public_float", "long_short_monthly", "entity_resolution"):
        assert entry.queries()[name](spark, d).collect() == [], name
