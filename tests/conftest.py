from __future__ import annotations

import pytest

from tidemark.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session(4, memory="4g", shuffle_partitions=4, app="tests")


def rows(df):
    """Rows as a sorted list of tuples, nulls first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: [(v is not None, str(v)) for v in t])


def hollow(data, folder, rows):
    """Copies of all tables with the same columns and ``rows`` rows of nulls."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder.mkdir()
    for f in data.glob("*.parquet"):
        schema = pa.schema([pa.field(x.name, x.type, True) for x in pq.read_schema(f)])
        pq.write_table(pa.table([pa.array([None] * rows, type=x.type) for x in schema], schema=schema), folder / f.name)
    return str(folder)
