"""Price connector: any source of daily closes behind one interface, and a table-backed one.

``PriceSource`` is what a vendor client implements; ``TablePrices`` serves a Parquet table through
Spark's Python data source API as ``spark.read.format("tidemark_prices")``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "date date, symbol string, adj_close double"


class PriceSource(Protocol):
    def fetch(self, symbols: Sequence[str], start: str, end: str) -> DataFrame:
        """(date, symbol, adj_close) of the symbols within the days, both included."""


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[_File]:
        import pyarrow.dataset as ds

        return [_File(f) for f in ds.dataset(self.options["path"], format="parquet").files]

    def read(self, part: _File) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        wanted = pa.schema([("date", pa.date32()), ("symbol", pa.string()), ("adj_close", pa.float64())])
        for batch in pq.ParquetFile(part.path).iter_batches(columns=wanted.names):
            yield pa.Table.from_batches([batch]).cast(wanted).combine_chunks().to_batches()[0]


class TablePrices(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_prices"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TablePrices)
