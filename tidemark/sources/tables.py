"""Parquet tables of one directory, as DataFrames with settled types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; zone-less timestamps are taken as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def load_texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose rows cost far more work than their bytes tell.

    A table that lies in fewer pieces than there are cores - one small file - is dealt out to all of
    them; a large one is read as it lies.
    """
    df = load(spark, sf_dir, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
