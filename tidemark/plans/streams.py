"""Queries of the streaming extension, run over bounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import Catalog
from tidemark.session import pin
from tidemark.sources.tables import load
from tidemark.streaming import incremental

catalog = Catalog()


@catalog.query(
    "event_windows",
    """SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL""",
)
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    w = incremental.windowed_counts(load(pin(spark), d, "events"), time="ts", keys=["event_type"], value="value", width="6 hours")
    return w.select(F.unix_micros("window_start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))
