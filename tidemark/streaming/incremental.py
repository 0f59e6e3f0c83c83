"""Streaming extensions: windowed aggregates with late data, and a change signal kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, *, time: str, keys: list[str], value: str, width: str, slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """(window start and end, keys..., n, total) per tumbling or sliding window; works on a stream
    (rows later than ``lateness`` are dropped) and, unchanged, on a bounded table."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.withWatermark(time, lateness).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def change_signals(scores: DataFrame, *, entity: str, time: str, value: str) -> DataFrame:
    """(entity, at, value, change): each new score with its change against the entity's last one.

    The state is one number per entity.  A score older than the entity's last gives no change, as
    it became known too late to have been acted on.
    """
    kind = dict(scores.dtypes)[entity]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_at, last = state.getOption or (None, None)
        rows = pd.concat([*batches]).dropna(subset=["at", "value"]).sort_values("at")
        out = []
        for at, value in zip(rows["at"], rows["value"]):
            if last_at is not None and at < last_at:
                out.append((key[0], at, value, None))
                continue
            out.append((key[0], at, value, None if last is None else value - last))
            last_at, last = int(at), float(value)
        if last_at is not None:
            state.update((last_at, last))
        yield pd.DataFrame(out, columns=[entity, "at", "value", "change"])

    plain = scores.select(entity, F.unix_micros(time).alias("at"), F.col(value).cast("double").alias("value"))
    return plain.groupBy(entity).applyInPandasWithState(
        step, f"{entity} {kind}, at bigint, value double, change double", "at bigint, value double", "append", GroupStateTimeout.NoTimeout
    )
