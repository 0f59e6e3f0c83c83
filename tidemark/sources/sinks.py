"""Sinks: tables, appended logs, upserts by key, JSON and Markdown reports, and a read-through cache."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a CSV log; each part carries the header, so readers see one table."""
    df.coalesce(1).write.mode("append").option("header", True).csv(path)


def latest_runs(log: DataFrame, key: str = "config_hash", at: str = "run_at") -> DataFrame:
    """The last row of each key of an append-only log; of equal times the greatest row."""
    rest = [c for c in log.columns if c not in (key, at)]
    best = log.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("_r"))
    return best.select(key, "_r.*").select(*log.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in place of those with equal keys; null keys are equal."""
    hit = [old[k].eqNullSafe(new[k]) for k in keys]
    on = hit[0]
    for h in hit[1:]:
        on = on & h
    return old.join(new, on, "left_anti").unionByName(new)


def not_done(work: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work whose key the cache does not hold, valid or not."""
    return work.join(cache.select(*keys).distinct(), list(keys), "left_anti")


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON document per row, keys in alphabetical order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("json"))


def settings_hash(df: DataFrame, settings: Sequence[str]) -> DataFrame:
    """Adds ``config_hash``: twelve hex digits over the settings as JSON with sorted keys."""
    body = F.to_json(F.struct(*sorted(settings)), {"ignoreNullFields": "false"})
    return df.withColumn("config_hash", F.substring(F.sha2(body, 256), 1, 12))


def markdown_table(df: DataFrame, digits: int = 4, max_rows: int = 1000) -> str:
    """A report table of a small result (a row per period, year or variant); longer ones end with a note."""
    rows = df.limit(max_rows + 1).collect()
    show = lambda v: "–" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    body = ["| " + " | ".join(show(v) for v in r) + " |" for r in rows[:max_rows]]
    return "\n".join([*lines, *body]) + "\n" + (f"\nOnly the first {max_rows} rows are shown.\n" if len(rows) > max_rows else "")


def nested_json(parts: Mapping[str, DataFrame], max_rows: int = 1000) -> str:
    """One JSON document of several small results, each a list of its rows."""
    found = {}
    for name, df in parts.items():
        rows = df.limit(max_rows + 1).collect()
        if len(rows) > max_rows:
            raise ValueError(f"{name} has more than {max_rows} rows; write it as a table")
        found[name] = [r.asDict(recursive=True) for r in rows]
    return json.dumps(found, indent=2, default=str, sort_keys=True)


def checked_bytes(path: str, sha256: str) -> bytes:
    """A pinned file; raises where its digest differs."""
    import hashlib

    with open(path, "rb") as f:
        data = f.read()
    if hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError(f"{path} does not have the pinned digest")
    return data


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of stored documents, plain or gzip by suffix."""

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["content"] = [gzip.decompress(raw) if p.endswith(".gz") else raw for p, raw in zip(pdf["path"], pdf["content"])]
            yield pdf

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(plain, "path string, content binary")
