"""Attributes as known at event time: bucketed ASOF joins on availability-ordered versions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.asof import carried_in, slice_of, ticks
from tidemark.operators.intervals import coverage
from tidemark.session import stage

_connections: list = []


def _connection():
    """One embedded engine per Python worker."""
    import duckdb

    if not _connections:
        con = duckdb.connect()
        con.execute("SET threads=1")
        con.execute("SET memory_limit='400MB'")
        _connections.append(con)
    return _connections[0]


def known_as_of(
    events: DataFrame,
    versions: DataFrame,
    *,
    keys: Sequence[str],
    event_time: str,
    version_time: str,
    values: Sequence[str],
    slice_width: int,
    rows_per_task: int = 100_000,
    buckets: int | None = None,
) -> DataFrame:
    """Every event with the values of the latest version of its keys that was available at its time.

    ``version_time`` is when a version became known; a version counts from that very tick on and
    nothing that became known later is used.  Times are dates, timestamps or numbers of one kind;
    ``slice_width`` is in days, microseconds or those numbers.

    Method: entities are hashed into buckets and time is cut into slices; each (bucket, slice)
    runs an ASOF LEFT JOIN in an embedded DuckDB.  A slice holds the versions that became known in
    it and, per entity with events there, the one carried in from before, so neither a hot entity's
    versions nor its events gather in one task.  The number of buckets follows from the counted
    rows.  Only an entity that has more than ``rows_per_task`` events in a slice is salted: its
    events are dealt to as many buckets, and its own versions of that slice alone go to each.

    Ties (several versions of an entity at one tick) are settled before the join: the greatest
    tuple of ``values``, nulls lowest.  Events with a null key or time, or without any version,
    are kept with null values; repeated events stay repeated.  A value named like an event column
    comes out with ``_known`` appended.  ``events`` is read several times: write costly ones first.
    """
    keys, values = list(keys), list(values)
    spark = events.sparkSession
    names = {v: v if v not in events.columns else f"{v}_known" for v in values}
    left = events.withColumn("_t", ticks(events, event_time))
    left = left.withColumn("_slice", slice_of(F.col("_t"), slice_width))
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    state = F.struct(*[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)], F.lit(0).alias("_one"))
    right = (
        versions.where(present & F.col(version_time).isNotNull())
        .select(*[F.col(k).alias(k) for k in keys], ticks(versions, version_time).alias("_t"), state.alias("_s"))
        .groupBy(*keys, "_t").agg(F.max("_s").alias("_s"))
        .withColumn("_slice", slice_of(F.col("_t"), slice_width))
    )
    right = stage(right, "versions")  # read by the slices and by what is carried in
    counted = left.where(present & F.col("_t").isNotNull()).groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    counted = stage(counted, "wanted")  # read by both and by the counts
    wanted = counted.select(*keys, "_slice")
    carried = carried_in(right, wanted, keys)
    right = right.join(wanted, [*keys, "_slice"], "left_semi").select(*keys, "_t", "_s", "_slice").unionByName(carried)

    sizes = counted.agg(F.sum("_n").alias("n"), F.max("_n").alias("most")).first()
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(((sizes["n"] or 0) + versions.count()) / rows_per_task))
    left, right = left.withColumn("_salt", F.lit(0)), right.withColumn("_salt", F.lit(0))
    if (sizes["most"] or 0) > rows_per_task:
        hot = counted.where(F.col("_n") > rows_per_task).select(*keys, "_slice", F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_salts"))
        salts = F.coalesce("_salts", F.lit(1))
        left = left.join(hot, [*keys, "_slice"], "left").withColumn("_salt", F.pmod(F.xxhash64(*events.columns), salts).cast("int")).drop("_salts")
        right = right.join(hot, [*keys, "_slice"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    bucket = F.pmod(F.xxhash64(*keys, "_salt"), F.lit(n)).cast("int")
    left, right = left.withColumn("_bucket", bucket), right.withColumn("_bucket", bucket)
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # its own attributes, if both sides share a source
    right = right.select(*keys, "_t", F.col("_s.*"), "_bucket", "_slice", "_salt").drop("_one")

    group, keyed = ["_bucket", "_slice"], [*keys, "_salt"]
    kinds = {f.name: f for f in versions.schema.fields}
    schema = T.StructType([*events.schema.fields, *[T.StructField(names[v], kinds[v].dataType) for v in values]])
    event_cols = events.columns
    on = " AND ".join([*[f'l."{k}" = r."{k}"' for k in keyed], "l._t >= r._t"])
    sql = f"SELECT l._i, r._j FROM l ASOF LEFT JOIN r ON {on}"

    def asof(lt: pa.Table, rt: pa.Table) -> pa.Table:
        con = _connection()
        lk = lt.select([*keyed, "_t"]).append_column("_i", pa.array(range(lt.num_rows), pa.int64()))
        rk = rt.select([*keyed, "_t"]).append_column("_j", pa.array(range(rt.num_rows), pa.int64()))
        con.register("l", lk)
        con.register("r", rk)
        try:
            hit = con.sql(sql).to_arrow_table()
        finally:
            con.unregister("l")
            con.unregister("r")
        out = lt.select(event_cols).take(hit["_i"])
        for i, v in enumerate(values):
            out = out.append_column(names[v], rt[f"_v{i}"].take(hit["_j"]))
        return out

    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(asof, schema)


def presence_versions(ranges: DataFrame, keys: Sequence[str], valid_from: str, valid_to: str) -> DataFrame:
    """(keys..., known_on date, present): the state of disjoint inclusive day ranges from each bound on."""
    after = F.when(F.col(valid_to) < F.lit("9999-12-31").cast("date"), F.date_add(valid_to, 1))
    states = F.array(
        F.struct(F.col(valid_from).alias("known_on"), F.lit(True).alias("present")),
        F.struct(after.alias("known_on"), F.lit(False).alias("present")),
    )
    return ranges.select(*keys, F.inline(states)).where("known_on IS NOT NULL")


def periods_of_both(ranges: DataFrame, runs: DataFrame, *, entity: str, member: str, valid_from: str, valid_to: str, run_from: str, run_to: str) -> DataFrame:
    """(entity, member, _from, _to): the days on which a range of (entity, member) and a run of the
    member both hold; the ranges are merged to disjoint periods first, the runs are disjoint."""
    pair = [entity, member]
    merged = coverage(ranges, keys=pair, valid_from=valid_from, valid_to=valid_to)
    periods = merged.select(*pair, F.date_from_unix_date("_a").alias("_a"), F.date_from_unix_date(F.col("_b") - 1).alias("_b"))
    met = periods.join(runs.select(member, F.col(run_from).alias("_c"), F.col(run_to).alias("_d")), member)
    return met.select(*pair, F.greatest("_a", "_c").alias("_from"), F.least("_b", "_d").alias("_to")).where("_from <= _to")


def valid_keys(events: DataFrame, periods: DataFrame, *, entity: str, member: str, event_time: str, slice_days: int) -> DataFrame:
    """Each event once for every ``member`` of which a period (entity, member, _from, _to) holds its day.

    An event meets only the members whose periods touch its (entity, slice) - written out, as the
    join below reads them several times - and the embedded ASOF join on the states that the periods'
    bounds make known then says which of them hold on the day.  Both bounds are inclusive.
    """
    bounds = events.agg(F.min(event_time).alias("a"), F.max(event_time).alias("b")).first()
    pair = [entity, member]
    lo, hi = (F.unix_date(F.lit(x).cast("date")) for x in (bounds["a"], bounds["b"]))
    first, last = F.greatest(F.unix_date("_from"), lo), F.least(F.unix_date("_to"), hi)
    slices = F.sequence(F.floor(first / F.lit(slice_days)), F.floor(last / F.lit(slice_days)))
    at = F.floor(F.unix_date(event_time) / F.lit(slice_days))
    near = periods.where(first <= last).select(*pair, F.explode(slices).alias("_near")).distinct()
    candidates = stage(events.withColumn("_near", at).join(near, [entity, "_near"]).drop("_near"), "candidates")
    known = known_as_of(
        candidates, presence_versions(periods, pair, "_from", "_to"), keys=pair, event_time=event_time, version_time="known_on", values=["present"], slice_width=slice_days
    )
    return known.where("present").drop("present")
