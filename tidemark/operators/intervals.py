"""Day ranges per entity: continuous coverage and its gaps, merged on two levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.normal import MAX_DAY
from tidemark.session import stage

FIRST = -719162  # days from 1970-01-01 to 0001-01-01


def _start(shard: Column, width: int) -> Column:
    return (shard * width + FIRST).cast("int")


def _shard(day: Column, width: int) -> Column:
    return F.floor((day - FIRST) / F.lit(width)).cast("int")


def coverage(df: DataFrame, *, keys: Sequence[str], valid_from: str, valid_to: str, shard_days: int = 1024) -> DataFrame:
    """Continuous periods covered by inclusive day ranges: (keys..., _a, _b) as day numbers,
    the end exclusive, periods of a key disjoint and not touching.

    Null bounds are open (0001-01-01, 9999-12-31); a range that ends before it begins covers
    nothing; rows with a null key are ignored.

    Method: a range is clipped into time shards of ``shard_days``; its first and last shard give
    local pieces, the shards between one span, so an open range costs three rows.  Pieces merge
    within (key, shard), where pre-aggregation leaves at most one row per day.  Then only what
    touches a shard's edge, and the spans, are stitched per key: at most a few rows per shard of
    the calendar, however many rows the key has.
    """
    keys = list(keys)
    a = F.coalesce(F.unix_date(F.col(valid_from).cast("date")), F.lit(FIRST))
    b = F.coalesce(F.unix_date(F.col(valid_to).cast("date")), F.unix_date(F.lit(MAX_DAY).cast("date"))) + 1
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    ranges = (
        df.where(present).select(*keys, a.alias("_a"), b.alias("_b")).where(F.col("_a") < F.col("_b"))
        .groupBy(*keys, "_a").agg(F.max("_b").alias("_b"))
    )
    first, last = _shard(F.col("_a"), shard_days), _shard(F.col("_b") - 1, shard_days)
    ranges = ranges.withColumns({"_s0": first, "_s1": last})
    s0, s1, nul = F.col("_s0"), F.col("_s1"), F.lit(None).cast("int")

    def piece(shard: Column, lo: Column, hi: Column, upto: Column) -> Column:
        return F.struct(shard.alias("_shard"), lo.cast("int").alias("_a"), hi.cast("int").alias("_b"), upto.alias("_upto"))

    pieces = F.when(s0 == s1, F.array(piece(s0, F.col("_a"), F.col("_b"), nul))).otherwise(
        F.array(
            piece(s0, F.col("_a"), _start(s0 + 1, shard_days), nul),
            piece(s1, _start(s1, shard_days), F.col("_b"), nul),
            piece(s0 + 1, _start(s0 + 1, shard_days), _start(s1, shard_days), s1 - 1),
        )
    )
    cut = (
        ranges.select(*keys, F.inline(pieces)).where(F.col("_upto").isNull() | (F.col("_upto") >= F.col("_shard")))
        .groupBy(*keys, "_shard", F.col("_upto").isNotNull().alias("_span"), "_a").agg(F.max("_b").alias("_b"), F.max("_upto").alias("_upto"))
    )
    local = W.partitionBy(*keys, "_shard").orderBy("_a")
    before = local.rowsBetween(W.unboundedPreceding, -1)
    merged = (
        cut.where(~F.col("_span"))
        .withColumn("_new", F.coalesce((F.col("_a") > F.max("_b").over(before)).cast("int"), F.lit(1)))
        .withColumn("_run", F.sum("_new").over(local))
        .groupBy(*keys, "_shard", "_run").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    )
    # one row per (key, shard); the array holds at most shard_days / 2 runs
    shards = merged.groupBy(*keys, "_shard").agg(F.collect_list(F.struct("_a", "_b")).alias("_runs")).withColumn("_upto", nul)
    spans = cut.where("_span").select(*keys, "_shard", F.lit(None).cast("array<struct<_a:int,_b:int>>").alias("_runs"), "_upto")
    by_key = W.partitionBy(*keys).orderBy("_shard", F.col("_runs").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    full = F.array(F.struct(_start(F.col("_shard"), shard_days).alias("_a"), _start(F.coalesce("_upto", "_shard") + 1, shard_days).alias("_b")))
    covered = F.col("_runs").isNull() | (F.coalesce(F.max("_upto").over(by_key), F.lit(-1)) >= F.col("_shard"))
    settled = (
        shards.unionByName(spans).withColumn("_cov", covered)
        .select(*keys, "_shard", F.inline(F.when(F.col("_cov"), full).otherwise(F.col("_runs"))))
    )
    lo, hi = _start(F.col("_shard"), shard_days), _start(F.col("_shard") + 1, shard_days)
    touches = (F.col("_a") == lo) | (F.col("_b") >= hi)
    settled = stage(settled.withColumn("_edge", touches), "settled")  # read twice, and once more by the gaps
    stitch = W.partitionBy(*keys).orderBy("_a", "_b")
    edge = (
        settled.where("_edge")
        .withColumn("_new", F.coalesce((F.col("_a") > F.max("_b").over(stitch.rowsBetween(W.unboundedPreceding, -1))).cast("int"), F.lit(1)))
        .withColumn("_run", F.sum("_new").over(stitch.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*keys, "_run").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b")).drop("_run")
    )
    return settled.where(~F.col("_edge")).select(*keys, "_a", "_b").unionByName(edge.select(*keys, "_a", "_b"))


def periods_and_gaps(df: DataFrame, *, keys: Sequence[str], valid_from: str, valid_to: str, shard_days: int = 1024) -> DataFrame:
    """(keys..., kind, day_from, day_to): the periods of :func:`coverage` and the gaps between
    successive periods of a key, both days inclusive.

    The next period is looked up within the shard in which a period begins; only the last of a
    shard looks at the first of the key's next shard, so no task orders all periods of a key.
    """
    keys = list(keys)
    periods = coverage(df, keys=keys, valid_from=valid_from, valid_to=valid_to, shard_days=shard_days).withColumn(
        "_shard", _shard(F.col("_a"), shard_days)
    )
    heads = periods.groupBy(*keys, "_shard").agg(F.min("_a").alias("_head"))
    heads = heads.select(*keys, "_shard", F.lead("_head").over(W.partitionBy(*keys).orderBy("_shard")).alias("_next_head"))
    within = W.partitionBy(*keys, "_shard").orderBy("_a")
    nxt = periods.join(heads, [*keys, "_shard"]).withColumn("_next", F.coalesce(F.lead("_a").over(within), F.col("_next_head")))
    as_day = lambda c: F.date_from_unix_date(c)
    out = F.array(
        F.struct(F.lit("period").alias("kind"), as_day(F.col("_a")).alias("day_from"), as_day(F.col("_b") - 1).alias("day_to")),
        F.struct(F.lit("gap").alias("kind"), as_day(F.col("_b")).alias("day_from"), as_day(F.col("_next") - 1).alias("day_to")),
    )
    return nxt.select(*keys, F.inline(out)).where((F.col("kind") == "period") | F.col("day_to").isNotNull())
