"""Point-in-time lookups: snapshots in force, validity ranges, entity resolution, coverage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.snapshots import snapshot_calendar


def in_force(days: DataFrame, snapshots: DataFrame, *, day: str, date: str) -> DataFrame:
    """(day, date): the latest snapshot on or before each distinct day; days before the first have none.

    A window over distinct days and snapshot dates, of which the calendar bounds the number.
    """
    cal = snapshots.select(F.col(date).alias("_d")).where("_d IS NOT NULL").distinct()
    asked = days.select(F.col(day).alias("_d")).where("_d IS NOT NULL").distinct()
    both = asked.select("_d", F.lit(None).cast("date").alias("_s"), F.lit(1).alias("_q")).unionByName(
        cal.select("_d", F.col("_d").alias("_s"), F.lit(0).alias("_q"))
    )
    last = F.last("_s", ignorenulls=True).over(W.orderBy("_d", "_q").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("_s", last).where("_q = 1 AND _s IS NOT NULL").select(F.col("_d").alias(day), F.col("_s").alias(date))


def members_as_of(days: DataFrame, membership: DataFrame, *, day: str, date: str, member: str) -> DataFrame:
    """(day, date, member): all members of the snapshot in force on each distinct day."""
    return in_force(days, membership, day=day, date=date).join(membership.select(date, member).where(F.col(member).isNotNull()).distinct(), date).select(day, date, member)


def snapshots_in_period(membership: DataFrame, date: str, start: str, end: str) -> DataFrame:
    """Rows of the snapshots in force at any time in [start, end], the one live on ``start`` included."""
    first = membership.where(F.col(date) <= F.lit(start).cast("date")).agg(F.max(date).alias("_first"))
    return membership.join(first, (F.col(date) >= F.col("_first")) & (F.col(date) <= F.lit(end).cast("date"))).drop("_first")


def member_windows(membership: DataFrame, *, date: str, member: str, end: str) -> DataFrame:
    """(member, first_day, last_day): first and last day a member was in any snapshot, gaps aside."""
    cal = snapshot_calendar(membership, date)
    stop = F.lit(end).cast("date")
    last = F.least(F.coalesce(F.date_sub("next_date", 1), stop), stop)
    return (
        membership.where(F.col(member).isNotNull()).select(date, member).distinct().join(cal, date)
        .groupBy(member).agg(F.min(date).alias("first_day"), F.max(last).alias("last_day"))
    )


BASE, LEVELS = 16, 6  # blocks of 1, 16, 256, ... days; six levels hold the whole calendar
_FIRST_DAY, _LAST = "0001-01-01", 3_652_058  # 9999-12-31


def _aligned(first: Column, last: Column) -> Column:
    """The aligned blocks (level, block) that make up the days [first, last], at most twice BASE a level:
    those inside of it whose own greater block is not."""

    def inner(width: int) -> tuple[Column, Column]:
        return F.ceil(first / F.lit(width)).cast("int"), (F.floor((last + 1) / F.lit(width)) - 1).cast("int")

    none, blocks = F.array().cast("array<int>"), []
    run = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(none)
    for level in range(LEVELS):
        (lo, hi), (up_lo, up_hi) = inner(BASE**level), inner(BASE ** (level + 1))
        own = F.when(up_lo <= up_hi, F.concat(run(lo, up_lo * BASE - 1), run((up_hi + 1) * BASE, hi))).otherwise(run(lo, hi))
        blocks.append(F.transform(own, _of_level(level)))
    return F.concat(*blocks)


def _of_level(level: int) -> Callable[[Column], Column]:
    return lambda k: F.struct(F.lit(level).alias("level"), k.alias("block"))


def resolve_validity(
    asked: DataFrame, ranges: DataFrame, *, key: str, day: str, valid_from: str, valid_to: str, order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Each asked row with the values of the range of its key that holds its day, both ends inclusive.

    Of several, the first by ``order``; where none holds the day but the key has exactly one range,
    that one.  Null bounds are open.  Each distinct (key, day) is looked up once.

    A range is cut into aligned blocks of 1, 16, 256, ... days, of which only the first range by
    ``order`` is kept, and a day asks the one block of each width that holds it: work grows with
    ranges and days, never with their product, and a hot key spreads over its blocks.
    """
    kept = ranges.where(F.col(key).isNotNull()).select(key, F.col(valid_from).alias("_from"), F.col(valid_to).alias("_to"), F.struct(*order).alias("_o"), F.struct(*[F.col(v).alias(v) for v in values]).alias("_v"))
    origin = F.lit(_FIRST_DAY).cast("date")
    bounded = kept.select(key, "_o", "_v", F.coalesce(F.datediff("_from", origin), F.lit(0)).alias("_a"), F.coalesce(F.datediff("_to", origin), F.lit(_LAST)).alias("_b")).where("_a <= _b")
    blocks = bounded.select(key, F.inline(_aligned(F.col("_a"), F.col("_b"))), "_o", "_v").groupBy(key, "level", "block").agg(F.min(F.struct("_o", "_v")).alias("_best"))
    at = F.datediff(day, origin)
    looks = F.array(*[F.struct(F.lit(n).alias("level"), F.floor(at / F.lit(BASE**n)).cast("int").alias("block")) for n in range(LEVELS)])
    days = asked.select(key, day).where(F.col(key).isNotNull() & F.col(day).isNotNull()).distinct()
    held = days.select(key, day, F.inline(looks)).join(blocks, [key, "level", "block"]).groupBy(key, day).agg(F.min("_best").alias("_best"))
    only = kept.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_only")).where("_n = 1").drop("_n")
    found = asked.join(held, [key, day], "left").join(only, key, "left").withColumn("_v", F.coalesce("_best._v", "_only"))
    return found.select(*asked.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def near_window(pairs: DataFrame, activity: DataFrame, *, key: str, first: str, last: str, at: str, pad_days: int) -> DataFrame:
    """Rows of ``pairs`` whose key was active at least once within the padded window, inclusive.

    Windows are cut into aligned blocks and meet the blocks in which their key was active, so a key
    with many activities and many windows is never multiplied out.  A row without a key or a bound
    is not near.
    """
    origin = F.lit(_FIRST_DAY).cast("date")
    day = F.datediff(at, origin)
    seen = F.array(*[F.struct(F.lit(n).alias("level"), F.floor(day / F.lit(BASE**n)).cast("int").alias("block")) for n in range(LEVELS)])
    active = activity.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_k"), F.inline(seen)).distinct()
    windows = pairs.select(F.col(key).alias("_k"), F.col(first).alias("_first"), F.col(last).alias("_last")).dropna().distinct()
    lo, hi = F.datediff("_first", origin) - pad_days, F.datediff("_last", origin) + pad_days
    spans = windows.where(lo <= hi).select("_k", "_first", "_last", F.inline(_aligned(F.greatest(lo, F.lit(0)), hi)))
    near = spans.join(active, ["_k", "level", "block"], "left_semi").select("_k", "_first", "_last").distinct()
    return pairs.join(near, (F.col(key) == F.col("_k")) & (F.col(first) == F.col("_first")) & (F.col(last) == F.col("_last")), "left_semi")


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by a total order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
