"""As-of joins without row explosion: union of both sides and one ordered window per time slice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ticks(df: DataFrame, col: str) -> Column:
    """A date as days, a timestamp as microseconds, a number as it is."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(col).cast("timestamp"))
    return F.col(col).cast("long")


def slice_of(tick: Column, width: int) -> Column:
    return F.floor(tick / F.lit(width)).cast("long")


def carried_in(right: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., _t, _s, _slice): for every wanted (keys, slice) the last right row of an earlier slice.

    ``right`` is (keys..., _t, _s, _slice).  The window runs over one row per key and slice, so it
    stays small for a key of any size.
    """
    keys = list(keys)
    lasts = right.groupBy(*keys, "_slice").agg(F.max(F.struct("_t", "_s")).alias("_last"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(None).cast(lasts.schema["_last"].dataType)
    return (
        wanted.select(*keys, "_slice", F.lit(1).alias("_wanted"), none.alias("_last"))
        .unionByName(lasts.withColumn("_wanted", F.lit(0)))
        .groupBy(*keys, "_slice").agg(F.max("_wanted").alias("_wanted"), F.max("_last").alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(before))
        .where("_wanted = 1 AND _carry IS NOT NULL")
        .select(*keys, F.col("_carry._t").alias("_t"), F.col("_carry._s").alias("_s"), "_slice")
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    direction: str = "backward",
    exact: bool = True,
    slice_width: int | None = None,
    shift: int = 0,
) -> DataFrame:
    """Every left row with ``values`` of the nearest right row of its keys, before or after it.

    ``exact`` admits equal times; ``shift`` (days, microseconds or units of the time column) moves
    the left time first, so ``shift=-270`` days looks at least 270 days back.  Of several right
    rows at one time the one with the greatest ``values`` tuple counts, nulls lowest.

    With ``slice_width`` the window runs per (keys, time slice) with the last row of earlier slices
    carried in; without, per keys - right only where a key's rows are known to be few.

    Left rows with null keys or time, or without a partner, keep null values; the right time comes
    along if it is among ``values``.  Value columns must not be named like left columns.
    """
    keys, values = list(keys), list(values)
    sign = 1 if direction == "backward" else -1
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"value columns named like left columns: {sorted(clash)}")
    width = slice_width or 1
    at = (lambda c: slice_of(c, width)) if slice_width else (lambda c: F.lit(0).cast("long"))
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    lt = left.withColumn("_t", (ticks(left, left_time) + shift) * sign)
    lt = lt.withColumn("_slice", at(F.col("_t")))
    state = F.struct(*[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)], F.lit(0).alias("_one"))
    rt = (
        right.where(present & F.col(right_time).isNotNull())
        .select(*[F.col(k).alias(k) for k in keys], (ticks(right, right_time) * sign).alias("_t"), state.alias("_s"))
        .groupBy(*keys, "_t").agg(F.max("_s").alias("_s"))
        .withColumn("_slice", at(F.col("_t")))
    )
    if slice_width:
        wanted = lt.where(present & F.col("_t").isNotNull()).select(*keys, "_slice").distinct()
        rt = rt.join(wanted, [*keys, "_slice"], "left_semi").select(*keys, "_t", "_s", "_slice").unionByName(carried_in(rt, wanted, keys))
    none = F.lit(None).cast(rt.schema["_s"].dataType)
    row = F.struct(*left.columns)
    both = lt.select(*keys, "_t", "_slice", row.alias("_row"), none.alias("_s"), F.lit(1 if exact else 0).alias("_side")).unionByName(
        rt.select(*keys, "_t", "_slice", F.lit(None).cast(lt.select(row.alias("r")).schema["r"].dataType).alias("_row"), "_s", F.lit(0 if exact else 1).alias("_side"))
    )
    order = W.partitionBy(*keys, "_slice").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    hit = F.when(present & F.col("_t").isNotNull(), F.last("_s", ignorenulls=True).over(order))
    out = both.withColumn("_hit", hit).where("_row IS NOT NULL")
    return out.select("_row.*", *[F.col(f"_hit._v{i}").alias(v) for i, v in enumerate(values)])
