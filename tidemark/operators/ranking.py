"""Cross-sectional ranks, buckets and rank correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import stage


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[k])
    return on


def ordinals(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Each row with its place, from 1, within its group by a total order of its columns ``order``.

    The table is cut into ranges of (groups, order) and written, so that no task ever holds a
    group: places are counted within a range and moved on by the sizes of the ranges before it, of
    which there are at most as many as shuffle partitions.  Null groups are a group.
    """
    cut = stage(df.repartitionByRange(*groups, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    placed = cut.withColumn("_place", F.row_number().over(W.partitionBy(*groups, "_range").orderBy(*order)))
    joined = placed.join(before, _same(placed, before, [*groups, "_range"]))
    return joined.select(*[placed[c] for c in df.columns], (F.col("_before") + F.col("_place")).alias(name))


def average_ranks(df: DataFrame, groups: Sequence[str], value: str, place: str, name: str) -> DataFrame:
    """The mean of the places of each value within its group, ties sharing it: (groups..., value, name)."""
    return df.groupBy(*groups, value).agg(F.avg(place).alias(name))


def bucket(rank: Column, n: Column, q: int) -> Column:
    """Quantile bucket 1..q of rank r of n by equal-width cuts of the ranks (not ``ntile``)."""
    step = F.floor(((rank - 1) * q + n - 2) / F.when(n > 1, n - 1))
    return F.greatest(F.lit(1), F.coalesce(step, F.lit(1))).cast("int")


def rank_correlation(df: DataFrame, groups: Sequence[str], x: str, y: str, *, x_place: str | None = None) -> DataFrame:
    """(groups..., n, ic): Spearman correlation per group; null where a side has under two values.

    Rows where either side is null or NaN are left out.  ``x_place`` names a column that already
    holds each row's place by ``x`` within its group.  Groups may be of any size, see :func:`ordinals`.
    """
    groups = list(groups)
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    ok = ok.select(*groups, F.col(x).alias("_x"), F.col(y).alias("_y"), *([F.col(x_place).alias("_px")] if x_place else []))
    if not x_place:
        ok = ordinals(ok, groups, ["_x"], "_px")
    ok = ordinals(ok, groups, ["_y"], "_py")
    for value, place, rank in (("_x", "_px", "_rx"), ("_y", "_py", "_ry")):
        ranks = average_ranks(ok.select(*groups, F.col(value).alias("_v"), place), groups, "_v", place, rank)
        ranks = ranks.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "_v", rank)
        on = F.col(value) == F.col("_v")
        for i, g in enumerate(groups):
            on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
        ok = ok.join(ranks, on).drop("_v", *[f"_g{i}" for i in range(len(groups))])
    enough = (F.min("_x") < F.max("_x")) & (F.min("_y") < F.max("_y"))
    # not corr(): it raises where a side does not vary
    ic = F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry"))
    return ok.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.when(enough, ic).alias("ic"))


def ic_t(ic: Column, n: Column) -> Column:
    """t of a correlation; null for n <= 2 or |ic| = 1."""
    room = 1 - ic * ic
    return F.when((n > 2) & (room > 1e-12), ic * F.sqrt((n - 2) / F.when(room > 1e-12, room)))
