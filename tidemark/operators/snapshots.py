"""Full snapshots of a table: version history (tree reduction) and changes (Merkle comparison)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.normal import MAX_DAY
from tidemark.session import stage


def snapshot_calendar(df: DataFrame, date: str) -> DataFrame:
    """(date, k, next_date) of all distinct snapshot dates, k from 0.

    The single-partition window is over distinct calendar days, of which there are at most 3.7
    million whatever the size of the table.
    """
    w = W.orderBy(date)
    return (
        df.select(date).where(F.col(date).isNotNull()).distinct()
        .select(date, (F.row_number().over(w) - 1).cast("int").alias("k"), F.lead(date).over(w).alias("next_date"))
    )


def one_payload(df: DataFrame, date: str, entity: str, payload: Sequence[str]) -> DataFrame:
    """One row per (date, entity): repeats collapse before the shuffle (map-side combine).

    An entity listed in one snapshot with different payloads keeps the smallest, nulls first.
    Rows without entity or date are ignored.
    """
    rows = df.where(F.col(entity).isNotNull() & F.col(date).isNotNull())
    if not payload:
        return rows.select(date, entity).distinct()
    best = rows.groupBy(date, entity).agg(F.min(F.struct(*payload)).alias("_p"))
    return best.select(date, entity, *[F.col(f"_p.{c}").alias(c) for c in payload])


def version_history(
    df: DataFrame, *, date: str, entity: str, payload: Sequence[str], block_bits: int = 6, open_end: str = MAX_DAY
) -> DataFrame:
    """History of changing attributes from periodic full snapshots.

    Returns (entity, payload..., valid_from date, valid_to date): one row per longest run of
    consecutive snapshots in which ``entity`` is present with an equal payload (nulls equal).
    ``valid_to`` is the day before the snapshot that ends the run, ``open_end`` for the last.

    Method: each row is the unit interval [k, k] of its snapshot's ordinal.  In round r the runs
    that end just before, or begin at, an odd multiple of 2^(r-1) may meet there; equal payloads
    on both sides become one run, so after log2(n) rounds all runs are maximal.  A group never
    holds more than two rows, however hot its entity.  The rounds of one level (``block_bits``)
    stay within aligned blocks of snapshots and share one shuffle on (entity, block); the next
    level shuffles only what is left, with larger blocks.

    Empty tables give no rows; entities and dates that are null are ignored (their dates still
    count as snapshots); extra columns are dropped; a payload column may not be named like the
    working columns ``_f``, ``_l``, ``_block`` and ``_meet``.
    """
    payload = list(payload)
    calendar = snapshot_calendar(df, date)
    rounds = max(calendar.count() - 1, 0).bit_length()
    runs = (
        one_payload(df, date, entity, payload)
        .join(calendar.select(date, "k"), date)
        .select(F.col(entity), *payload, F.col("k").alias("_f"), F.col("k").alias("_l"))
    )
    for r in range(1, rounds + 1):
        if (r - 1) % block_bits == 0:
            level_bits = ((r - 1) // block_bits + 1) * block_bits
            runs = runs.withColumn("_block", F.shiftright("_f", level_bits)).repartition(entity, "_block")
        half, span = 1 << (r - 1), 1 << r
        meet = (
            F.when((F.col("_l") + 1) % span == half, F.col("_l") + 1)
            .when(F.col("_f") % span == half, F.col("_f"))
            .otherwise(-1 - F.col("_f"))
        )
        runs = (
            runs.withColumn("_meet", meet)
            .groupBy(entity, "_block", *payload, "_meet")
            .agg(F.min("_f").alias("_f"), F.max("_l").alias("_l"))
            .drop("_meet")
        )
    first = calendar.select(F.col("k").alias("_f"), F.col(date).alias("valid_from"))
    last = calendar.select(F.col("k").alias("_l"), F.date_sub("next_date", 1).alias("_to"))
    return (
        runs.join(first, "_f").join(last, "_l")
        .select(entity, *payload, "valid_from", F.coalesce("_to", F.lit(open_end).cast("date")).alias("valid_to"))
    )


def _digest(cols: Sequence[Column | str], seed: str) -> Column:
    return F.xxhash64(F.lit(seed), *cols, *[F.isnull(c) for c in cols])


def _pairs(nodes: DataFrame, n: int) -> DataFrame:
    """Each node of snapshot k is the new side of pair k and the old side of pair k + 1."""
    sides = F.array(
        F.struct(F.col("k").alias("pair"), F.lit(True).alias("is_new")),
        F.struct((F.col("k") + 1).alias("pair"), F.lit(False).alias("is_new")),
    )
    keep = [c for c in nodes.columns if c != "k"]
    out = nodes.select(*keep, F.inline(sides))
    return out.where((F.col("pair") > 0) & (F.col("pair") < n))


@dataclass(frozen=True)
class MerkleComparison:
    """Rows (k, leaf, _e, _p) of all snapshots, the calendar (k), and the (pair, node) leaves that differ."""

    rows: DataFrame
    calendar: DataFrame
    leaves: DataFrame
    differing: DataFrame


def compare_snapshots(df: DataFrame, *, date: str, entity: str, payload: Sequence[str], rows_per_leaf: int = 4, fanout_bits: int = 8) -> MerkleComparison:
    """Merkle trees of all snapshots, those of neighbours compared from the root down.

    The table is read and its repeats collapsed once; the number of hash ranges follows from the
    rows of a snapshot, about ``rows_per_leaf`` to a leaf, so that a leaf without a change is as
    likely in a large table as in a small one.
    """
    payload = list(payload)
    best = df.where(F.col(date).isNotNull()).groupBy(date, entity).agg(F.min(F.struct(*[F.col(c) for c in payload], F.lit(1).alias("_one"))).alias("_p"))
    once = stage(best.select(date, F.col(entity).alias("_e"), "_p"), "snapshots")  # read by the calendar, the digests and the rows compared
    calendar = snapshot_calendar(once, date)
    n = calendar.count()
    usable = once.where("_e IS NOT NULL")
    leaf_bits = max(0, math.ceil(math.log2(max(1, usable.count() / max(n, 1) / rows_per_leaf))))
    leaf = F.shiftrightunsigned(F.xxhash64("_e"), 64 - leaf_bits) if leaf_bits else F.lit(0).cast("bigint")
    rows = usable.join(calendar.select(date, "k"), date).select("k", "_e", "_p", leaf.alias("leaf"))
    parts = [F.col("_e"), *[F.col(f"_p.{c}") for c in payload]]
    leaves = rows.groupBy("k", "leaf").agg(F.bit_xor(_digest(parts, "a")).alias("d1"), F.bit_xor(_digest(parts, "b")).alias("d2"), F.count(F.lit(1)).alias("c"))
    leaves = stage(leaves, "digests")  # read once per level
    bits = [*range(0, leaf_bits, fanout_bits), leaf_bits]
    differing = None
    for above, depth in zip([0, *bits], bits):
        shift = leaf_bits - depth
        if shift:
            level = leaves.groupBy("k", F.shiftright("leaf", shift).alias("node")).agg(
                F.bit_xor(F.xxhash64("leaf", "d1", "c")).alias("d1"),
                F.bit_xor(F.xxhash64("leaf", "d2", "c")).alias("d2"),
                F.sum("c").alias("c"),
            )
        else:
            level = leaves.withColumnRenamed("leaf", "node")
        sides = _pairs(level, n)
        if differing is not None:
            parents = differing.select("pair", F.col("node").alias("_up"))
            sides = sides.withColumn("_up", F.shiftright("node", depth - above)).join(parents, ["pair", "_up"], "left_semi").drop("_up")
        side = F.struct("d1", "d2", "c")
        differing = (
            sides.groupBy("pair", "node")
            .agg(F.max(F.when(F.col("is_new"), side)).alias("new"), F.max(F.when(~F.col("is_new"), side)).alias("old"))
            .where(~F.col("new").eqNullSafe(F.col("old")))
            .select("pair", "node")
        )
    return MerkleComparison(rows, calendar, leaves, stage(differing, "differing"))


def snapshot_changes(df: DataFrame, *, date: str, entity: str, payload: Sequence[str], rows_per_leaf: int = 4, fanout_bits: int = 8) -> DataFrame:
    """What changed between consecutive full snapshots.

    Returns (date, entity, change_type) with ``added``, ``removed`` or ``changed`` (payload
    differs; two nulls are equal) against the snapshot just before.

    Method: entities fall into hash ranges.  Each snapshot gets a Merkle tree: a leaf's digest
    combines its rows (two independent 64-bit hashes, xor-ed, and their number), a node's digest
    those of its children.  Trees of consecutive snapshots are compared from the root down, a level
    at a time, following only nodes that differ; only rows of leaves that differ are shuffled and
    compared, each on the sides on which its leaf does.

    Repeats, conflicting payloads and nulls are treated as in :func:`one_payload`; a snapshot
    without usable rows still counts, so all its predecessors' entities are removed by it.
    """
    m = compare_snapshots(df, date=date, entity=entity, payload=payload, rows_per_leaf=rows_per_leaf, fanout_bits=fanout_bits)
    sides = F.array(
        F.struct(F.col("pair").alias("k"), F.struct("pair", F.lit(True).alias("is_new")).alias("s")), F.struct((F.col("pair") - 1).alias("k"), F.struct("pair", F.lit(False).alias("is_new")).alias("s"))
    )
    wanted = m.differing.select(F.col("node").alias("leaf"), F.inline(sides)).groupBy("k", "leaf").agg(F.collect_list("s").alias("sides"))  # two at most
    both = (
        m.rows.join(wanted, ["k", "leaf"]).select("_e", "_p", F.inline("sides"))
        .groupBy("pair", "_e").agg(F.max(F.when(F.col("is_new"), F.col("_p"))).alias("new"), F.max(F.when(~F.col("is_new"), F.col("_p"))).alias("old"))
    )
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return (
        both.where(~F.col("new").eqNullSafe(F.col("old")))
        .join(m.calendar.select(F.col("k").alias("pair"), date), "pair")
        .select(F.col(date), F.col("_e").alias(entity), kind.alias("change_type"))
    )


def pruned_share(df: DataFrame, *, date: str, entity: str, payload: Sequence[str], **kw: int) -> DataFrame:
    """(date, leaves, differing, pruned_share) of every snapshot after the first: how many leaves of
    either side there were, how many differ, and what share of them needed no rows."""
    m = compare_snapshots(df, date=date, entity=entity, payload=payload, **kw)
    every = _pairs(m.leaves.select("k", "leaf"), m.calendar.count()).groupBy("pair", "leaf").agg(F.lit(1).alias("one")).groupBy("pair").agg(F.count(F.lit(1)).alias("leaves"))
    out = every.join(m.differing.groupBy("pair").agg(F.count(F.lit(1)).alias("differing")), "pair", "left").na.fill(0, ["differing"])
    return out.join(m.calendar.select(F.col("k").alias("pair"), date), "pair").select(date, "leaves", "differing", (1 - F.col("differing") / F.col("leaves")).alias("pruned_share"))
