"""Filling fixed-capacity containers: harmonic classes, with left-over room refilled on request."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = 12
CHUNK = 4096  # copies of one row that are numbered together


class _Rooms:
    """Closed bins by the room they have left; the tightest that fits is found in a bit mask."""

    def __init__(self, capacity: int) -> None:
        self._bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self._mask = 0

    def add(self, b: int, room: int) -> None:
        if room > 0:
            self._bins[room].append(b)
            self._mask |= 1 << room

    def take(self, size: int) -> int | None:
        fits = self._mask >> size
        if not fits:
            return None
        room = size + (fits & -fits).bit_length() - 1
        b = self._bins[room].pop()
        if not self._bins[room]:
            self._mask &= ~(1 << room)
        self.add(b, room - size)
        return b


def fill(sizes: list[int], capacity: int, classes: int = CLASSES, refill: bool = True) -> tuple[list[int], list[bool]]:
    """(bin of every item, whether it was put into left-over room); no item exceeds the capacity.

    Harmonic classes: sizes in (C/(j+1), C/j] form class j, whose own bins take exactly j items;
    sizes of C/classes and less form the last class, whose bins take what fits.  With ``refill``
    the classes go from the largest sizes down, and an item first goes where it leaves least room
    in a bin that a class before has closed, so the room that a fixed count leaves over is not lost.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins, moved = [0] * len(sizes), [False] * len(sizes)
    closed = _Rooms(capacity)
    made, current, left, held, current_class = 0, -1, 0, 0, 0
    for i in order:
        size = sizes[i]
        j = min(capacity // size, classes)
        if current >= 0 and j != current_class:
            closed.add(current, left)
            current = -1
        if refill and (b := closed.take(size)) is not None:
            bins[i], moved[i] = b, True
            continue
        if current < 0 or left < size:
            if current >= 0:
                closed.add(current, left)
            current, left, held, current_class = made, capacity, 0, j
            made += 1
        bins[i] = current
        left -= size
        held += 1
        if j < classes and held == j:
            closed.add(current, left)
            current = -1
    return bins, moved


def numbered(items: DataFrame) -> DataFrame:
    """(doc_id, tokens, copy): every row with its number among the rows equal to it.

    Equal rows are counted with map-side combining and written out again in chunks, so neither a
    window nor a task ever holds all copies of a row that is repeated without bound.
    """
    counted = items.groupBy("doc_id", "tokens").agg(F.count(F.lit(1)).alias("_n"))
    chunks = counted.withColumn("_c", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / CHUNK)))).repartition("doc_id", "_c")
    first = F.col("_c") * CHUNK
    return chunks.select("doc_id", "tokens", F.explode(F.sequence(first, F.least(first + (CHUNK - 1), F.col("_n") - 1))).alias("copy"))


def pack(items: DataFrame, containers: DataFrame, *, items_per_worker: int = 50_000, classes: int = CLASSES, refill: bool = True) -> DataFrame:
    """(container, capacity_tokens, bin_id, doc_id, copy, part, first_token, tokens, placed): every item
    in a bin of every container kind.

    ``items`` is (doc_id, tokens), ``containers`` (container, capacity_tokens).  Only an item
    longer than the capacity is cut, into full containers and one rest, which is packed like any
    item.  Items are dealt to workers by a hash of the item, about ``items_per_worker`` to each, and
    each fills its own bins; more workers cost at most one open bin per class and worker.  ``placed``
    is ``class`` where the class decided, ``refill`` where left-over room was used, ``full`` for a
    piece that fills its container.

    The packing depends on the rows alone, not on how they are split.  Items without tokens need no
    container and come out nowhere; repeated items are packed as often as they occur (``copy``
    tells them apart); a null id is kept; containers without a positive capacity are ignored.
    The table of container kinds is a parameter (a row per kind) and read by the driver.
    """
    kinds = sorted(map(tuple, containers.where("capacity_tokens > 0 AND container IS NOT NULL").select("container", "capacity_tokens").distinct().collect()))
    usable = items.where("tokens > 0").select("doc_id", F.col("tokens").cast("bigint").alias("tokens"))
    workers = max(1, math.ceil(usable.count() / items_per_worker))
    dealt = numbered(usable).withColumn("worker", F.pmod(F.xxhash64("doc_id", "tokens", "copy"), F.lit(workers)).cast("int"))
    each = F.array(*[F.struct(F.lit(k).alias("container"), F.lit(c).cast("int").alias("capacity_tokens")) for k, c in kinds])
    if not kinds:
        each = F.array().cast("array<struct<container:string,capacity_tokens:int>>")
    kind = dict(items.dtypes)["doc_id"]

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cap, worker = int(key[1]), int(key[2])
        pdf = pdf.sort_values(["doc_id", "tokens", "copy"], ignore_index=True)
        pieces = pdf.loc[pdf.index.repeat((pdf["tokens"] + cap - 1) // cap)].copy()
        pieces["part"] = pieces.groupby(level=0).cumcount().astype("int32")
        pieces["first_token"] = pieces["part"].astype("int64") * cap
        pieces["tokens"] = (pieces["tokens"] - pieces["first_token"]).clip(upper=cap)
        whole = pieces["tokens"] == cap
        rest = pieces[~whole]
        bins, moved = fill(rest["tokens"].tolist(), cap, classes, refill)
        rest = rest.assign(bin_id=pd.Series(bins, index=rest.index, dtype="int64"), placed=["refill" if m else "class" for m in moved])
        full = pieces[whole]
        full = full.assign(bin_id=range(len(rest), len(rest) + len(full)), placed="full")
        out = pd.concat([rest, full])
        out["bin_id"] = out["bin_id"].astype("int64") + (worker << 40)
        return out[["container", "capacity_tokens", "bin_id", "doc_id", "copy", "part", "first_token", "tokens", "placed"]]

    schema = f"container string, capacity_tokens int, bin_id bigint, doc_id {kind}, copy bigint, part int, first_token bigint, tokens bigint, placed string"
    return dealt.select("*", F.inline(each)).groupBy("container", "capacity_tokens", "worker").applyInPandas(place, schema)


def unused_share(packed: DataFrame) -> DataFrame:
    """(container, capacity_tokens, n_bins, tokens, unused_share, refilled_share) of a packing;
    ``refilled_share`` is the share of the tokens that was put into left-over room."""
    refilled = F.sum(F.when(F.col("placed") == "refill", F.col("tokens")).otherwise(0))
    bins = packed.groupBy("container", "capacity_tokens", "bin_id").agg(F.sum("tokens").alias("tokens"), refilled.alias("refilled"))
    room = F.count(F.lit(1)) * F.first("capacity_tokens").cast("bigint")
    return bins.groupBy("container", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("n_bins"), F.sum("tokens").alias("tokens"), (1 - F.sum("tokens") / room).alias("unused_share"), (F.sum("refilled") / F.sum("tokens")).alias("refilled_share")
    )
