"""Matching records by nearest time: a stateful streaming join with bounded buffers.

Both sides flow through one stream.  Each entity's rows are buffered; a left row is answered once
the watermark has passed its tolerance horizon, so no nearer partner can still arrive, and
candidates that no open or future left row can reach are evicted.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidemark.session import drop_scratch, scratch_path

_ROWS = pa.schema([("entity", pa.string()), ("ts", pa.int64()), ("id", pa.string())])
DAY_US = 86_400_000_000
LONGEST_US = 250 * 366 * DAY_US  # what event times may span; longer spans are scaled down


@dataclass(frozen=True)
class Clock:
    """Times of rows against event times of the stream: workers hold no event time before 1970 or
    after 2262 in nanoseconds, so a bounded input is moved there and, if need be, scaled down."""

    origin: int = 0
    scale: int = 1
    slack: int = 0  # what event times may run ahead of the rows' times

    def event(self, us: Column, ahead: Column | int = 0) -> Column:
        return F.timestamp_micros(F.floor((us - self.origin) / F.lit(self.scale)).cast("bigint") + ahead)

    def at_most(self, mark: int) -> int:
        """The time that rows have surely passed at this watermark."""
        return (mark - self.slack) * self.scale + self.origin

    def beyond(self, us: int) -> int:
        """A watermark at which this time has surely been passed."""
        return (us - self.origin) // self.scale + 1 + self.slack


def _pack(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, _ROWS) as w:
        w.write_table(pa.table([pa.array(c, t) for c, t in zip(rows, _ROWS.types)], schema=_ROWS))
    return sink.getvalue()


def _unpack(raw: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not raw:
        return np.empty(0, object), np.empty(0, np.int64), np.empty(0, object)
    t = pa.ipc.open_stream(raw).read_all()
    return t["entity"].to_numpy(), t["ts"].to_numpy(), t["id"].to_numpy()


def _first_of_ticks(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each (entity, time), the one with the smallest id."""
    entity, ts, ident = rows
    order = np.lexsort((np.unique(ident, return_inverse=True)[1], ts, pd.factorize(entity)[0])) if len(ts) else np.empty(0, int)
    entity, ts, ident = entity[order], ts[order], ident[order]
    first = np.ones(len(ts), dtype=bool)
    first[1:] = (ts[1:] != ts[:-1]) | (entity[1:] != entity[:-1])
    return entity[first], ts[first], ident[first]


def nearest(left: tuple, right: tuple, tolerance_us: int) -> tuple[np.ndarray, np.ndarray]:
    """(left ids, right ids) of the nearest right row of the same entity within the tolerance,
    inclusive; of equal distances the earlier, of equal times the smaller id.

    Both sides are sorted together once; a running maximum tells for each left row the right row
    before it, one from the end the right row after it.
    """
    right = _first_of_ticks(right)
    n, m = len(left[1]), len(right[1])
    if not n or not m:
        return np.empty(0, object), np.empty(0, object)
    code = pd.factorize(np.concatenate([right[0], left[0]]))[0]
    ts = np.concatenate([right[1], left[1]])
    is_right = np.arange(m + n) < m
    order = np.lexsort((~is_right, ts, code))  # at equal times right rows first
    c, t, r = code[order], ts[order], is_right[order]
    at = np.arange(m + n)
    before = np.maximum.accumulate(np.where(r, at, -1))
    after = np.minimum.accumulate(np.where(r, at, m + n)[::-1])[::-1]
    far = np.iinfo(np.int64).max
    ok = (before >= 0) & (c[np.maximum(before, 0)] == c)
    d1 = np.where(ok, t - t[np.maximum(before, 0)], far)
    ok = (after < m + n) & (c[np.minimum(after, m + n - 1)] == c)
    d2 = np.where(ok, t[np.minimum(after, m + n - 1)] - t, far)
    pick = order[np.where(d1 <= d2, np.maximum(before, 0), np.minimum(after, m + n - 1))]
    hit = ~r & (np.minimum(d1, d2) <= tolerance_us)
    return left[2][order[hit] - m], right[2][pick[hit]]


def _matcher(tolerance_us: int, clock: Clock):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.getOption
        left, right = (_unpack(old[0]), _unpack(old[1])) if old else (_unpack(None), _unpack(None))
        if not state.hasTimedOut:
            for rows in batches:
                side = rows["side"].to_numpy()
                cols = [rows[c].to_numpy() for c in ("entity", "ts", "id")]
                left = tuple(np.concatenate([a, b[side == "l"]]) for a, b in zip(left, cols))
                right = tuple(np.concatenate([a, b[side == "r"]]) for a, b in zip(right, cols))
            right = _first_of_ticks(right)
        now = state.getCurrentWatermarkMs() * 1000
        mark = clock.at_most(now)
        due = left[1] + tolerance_us < mark
        if due.any():
            a, b = nearest(tuple(c[due] for c in left), right, tolerance_us)
            yield pd.DataFrame({"left_id": a, "right_id": b})
        left = tuple(c[~due] for c in left)
        reach = min(mark, left[1].min()) if len(left[1]) else mark
        right = tuple(c[right[1] >= reach - tolerance_us] for c in right)
        if not len(left[1]) and not len(right[1]):
            if old:
                state.remove()
            return
        state.update((_pack(left), _pack(right)))
        horizon = int(left[1].min() if len(left[1]) else right[1].max()) + tolerance_us
        state.setTimeoutTimestamp(max(clock.beyond(horizon) // 1000 + 1, now // 1000 + 1))

    return step


def _slots(side: Column, us: Column, tolerance_us: int, width_us: int) -> Column:
    first, last = (F.when(side == "l", us).otherwise(us + by) for by in (-tolerance_us, tolerance_us))
    return F.sequence(F.floor(first / F.lit(width_us)), F.floor(last / F.lit(width_us)))


def nearest_stream(rows: DataFrame, *, tolerance_seconds: int, lateness: str, slice_days: int = 32, lanes: int = 16, clock: Clock = Clock(), ahead: Column | None = None) -> DataFrame:
    """Streaming (left_id, right_id) pairs of a stream (side ``l`` or ``r``, entity string, ts
    timestamp, id string); rows of any other side only move the watermark.

    A buffer holds the entities of one lane (a hash of the entity) in one time slice, so its size is
    set by the number of lanes and the width of slices, whatever the table's; right rows within the
    tolerance of a slice's edge also go to its neighbour, so a hot entity is spread over its slices,
    and one slice never has to see another.  Rows later than ``lateness`` behind the newest row are
    too late for the watermark and are dropped by the engine, as are, unless ``clock`` moves them,
    times before 1970 and from 2262 on.  A bounded input is therefore run in the order of its times
    (:func:`nearest_in_time`).
    """
    tol, width = tolerance_seconds * 1_000_000, slice_days * DAY_US
    us = F.unix_micros("ts")
    keyed = (
        rows.withColumn("at", clock.event(us, F.lit(0) if ahead is None else ahead)).withWatermark("at", lateness)
        .where("entity IS NOT NULL AND id IS NOT NULL AND ts IS NOT NULL")
        .select("at", "side", "entity", "id", F.pmod(F.xxhash64("entity"), F.lit(lanes)).alias("lane"), F.explode(_slots(F.col("side"), us, tol, width)).alias("slot"), us.alias("us"))
    )
    # the state function wants plain numbers; the watermark column stays for the engine
    keyed = keyed.select("at", "side", "entity", "id", "lane", "slot", F.col("us").alias("ts"))
    return keyed.groupBy("lane", "slot").applyInPandasWithState(
        _matcher(tol, clock), "left_id string, right_id string", "l binary, r binary", "append", GroupStateTimeout.EventTimeTimeout
    )


@dataclass(frozen=True)
class Course:
    """How a bounded input runs: the clock, the width of slices, the lanes, and the first slice of every batch."""

    clock: Clock
    slice_days: int
    lanes: int
    starts: list[int]
    last_us: int


def plan_course(rows: DataFrame, *, slice_days: int, rows_per_buffer: int, rows_per_batch: int) -> Course | None:
    """Batches of about ``rows_per_batch`` rows, cut between slices of time, and buffers of about
    ``rows_per_buffer``: slices are narrowed, to a day at least, where one entity alone has more.

    What the driver reads is a row per slice of time, which the calendar bounds.
    """
    us = F.unix_micros("ts")
    fine = rows.groupBy(F.floor(us / F.lit(slice_days * DAY_US)).alias("slot"), F.pmod(F.xxhash64("entity"), F.lit(1 << 16)).alias("h"))
    fine = fine.agg(F.count(F.lit(1)).alias("n"), F.min(us).alias("a"), F.max(us).alias("b"))
    slots = sorted(fine.groupBy("slot").agg(F.sum("n").alias("n"), F.max("n").alias("hot"), F.min("a").alias("a"), F.max("b").alias("b")).collect())
    if not slots:
        return None
    first, last = min(s["a"] for s in slots), max(s["b"] for s in slots)
    hot, full = max(s["hot"] for s in slots), max(s["n"] for s in slots)
    days = max(1, min(slice_days, slice_days * 64 * rows_per_buffer // hot))
    lanes = max(1, -(-full * days // slice_days // rows_per_buffer))
    starts, held = [slots[0]["slot"]], 0
    for s in slots:
        if held >= rows_per_batch:
            starts.append(s["slot"])
            held = 0
        held += s["n"]
    scale = max(1, -(-(last - first) // LONGEST_US))
    slack = 2_000 * len(starts)
    return Course(Clock(first - DAY_US * scale, scale, slack), days, lanes, starts, last)


def nearest_in_time(left: tuple, right: tuple, *, tolerance_seconds: int, slice_days: int = 32, rows_per_buffer: int = 4_000, rows_per_task: int = 25_000) -> DataFrame:
    """Run the streaming join over two bounded tables to its end; (left_id, right_id).

    ``left`` and ``right`` are (DataFrame, entity column, time column, id column).  The rows are
    written in batches in the order of their times, about ``rows_per_task`` rows for every shuffle
    partition in each, and the stream takes them one batch after the other: no row is ever late,
    horizons close as the batches go on, and the state holds little more than a batch.  An end
    marker behind the last one moves the watermark past every horizon.  State, progress and results
    live in the shared checkpoint folder, so a lost executor only repeats its tasks.  Any date is
    answered, before 1970 and after 2262 too.  Left rows without a partner give no row; null
    entities, times and ids are ignored; repeated left rows may repeat in the result.
    """
    spark = left[0].sparkSession

    def rows_of(source: tuple, side: str) -> DataFrame:
        df, entity, ts, ident = source
        return df.select(
            F.lit(side).alias("side"), F.col(entity).cast("string").alias("entity"), F.col(ts).cast("timestamp").alias("ts"), F.col(ident).cast("string").alias("id")
        ).where("entity IS NOT NULL AND ts IS NOT NULL AND id IS NOT NULL")

    rows = rows_of(left, "l").unionByName(rows_of(right, "r").groupBy("side", "entity", "ts").agg(F.min("id").alias("id")))
    schema = StructType.fromDDL("side string, entity string, ts timestamp, id string, batch int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    course = plan_course(rows, slice_days=slice_days, rows_per_buffer=rows_per_buffer, rows_per_batch=rows_per_task * parts)
    if course is None:
        return spark.createDataFrame([], "left_id string, right_id string")
    base = scratch_path(spark, "nearest")
    slot = F.floor(F.unix_micros("ts") / F.lit(slice_days * DAY_US))
    later = F.array(*[F.lit(s) for s in course.starts[1:]]) if len(course.starts) > 1 else F.array().cast("array<bigint>")
    batch = F.size(F.filter(later, lambda s: s <= slot)).cast("int")
    end = rows.sparkSession.range(1).select(
        F.lit("end").alias("side"), F.lit("").alias("entity"), F.lit(None).cast("timestamp").alias("ts"), F.lit("").alias("id"), F.lit(len(course.starts)).alias("batch")
    )
    rows.withColumn("batch", batch).repartition("batch", F.pmod(F.xxhash64("entity"), F.lit(max(1, parts // 4)))).unionByName(end.coalesce(1)).withColumn("day", F.col("batch")).write.partitionBy("day").parquet(f"{base}/batches")

    tol = tolerance_seconds * 1_000_000
    final = F.timestamp_micros(F.lit(course.last_us + 4 * tol + 1_000_000 * course.clock.scale))
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files.mkdirs(path(f"{base}/live"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for b in range(len(course.starts) + 1):
            files.rename(path(f"{base}/batches/day={b}"), path(f"{base}/live/day={b}"))
            if b == len(course.starts) - 1:
                continue  # the end marker goes with the last batch
            live = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/live").withColumn("ts", F.coalesce("ts", final))
            pairs = nearest_stream(
                live, tolerance_seconds=tolerance_seconds, lateness="0 seconds", slice_days=course.slice_days, lanes=course.lanes, clock=course.clock, ahead=F.col("batch").cast("bigint") * 2_000
            )
            query = (
                pairs.writeStream.format("parquet").outputMode("append").option("path", f"{base}/pairs")
                .option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
            )
            query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    for done in ("progress", "live", "batches"):
        drop_scratch(spark, f"{base}/{done}")
    return spark.read.schema("left_id string, right_id string").parquet(f"{base}/pairs")
