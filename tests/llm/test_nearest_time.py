from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.llm import nearest_time

T0 = datetime(2020, 1, 1)
TOL = 3600


def brute(left, right):
    out = set()
    for k, t, i in left:
        near = [(abs(t - u), u, a) for rk, u, a in right if k is not None and rk == k and u is not None and t is not None and a is not None and abs(t - u) <= timedelta(seconds=TOL)]
        if near and i is not None:
            out.add((i, min(near)[2]))
    return out


def world(seed, n=150):
    r = random.Random(seed)
    at = lambda: T0 + timedelta(seconds=r.randrange(3 * 86400) // 600 * 600)
    left = [(r.choice(["A", "B", None]), None if r.random() < 0.05 else at(), f"s{i}") for i in range(n)]
    right = [(r.choice(["A", "B", "C", None]), None if r.random() < 0.05 else at(), r.choice([None, *[f"f{j}" for j in range(60)]])) for _ in range(n)]
    return left + left[:9], right + right[:9]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("sizes", [{"slice_days": 1, "rows_per_task": 20, "rows_per_buffer": 8}, {"slice_days": 32}])
def test_bounded_tables_equal_brute_force(spark, seed, sizes):
    left, right = world(seed)
    assert run(spark, left, right, **sizes) == brute(left, right)


def test_any_date_is_answered(spark):
    """Before 1970, after 2262, and both at once; half of the rows belong to one entity."""
    for years in ([1931], [1700, 2700], [1969, 1970, 9000]):
        left, right = [], []
        for y in years:
            at = lambda t: t.replace(year=y)  # noqa: E731, B023
            a, b = world(y, 60)
            left += [("A" if n % 2 else k, t and at(t), f"{i}-{y}") for n, (k, t, i) in enumerate(a)]
            right += [(k, t and at(t), i and f"{i}-{y}") for k, t, i in b]
        assert run(spark, left, right, slice_days=1, rows_per_task=30) == brute(left, right) != set()


SCHEMA = "k string, t timestamp, i string"


def run(spark, left, right, **kw):
    sides = [(spark.createDataFrame(x, SCHEMA).repartition(3), "k", "t", "i") for x in (left, right)]
    return {tuple(r) for r in nearest_time.nearest_in_time(*sides, tolerance_seconds=TOL, **kw).collect()}


def test_empty_sides(spark):
    one = [("A", T0, "x")]
    for a, b in (([], one), (one, []), ([], [])):
        assert run(spark, a, b) == set()


def test_the_course_bounds_buffers_and_batches(spark):
    hot = [("A", T0 + timedelta(minutes=i), f"s{i}") for i in range(6000)]
    rows = spark.createDataFrame(hot, "entity string, ts timestamp, id string")
    c = nearest_time.plan_course(rows, slice_days=32, rows_per_buffer=10, rows_per_batch=1000)
    assert c.slice_days == 3 and c.lanes >= 50 and len(c.starts) == 1
    spread = rows.withColumn("ts", rows["ts"] + F.expr("make_interval(0, 0, 0, int(substr(id, 2)) div 50)"))
    c = nearest_time.plan_course(spread, slice_days=8, rows_per_buffer=4000, rows_per_batch=1000)
    assert c.slice_days == 8 and c.lanes == 1 and 4 <= len(c.starts) <= 6


def test_a_stream_in_order_emits_early_and_evicts(spark, tmp_path):
    """Rows in time order over many micro-batches: the answers are those of the whole, most leave
    before the end, and the state stays smaller than the input."""
    left, right = world(7)
    events = sorted([("l", k, t, i) for k, t, i in left if t] + [("r", k, t, i) for k, t, i in right if t], key=lambda e: e[2])
    schema = "side string, entity string, ts timestamp, id string"
    step = len(events) // 6
    parts = [events[i : i + step] for i in range(0, len(events), step)] + [[("end", "", datetime(2260, 1, 1), "")]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    pairs = nearest_time.nearest_stream(src, tolerance_seconds=TOL, lateness="0 seconds", slice_days=1, lanes=2)
    q = pairs.writeStream.format("memory").queryName("near").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("near").collect()} == brute(left, right)
    out = [p["sink"]["numOutputRows"] for p in q.recentProgress]
    groups = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert sum(1 for n in out if n > 0) > 2 and groups[-1] == 0
