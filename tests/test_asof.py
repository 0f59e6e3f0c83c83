from __future__ import annotations

import random
from datetime import date, timedelta

import pytest

from tests.conftest import rows
from tidemark.operators.asof import asof_join
from tidemark.operators.eventtime import known_as_of, periods_of_both, valid_keys

D0 = date(2020, 1, 1)


def world(seed, n=120):
    r = random.Random(seed)
    day = lambda: D0 + timedelta(days=r.randrange(200))
    left = [(i, r.choice(["A", "B", None]), None if r.random() < 0.03 else day()) for i in range(n)]
    right = [(r.choice(["A", "B", "C", None]), None if r.random() < 0.03 else day(), r.choice([None, *range(9)])) for _ in range(n)]
    return left + left[:5], right + right[:5]


def brute(left, right, forward, exact, shift=0):
    out = []
    for i, k, t in left:
        best = None
        for rk, rt, v in right:
            if k is None or t is None or rk != k or rt is None:
                continue
            at = t + timedelta(days=shift)
            ok = (rt >= at if exact else rt > at) if forward else (rt <= at if exact else rt < at)
            if ok:
                rank = (-rt.toordinal() if forward else rt.toordinal(), v is not None, v or 0)
                best = max(best, (rank, v), key=lambda b: b[0]) if best else (rank, v)
        out.append((i, k, t, best[1] if best else None))
    return sorted(out, key=lambda t: [(v is not None, str(v)) for v in t])


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("width", [None, 1, 30])
def test_asof_equals_brute_force(spark, forward, exact, width):
    left, right = world(3)
    got = asof_join(
        spark.createDataFrame(left, "i int, k string, t date"), spark.createDataFrame(right, "k string, u date, v int"), keys=["k"], left_time="t", right_time="u", values=["v"],
        direction="forward" if forward else "backward", exact=exact, slice_width=width,
    )
    assert rows(got) == brute(left, right, forward, exact)


def test_shift_looks_further_back(spark):
    left, right = world(5)
    got = asof_join(spark.createDataFrame(left, "i int, k string, t date"), spark.createDataFrame(right, "k string, u date, v int"), keys=["k"], left_time="t", right_time="u", values=["v"], shift=-30, slice_width=16)
    assert rows(got) == brute(left, right, False, True, -30)


def test_clashing_values_are_refused(spark):
    df = spark.createDataFrame([("A", D0, 1)], "k string, t date, v int")
    with pytest.raises(ValueError, match="v"):
        asof_join(df, df, keys=["k"], left_time="t", right_time="t", values=["v"])


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("rows_per_task", [4, 100_000])
def test_known_as_of_equals_brute_force(spark, seed, rows_per_task):
    left, right = world(seed)
    got = known_as_of(
        spark.createDataFrame(left, "i int, k string, t date"), spark.createDataFrame(right, "k string, u date, v int"), keys=["k"], event_time="t", version_time="u", values=["v"],
        slice_width=25, rows_per_task=rows_per_task, buckets=3,
    )
    assert rows(got) == brute(left, right, False, True)


def test_known_as_of_keeps_clashing_names_and_empty_sides(spark):
    e = spark.createDataFrame([("A", D0, 1)], "k string, t date, v int")
    v = spark.createDataFrame([("A", D0, 7)], "k string, u date, v int")
    out = known_as_of(e, v, keys=["k"], event_time="t", version_time="u", values=["v"], slice_width=10)
    assert out.columns == ["k", "t", "v", "v_known"] and rows(out) == [("A", D0, 1, 7)]
    assert rows(known_as_of(e, v.limit(0), keys=["k"], event_time="t", version_time="u", values=["v"], slice_width=10)) == [("A", D0, 1, None)]
    assert rows(known_as_of(e.limit(0), v, keys=["k"], event_time="t", version_time="u", values=["v"], slice_width=10)) == []


def test_later_versions_never_show(spark):
    """Poisoning: versions after an event change nothing."""
    left, right = world(9)
    late = D0 + timedelta(days=100)
    e = spark.createDataFrame([x for x in left if x[2] and x[2] < late], "i int, k string, t date")
    run = lambda r: rows(known_as_of(e, spark.createDataFrame(r, "k string, u date, v int"), keys=["k"], event_time="t", version_time="u", values=["v"], slice_width=25))
    assert run(right) == run([x if x[1] is None or x[1] < late else (x[0], x[1], 99) for x in right])


def test_valid_keys_equals_brute_force(spark):
    r = random.Random(1)
    events = [(i, r.choice([1, 2, None]), D0 + timedelta(days=r.randrange(300))) for i in range(60)]
    ranges = []
    for _ in range(25):
        a = D0 + timedelta(days=r.randrange(300))
        ranges.append((r.choice([1, 2]), r.choice(["X", "Y", "Z", None]), r.choice([a, a, None]), r.choice([a + timedelta(days=r.randrange(-5, 60)), None])))
    runs = [("X", D0, D0 + timedelta(days=90)), ("X", D0 + timedelta(days=120), D0 + timedelta(days=400)), ("Y", D0 - timedelta(days=9), date(9999, 12, 31)), (None, D0, D0)]
    both = periods_of_both(
        spark.createDataFrame(ranges, "c int, m string, a date, b date"), spark.createDataFrame(runs, "m string, u date, v date"), entity="c", member="m", valid_from="a", valid_to="b", run_from="u", run_to="v"
    )
    got = valid_keys(spark.createDataFrame(events, "i int, c int, t date"), both, entity="c", member="m", event_time="t", slice_days=40)
    want = {(i, c, t, m) for i, c, t in events for rc, m, a, b in ranges if c == rc and m and (a is None or a <= t) and (b is None or b >= t) and any(n == m and u <= t <= v for n, u, v in runs)}
    assert {tuple(x) for x in got.select("i", "c", "t", "m").collect()} == want and got.count() == len(want)
