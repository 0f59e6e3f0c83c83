from __future__ import annotations

import random
from datetime import date, timedelta

import pytest

from tests.conftest import rows
from tidemark.operators import pit
from tidemark.operators.snapshots import snapshot_calendar

M = [("2019-12-20", t) for t in ("AAA", "BBB", "CCC")] + [("2020-03-02", t) for t in ("AAA", "BBB", "DDD")] + [("2020-06-22", t) for t in ("AAA", "DDD", "EEE")]


def membership(spark, extra=()):
    return spark.createDataFrame([*M, *extra], "d string, t string").selectExpr("date(d) AS snapshot_date", "t AS ticker")


def days(spark, *ds):
    return spark.createDataFrame([(x,) for x in ds], "day string").selectExpr("date(day) AS day")


def test_members_in_force(spark):
    out = pit.members_as_of(days(spark, "2020-03-01", "2020-03-02", "2019-01-01"), membership(spark), day="day", date="snapshot_date", member="ticker")
    assert {(str(r["day"]), r["ticker"]) for r in out.collect()} == {("2020-03-01", t) for t in ("AAA", "BBB", "CCC")} | {("2020-03-02", t) for t in ("AAA", "BBB", "DDD")}


def test_future_snapshots_change_nothing(spark):
    ask = lambda m: rows(pit.members_as_of(days(spark, "2020-03-01"), m, day="day", date="snapshot_date", member="ticker"))
    assert ask(membership(spark)) == ask(membership(spark, [("2020-03-05", "XXX"), ("2021-01-01", "YYY")]))


def test_member_windows_ignore_gaps(spark):
    out = {r["ticker"]: (str(r["first_day"]), str(r["last_day"])) for r in pit.member_windows(membership(spark), date="snapshot_date", member="ticker", end="2020-12-31").collect()}
    assert out["CCC"] == ("2019-12-20", "2020-03-01") and out["AAA"] == ("2019-12-20", "2020-12-31") and out["EEE"] == ("2020-06-22", "2020-12-31")


def test_period_includes_the_snapshot_live_at_its_start(spark):
    out = pit.snapshots_in_period(membership(spark), "snapshot_date", "2020-01-15", "2020-04-01")
    assert {str(r["snapshot_date"]) for r in out.collect()} == {"2019-12-20", "2020-03-02"}


def test_validity_first_match_and_single_holder(spark):
    r = spark.createDataFrame(
        [("A", 1, date(2020, 1, 1), date(2020, 6, 30), 0), ("A", 2, date(2020, 6, 30), None, 1), ("B", 3, date(2020, 1, 1), date(2020, 1, 2), 0), (None, 4, None, None, 0)], "k string, c int, a date, b date, o int"
    )
    asked = spark.createDataFrame([("A", date(2020, 6, 30)), ("A", date(2020, 7, 1)), ("A", date(2019, 1, 1)), ("B", date(2025, 1, 1)), ("Z", date(2020, 1, 1)), (None, date(2020, 1, 1))], "k string, day date")
    out = pit.resolve_validity(asked, r, key="k", day="day", valid_from="a", valid_to="b", order=["o"], values=["c"])
    assert {(x["k"], str(x["day"])): x["c"] for x in out.collect()} == {
        ("A", "2020-06-30"): 1, ("A", "2020-07-01"): 2, ("A", "2019-01-01"): None, ("B", "2025-01-01"): 3, ("Z", "2020-01-01"): None, (None, "2020-01-01"): None}


def test_activity_near_a_window(spark):
    pairs = spark.createDataFrame([(1, date(2020, 1, 1), date(2020, 2, 1)), (2, date(2020, 1, 1), date(2020, 2, 1)), (3, date(2020, 1, 1), date(2020, 2, 1))], "c int, a date, b date")
    act = spark.createDataFrame([(1, date(2020, 2, 11)), (2, date(2020, 2, 12)), (None, date(2020, 1, 5))], "c int, at date")
    assert [r["c"] for r in pit.near_window(pairs, act, key="c", first="a", last="b", at="at", pad_days=10).collect()] == [1]


def test_empty_snapshots(spark):
    empty = membership(spark).limit(0)
    assert snapshot_calendar(empty, "snapshot_date").collect() == []
    assert pit.members_as_of(days(spark, "2020-03-01"), empty, day="day", date="snapshot_date", member="ticker").collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_validity_and_activity_equal_brute_force(spark, seed):
    """Nested, touching, empty and open ranges, most of them of one key; ties, repeats and nulls."""
    r = random.Random(seed)
    day = lambda lo=0, hi=900: date(2019, 1, 1) + timedelta(days=r.randrange(lo, hi))
    maybe = lambda x: None if r.random() < 0.15 else x
    key = lambda: r.choice(["HOT", "HOT", "B", "C", None, f"k{r.randrange(9)}"])
    ranges = [(key(), maybe(day()), maybe(day()), r.randrange(4), r.randrange(50)) for _ in range(120)]
    ranges += ranges[:5]
    asked = [(key(), maybe(day(-200, 1200)), i) for i in range(150)]
    R = spark.createDataFrame(ranges, "k string, a date, b date, o int, v int")
    A = spark.createDataFrame(asked, "k string, d date, i int")
    got = {x["i"]: x["v"] for x in pit.resolve_validity(A, R, key="k", day="d", valid_from="a", valid_to="b", order=["o", "v"], values=["v"]).collect()}
    for k, d, i in asked:
        own = [x for x in ranges if k is not None and x[0] == k]
        hold = [(o, v) for _, a, b, o, v in own if d and (a is None or a <= d) and (b is None or b >= d)]
        want = min(hold)[1] if hold else own[0][4] if len(own) == 1 else None
        assert got[i] == want, (k, d)
    pairs = spark.createDataFrame([(k, a, b, n) for n, (k, a, b, *_) in enumerate(ranges)], "k string, a date, b date, n int")
    near = {x["n"] for x in pit.near_window(pairs, A, key="k", first="a", last="b", at="d", pad_days=3).collect()}
    pad = timedelta(days=3)
    assert near == {n for n, (k, a, b, *_) in enumerate(ranges) if k and a and b and any(x == k and d and a - pad <= d <= b + pad for x, d, _ in asked)}
    assert pit.resolve_validity(A.limit(0), R, key="k", day="d", valid_from="a", valid_to="b", order=["o"], values=["v"]).collect() == []
