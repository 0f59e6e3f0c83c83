from __future__ import annotations

import random
from datetime import date, timedelta

import pytest

from tests.conftest import rows
from tidemark.operators.intervals import periods_and_gaps

SCHEMA = "k string, a date, b date, note string"
ORIGIN = date(2020, 1, 1)


def brute(data):
    out = []
    for k in {r[0] for r in data if r[0] is not None}:
        spans = sorted((a or date.min, b or date.max.replace(month=12, day=31)) for kk, a, b, _ in data if kk == k and (a or date.min) <= (b or date.max))
        merged = []
        for a, b in spans:
            if merged and (merged[-1][1] == date.max or a <= merged[-1][1] + timedelta(days=1)):
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(k, "period", a, b) for a, b in merged]
        out += [(k, "gap", x[1] + timedelta(days=1), y[0] - timedelta(days=1)) for x, y in zip(merged, merged[1:])]
    return sorted(out, key=lambda t: [(v is not None, str(v)) for v in t])


@pytest.mark.parametrize("width", [1, 5, 64, 1024])
@pytest.mark.parametrize("seed", range(5))
def test_equals_brute_force(spark, width, seed):
    r = random.Random(seed)
    data = []
    for _ in range(60):
        a = ORIGIN + timedelta(days=r.randrange(300))
        b = a + timedelta(days=r.choice([-3, 0, 0, 1, 4, 9, 40]))
        data.append((r.choice(["A", "B", "C", None]), None if r.random() < 0.02 else a, None if r.random() < 0.02 else b, "n"))
    data += data[:9]
    got = periods_and_gaps(spark.createDataFrame(data, SCHEMA), keys=["k"], valid_from="a", valid_to="b", shard_days=max(width, 2) if any(x[1] is None or x[2] is None for x in data) else width)
    assert rows(got) == brute(data)


def test_meeting_days_and_empty_ranges(spark):
    data = [("A", date(2020, 1, 1), date(2020, 1, 5), ""), ("A", date(2020, 1, 6), date(2020, 1, 7), ""), ("A", date(2020, 1, 10), date(2020, 1, 9), ""), ("B", date(2020, 1, 3), date(2020, 1, 2), "")]
    got = periods_and_gaps(spark.createDataFrame(data, SCHEMA), keys=["k"], valid_from="a", valid_to="b")
    assert rows(got) == [("A", "period", date(2020, 1, 1), date(2020, 1, 7))]


def test_open_bounds(spark):
    df = spark.createDataFrame([("A", None, date(2020, 1, 5), ""), ("A", date(2020, 2, 1), None, ""), ("B", None, None, "")], SCHEMA)
    out = periods_and_gaps(df, keys=["k"], valid_from="a", valid_to="b").selectExpr("k", "kind", "string(day_from)", "string(day_to)")
    assert rows(out) == [
        ("A", "gap", "2020-01-06", "2020-01-31"), ("A", "period", "0001-01-01", "2020-01-05"), ("A", "period", "2020-02-01", "9999-12-31"), ("B", "period", "0001-01-01", "9999-12-31")]


def test_empty(spark):
    assert periods_and_gaps(spark.createDataFrame([], SCHEMA), keys=["k"], valid_from="a", valid_to="b").collect() == []
