from __future__ import annotations

import random
from datetime import date, timedelta

import pytest

from tests.conftest import rows
from tidemark.operators.snapshots import pruned_share, snapshot_changes, version_history

DAYS = [date(2020, 1, 1) + timedelta(days=11 * i) for i in range(19)]
SCHEMA = "d date, e string, p string, q int, extra string"


def brute_states(data):
    best = {}
    for d, e, p, q, _ in data:
        if e is not None and d is not None:
            key = lambda v: (v[0] is not None, v[0] or "", v[1] is not None, v[1] or 0)
            best[d, e] = min(best.get((d, e), (p, q)), (p, q), key=key)
    return best


def brute_history(data):
    days, best = sorted({r[0] for r in data if r[0]}), brute_states(data)
    out = []
    for e in {k[1] for k in best}:
        run = None
        for i, d in enumerate([*days, None]):
            v = best.get((d, e))
            if run and v != run[1]:
                out.append((e, *run[1], run[0], date(9999, 12, 31) if d is None else d - timedelta(days=1)))
                run = None
            if v is not None and run is None:
                run = (d, v)
    return out


def brute_changes(data):
    days, best = sorted({r[0] for r in data if r[0]}), brute_states(data)
    out = []
    for a, b in zip(days, days[1:]):
        for e in {k[1] for k in best}:
            old, new = best.get((a, e)), best.get((b, e))
            if old != new:
                out.append((b, e, "added" if old is None else "removed" if new is None else "changed"))
    return out


def world(seed, n=400, entities=9):
    r = random.Random(seed)
    data = []
    for _ in range(n):
        data.append((r.choice(DAYS), r.choice([None, *[f"E{i}" for i in range(entities)]]), r.choice([None, "a", "b"]), r.choice([None, 1]), r.choice("xyz")))
    return data + data[:30]


def key(t):
    return [(v is not None, str(v)) for v in t]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("block_bits", [1, 2, 6])
def test_history_equals_brute_force(spark, seed, block_bits):
    data = world(seed)
    got = version_history(spark.createDataFrame(data, SCHEMA), date="d", entity="e", payload=["p", "q"], block_bits=block_bits)
    assert rows(got) == sorted(brute_history(data), key=key)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(("rows_per_leaf", "fanout_bits"), [(8, 1), (1, 2), (1000, 8)])
def test_changes_equal_brute_force(spark, seed, rows_per_leaf, fanout_bits):
    data = world(seed)
    got = snapshot_changes(spark.createDataFrame(data, SCHEMA), date="d", entity="e", payload=["p", "q"], rows_per_leaf=rows_per_leaf, fanout_bits=fanout_bits)
    assert rows(got) == sorted(brute_changes(data), key=key)


def test_hot_entity_that_changes_every_time(spark):
    data = [(DAYS[i % 19], "HOT", str(i % 2), i % 19, "") for i in range(19 * 40)]
    got = version_history(spark.createDataFrame(data, SCHEMA), date="d", entity="e", payload=["p", "q"])
    assert rows(got) == sorted(brute_history(data), key=key)


def test_empty_and_null_only(spark):
    empty = spark.createDataFrame([], SCHEMA)
    nulls = spark.createDataFrame([(DAYS[0], None, "a", 1, ""), (None, "E", "a", 1, "")], SCHEMA)
    for df in (empty, nulls):
        assert version_history(df, date="d", entity="e", payload=["p", "q"]).collect() == []
        assert snapshot_changes(df, date="d", entity="e", payload=["p", "q"]).collect() == []


def test_a_snapshot_without_entities_ends_versions(spark):
    data = [(DAYS[0], "E", "a", 1, ""), (DAYS[1], None, None, None, ""), (DAYS[2], "E", "a", 1, "")]
    df = spark.createDataFrame(data, SCHEMA)
    assert [r[3:] for r in rows(version_history(df, date="d", entity="e", payload=["p", "q"]))] == [(DAYS[0], DAYS[1] - timedelta(days=1)), (DAYS[2], date(9999, 12, 31))]
    assert rows(snapshot_changes(df, date="d", entity="e", payload=["p", "q"])) == [(DAYS[1], "E", "removed"), (DAYS[2], "E", "added")]


def test_no_payload_means_presence(spark):
    data = [(DAYS[0], "E", "a", 1, ""), (DAYS[1], "E", "b", 2, ""), (DAYS[2], "F", "b", 2, "")]
    got = version_history(spark.createDataFrame(data, SCHEMA), date="d", entity="e", payload=[])
    assert rows(got) == [("E", DAYS[0], DAYS[2] - timedelta(days=1)), ("F", DAYS[2], date(9999, 12, 31))]


def test_unchanged_leaves_need_no_rows(spark):
    """Twenty of 4,000 entities change: nearly all leaves are passed over, at any size."""
    for n in (400, 4000):
        data = [(d, f"e{i}", str(d.day if i % 200 == 0 else 0), i, "") for d in DAYS[:2] for i in range(n)]
        (row,) = pruned_share(spark.createDataFrame(data, SCHEMA), date="d", entity="e", payload=["p", "q"]).collect()
        assert row["differing"] == n // 200 and row["pruned_share"] > 0.95
