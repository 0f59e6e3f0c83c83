from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import timestamps as ts

NY = "America/New_York"
CASES = [  # text, zone of the feed, day first, instant or None
    ("2012-02-07 14:20:44", NY, False, "2012-02-07T19:20:44.000000Z"),
    ("2012-07-07 14:20:44", NY, False, "2012-07-07T18:20:44.000000Z"),
    ("Accepted: 2012-11-01 13:47:50", NY, False, "2012-11-01T17:47:50.000000Z"),
    ("<ACCEPTANCE-DATETIME>20120203155635", NY, False, "2012-02-03T20:56:35.000000Z"),
    ("  20120723173827 ", NY, False, "2012-07-23T21:38:27.000000Z"),
    ("2012-03-08t21:12:53.905427z", "UTC", False, "2012-03-08T21:12:53.905427Z"),
    ("2012-01-06T04:24:25.151313999Z", "UTC", False, "2012-01-06T04:24:25.151313Z"),
    ("2012-02-04T02:13:28.1", "UTC", False, "2012-02-04T02:13:28.100000Z"),
    ("01/30/2012 12:41:14 PM PT", NY, False, "2012-01-30T20:41:14.000000Z"),
    ("01/30/2012 12:41:14 AM", NY, False, "2012-01-30T05:41:14.000000Z"),
    ("3/3/2012 8:45:15 EST", NY, False, "2012-03-03T13:45:15.000000Z"),
    ("January 25, 2012 at 6:08 pm PST", NY, False, "2012-01-26T02:08:00.000000Z"),
    ("Jan 25, 2012 6:08 p.m. PT", NY, False, "2012-01-26T02:08:00.000000Z"),
    ("06/03/2012 20:25", "Europe/London", True, "2012-03-06T20:25:00.000000Z"),
    ("11.02.2012 09:17", "Europe/Berlin", True, "2012-02-11T08:17:00.000000Z"),
    ("17.2.2012 21:26:32,787 CET", "Europe/Berlin", True, "2012-02-17T20:26:32.787000Z"),
    ("22-JAN-2012 03:29:27 CET", "Europe/London", True, "2012-01-22T02:29:27.000000Z"),
    ("2012年1月4日 3時40分", "Asia/Tokyo", False, "2012-01-03T18:40:00.000000Z"),
    ("20120303T081750JST", "Asia/Tokyo", False, "2012-03-02T23:17:50.000000Z"),
    ("Fri, 03 Feb 2012 12:30:03 -0800", NY, False, "2012-02-03T20:30:03.000000Z"),
    ("Thu, 22 Mar 2012 17:26:28 GMT", NY, False, "2012-03-22T17:26:28.000000Z"),
    ("2014-05-17T04:03:35.0 +0545", NY, False, "2014-05-16T22:18:35.000000Z"),
    ("2012-02-29T16:57:20-04", NY, False, "2012-02-29T20:57:20.000000Z"),
    ("1325714053", "UTC", False, "2012-01-04T21:54:13.000000Z"),
    ("1328306949267", "UTC", False, "2012-02-03T22:09:09.267000Z"),
    ("1329254348059718", "UTC", False, "2012-02-14T21:19:08.059718Z"),
    ("1334233779.854", "UTC", False, "2012-04-12T12:29:39.854000Z"),
    ("2012-11-04 01:30:00", NY, False, "2012-11-04T05:30:00.000000Z"),  # twice: the first
    ("2012-03-11 02:30:00", NY, False, None),  # never
    ("2019-02-30 11:15:00", NY, False, None),
    ("20211345101500", NY, False, None),
    ("0000-00-00 00:00:00", NY, False, None),
    ("2012-01-04", NY, False, None),  # no time
    ("2012-01-04 25:00:00", NY, False, None),
    ("2012-01-04 10:00:00 XYZ", NY, False, None),
    ("13/13/2012 10:00:00", NY, False, None),
    ("pending", NY, False, None), ("", NY, False, None), (None, NY, False, None), ("9" * 5000, NY, False, None), ("2012-01-04 10:00:00", "No/Zone", False, None), ("2012-01-04 10:00:00", None, None, None),
]


def test_instants(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, text string, zone string, day_first boolean")
    at = df.withColumn("at", ts.parse_timestamp(F.col("text"), F.col("zone"), F.col("day_first")))
    got = {r["i"]: r["norm"] for r in at.select("i", F.when(F.col("at.has_time"), ts.iso_utc(F.col("at.instant_us"))).alias("norm")).collect()}
    assert {c[0]: got[i] for i, c in enumerate(CASES)} == {c[0]: c[3] for c in CASES}


def test_days_without_zone(spark):
    cases = {"31.01.2017": "2017-01-31", "02/28/2017": "2017-02-28", "31-Oct-2017": "2017-10-31", "20180430": "2018-04-30", "July 31, 2017": "2017-07-31", "2019-03-29 16:00": "2019-03-29", "2019-04": None, "2019-02-29": None, "n/a": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("at", ts.parse_timestamp(F.col("t")))
    got = {r["t"]: r["d"] for r in df.select("t", F.date_from_unix_date("at.wall_day").cast("string").alias("d")).collect()}
    assert got == cases


@pytest.mark.parametrize("name", [NY, "Europe/London", "Australia/Lord_Howe", "Asia/Tokyo", "UTC"])
def test_wall_times_agree_with_zoneinfo(name):
    zone, rng = ZoneInfo(name), np.random.default_rng(0)
    walls = rng.integers(int(datetime(1975, 1, 1).timestamp()), int(datetime(2035, 1, 1).timestamp()), 3000)
    walls = np.concatenate([walls, np.arange(datetime(2012, 11, 4, tzinfo=timezone.utc).timestamp(), datetime(2012, 11, 4, 6, tzinfo=timezone.utc).timestamp(), 300).astype(int)])
    got, ok = ts.wall_to_instant(walls, name, ts.zone_version())
    for w, g, o in zip(walls.tolist(), got.tolist(), ok.tolist()):
        local = (datetime(1970, 1, 1) + timedelta(seconds=w)).replace(tzinfo=zone, fold=0)
        u = local.astimezone(timezone.utc)
        exists = u.astimezone(zone).replace(tzinfo=None, fold=0) == local.replace(tzinfo=None)
        assert o == exists and (not exists or g == int(u.timestamp()))


def test_a_mask_is_compiled_once():
    ts._compiled.clear()
    batch = pd.Series(["2012-02-07 14:20:44"] * 50 + ["x"] * 5)
    mask = pd.Series(["9999-99-99 99:99:99"] * 50 + ["A"] * 5)
    out = ts.parse_batch(batch, mask, pd.Series([NY] * 55, dtype=object), pd.Series([None] * 55, dtype=object), ts.zone_version())
    assert len(ts._compiled) == 2 and out["instant_us"].notna().sum() == 50


def test_empty_table(spark):
    df = spark.createDataFrame([], "t string").withColumn("at", ts.parse_timestamp(F.col("t")))
    assert df.collect() == []


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin", "Australia/Sydney", "Africa/Casablanca", "Asia/Kolkata", "America/Caracas"])
def test_zone_tables_hold_in_every_century(zone):
    """Against the time zone library itself, up to where it counts itself, and by the 400 years after which rules repeat."""
    z, version = ZoneInfo(zone), ts.zone_version()
    walls = [datetime(y, m, d, 12) for y in (1, 1700, 1850, 1899, 1943, 1999, 2024, 2100, 2150, 2499, 2500, 2950, 9999) for m, d in ((1, 15), (7, 1), (3, 28), (10, 30))]
    secs = np.array([int((w - datetime(1970, 1, 1)).total_seconds()) for w in walls])
    got, ok = ts.wall_to_instant(secs, zone, version)
    want = [s - int(w.replace(tzinfo=z).utcoffset().total_seconds()) for s, w in zip(secs, walls)]
    assert ok.all() and got.tolist() == want
