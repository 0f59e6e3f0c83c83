"""Timestamps written in many formats, precisions and zones, brought to one form.

A text is cut to a shape mask: every digit becomes ``9``, every ASCII letter ``A``, the rest
stays.  All texts of one mask have the same width and field positions, so a mask is turned into
a parser once per worker and all its texts are then converted together, column-wise.  Zones are
applied through transition tables made from the time zone database, keyed by its version; a
worker whose version differs from the driver's refuses to run rather than answer differently.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = "[\\s\\u00a0\\u2000-\\u200b\\u202f\\u3000\\ufeff]+"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
RESULT = "instant_us long, wall_day int, zoned boolean, has_time boolean"

# Names of months and zones.
MONTHS = "january february march april may june july august september october november december".split()
ZONE_MINUTES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "wet": 0, "west": 60, "bst": 60, "cet": 60,
    "cest": 120, "eet": 120, "eest": 180, "msk": 180, "jst": 540, "kst": 540, "hkt": 480, "sgt": 480, "aest": 600, "aedt": 660,
}
ZONE_RULES = {"et": "America/New_York", "ct": "America/Chicago", "mt": "America/Denver", "pt": "America/Los_Angeles"}
HALF_DAY = {"am": 0, "a.m.": 0, "pm": 1, "p.m.": 1}

_TIME = r"(?P<h>9{1,2}):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?"
_ZONE = r"(?: ?(?P<w1>A\.A\.|A+))?(?: ?\(?(?P<w2>A+)\)?)?(?: ?(?P<o>[+-]99(?::?99)?))?"
_SEP = r"(?:(?P<t>A)|,? (?P<at>AA) |,? )"
_DATES = [
    r"(?P<y>9{4})(?P<q>[-/.])(?P<mo>9{1,2})(?P=q)(?P<d>9{1,2})",
    r"(?P<n1>9{1,2})(?P<q>[-/.])(?P<n2>9{1,2})(?P=q)(?P<y>9{4})",
    r"(?P<d>9{1,2})\.?[- ](?P<mon>A{3,9})\.?,?[- ](?P<y>9{4})",
    r"(?P<mon>A{3,9})\.? (?P<d>9{1,2}),? (?P<y>9{4})",
]
_PREFIX = r"(?:<[A-]+> ?|A+: ?|A{2,9}\.?,? )?"
_SHAPES = [
    re.compile(_PREFIX + r"(?P<y>9{4})(?P<mo>99)(?P<d>99)(?:[ ]?(?P<t>A)?(?P<h>99)(?P<mi>99)(?P<s>99)?(?:[.,](?P<f>9+))?" + _ZONE + r")?"),
    re.compile(_PREFIX + r"(?P<y>9{4})年(?P<mo>9{1,2})月(?P<d>9{1,2})日(?: ?(?P<h>9{1,2})時(?P<mi>9{1,2})分(?:(?P<s>9{1,2})秒)?" + _ZONE + r")?"),
    *[re.compile(_PREFIX + d + r"(?:" + _SEP + _TIME + _ZONE + r")?") for d in _DATES],
]
_EPOCH = re.compile(r"(?P<sign>-?)(?P<n>9{9,11}|9{13}|9{15,16}|9{18,19})(?:\.(?P<f>9+))?")
_EPOCH_UNIT = {**dict.fromkeys((9, 10, 11), 1_000_000), 13: 1_000, 15: 1, 16: 1}


@dataclass(frozen=True)
class Shape:
    """Where the fields of a mask lie; ``epoch`` for counts of time since 1970."""

    span: dict[str, tuple[int, int]]
    day_first_mark: bool
    epoch: bool


def compile_mask(mask: str) -> Shape | None:
    """The parser of a mask, or None where it gives no full date."""
    for shape in _SHAPES:
        if m := shape.fullmatch(mask):
            span = {k: m.span(k) for k, v in m.groupdict().items() if v}
            return Shape(span, bool(span.get("q")) and mask[span["q"][0]] == ".", False)
    if m := _EPOCH.fullmatch(mask):
        return Shape({k: m.span(k) for k, v in m.groupdict().items() if v}, False, True)
    return None


_compiled: dict[str, Shape | None] = {}


def _shape(mask: str) -> Shape | None:
    if mask not in _compiled:
        if len(_compiled) > 50_000:
            _compiled.clear()
        _compiled[mask] = compile_mask(mask)
    return _compiled[mask]


def zone_version() -> str:
    """Version of the time zone database that ``zoneinfo`` reads here."""
    import zoneinfo

    for root in zoneinfo.TZPATH:
        p = Path(root) / "tzdata.zi"
        if p.exists():
            return p.open().readline().strip().removeprefix("# version ")
    try:
        from importlib.metadata import version

        return version("tzdata")
    except Exception:  # noqa: BLE001
        return "unknown"


CYCLE = 146_097 * 86_400  # 400 years, a whole number of weeks: the rules of all zones repeat after it
_SCANNED = [(-5_364_662_400, 20), (-2_208_988_800, 1), (4_102_444_800, 20)]  # from 1800, 1900 and 2100 on: days between looks
_SCAN_END = 16_725_225_600  # 2500


@lru_cache(maxsize=None)
def transitions(version: str, name: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(instants at which an offset begins, offsets), seconds, 1800 to 2500; None for no zone.

    Before 1800 the first offset holds; what comes after 2500 repeats with :data:`CYCLE`.
    """
    import zoneinfo

    try:
        zone = zoneinfo.ZoneInfo(name)
    except Exception:  # noqa: BLE001
        return None

    def offset(at: int) -> int:
        return int((datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=at)).astimezone(zone).utcoffset().total_seconds())

    prev = _SCANNED[0][0]
    at, off = [-(1 << 50)], [offset(prev)]
    ends = [first for first, _ in _SCANNED[1:]] + [_SCAN_END]
    for (first, days), end in zip(_SCANNED, ends):
        for look in range(first, end, days * 86400):
            if offset(look) != off[-1]:
                lo, hi = prev, look
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (mid, hi) if offset(mid) == off[-1] else (lo, mid)
                at.append(hi)
                off.append(offset(hi))
            prev = look
    return np.array(at, dtype=np.int64), np.array(off, dtype=np.int64)


def wall_to_instant(wall: np.ndarray, zone: str, version: str) -> tuple[np.ndarray, np.ndarray]:
    """Seconds of wall time to seconds of UTC and whether they exist; of two, the first."""
    table = transitions(version, zone)
    if table is None:
        return wall, np.zeros(len(wall), dtype=bool)
    at, off = table

    def offset(s: np.ndarray) -> np.ndarray:
        rounds = np.maximum(-(-(s + 86_400 - _SCAN_END) // CYCLE), 0)
        return off[np.searchsorted(at, s - rounds * CYCLE, side="right") - 1]

    o1, o2 = offset(wall - 86400 - off.max()), offset(wall + 86400 - off.min())
    u1, u2 = wall - o1, wall - o2
    ok1, ok2 = offset(u1) == o1, offset(u2) == o2
    both = np.where(ok1 & ok2, np.minimum(u1, u2), np.where(ok1, u1, u2))
    return both, ok1 | ok2


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 and whether the day is real."""
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    y, m = np.where(ok, y, 2000), np.where(ok, m, 1)
    month = (y - 1970) * 12 + m - 1
    start = month.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    end = (month + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return start + d - 1, ok & (d <= end - start)


def _convert(texts: list[str], zones: np.ndarray, day_first: np.ndarray, shape: Shape, version: str) -> tuple[np.ndarray, ...]:
    """Columns (instant_us, instant ok, wall day, day ok, zoned, has time) of texts of one mask."""
    n, width = len(texts), len(texts[0])
    grid = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(n, width).astype(np.int64)

    def number(name: str, cut: int = 99) -> np.ndarray:
        lo, hi = shape.span[name]
        out = np.zeros(n, dtype=np.int64)
        for i in range(lo, min(hi, lo + cut)):
            out = out * 10 + grid[:, i] - 48
        return out

    def words(name: str) -> pd.Series:
        lo, hi = shape.span[name]
        return pd.Series([t[lo:hi].lower() for t in texts])

    has = shape.span.__contains__
    yes, no = np.ones(n, dtype=bool), np.zeros(n, dtype=bool)
    micro = np.zeros(n, dtype=np.int64)
    if has("f"):
        lo, hi = shape.span["f"]
        digits = min(hi - lo, 6)
        micro = number("f", 6) * 10 ** (6 - digits)
    if shape.epoch:
        lo, hi = shape.span["n"]
        if hi - lo >= 18:  # nanoseconds
            us = number("n", hi - lo - 3)
        else:
            us = number("n") * _EPOCH_UNIT[hi - lo]
            if hi - lo <= 11:
                us = us + micro
            elif hi - lo == 13:
                us = us + micro // 1000
        if has("sign"):
            us = -us
        return us, yes, np.floor_divide(us, 86_400_000_000), yes, yes, yes

    y = number("y")
    ok = yes.copy()
    if has("n1"):
        a, b = number("n1"), number("n2")
        by_mark = np.array([shape.day_first_mark if v is None or v != v else bool(v) for v in day_first], dtype=bool)
        d, m = np.where(by_mark, a, b), np.where(by_mark, b, a)
    else:
        d = number("d")
        if has("mon"):
            w = words("mon")
            known = {x: next((i + 1 for i, name in enumerate(MONTHS) if name.startswith(x)), 0) for x in w.unique()}
            m = w.map(known).to_numpy(dtype=np.int64)
        else:
            m = number("mo")
    day, real = _days(y, m, d)
    ok &= real
    if not has("h"):
        return np.zeros(n, dtype=np.int64), no, day, ok, no, no

    for name, allowed in (("t", {"t"}), ("at", {"at"})):
        if has(name):
            ok &= words(name).isin(allowed).to_numpy()
    h, mi = number("h"), number("mi")
    s = number("s") if has("s") else np.zeros(n, dtype=np.int64)
    half = np.full(n, -1)
    fixed = np.full(n, np.nan)
    rule = np.full(n, None, dtype=object)
    for name in ("w1", "w2"):
        if has(name):
            w = words(name)
            if name == "w1":
                half = w.map(HALF_DAY).fillna(-1).to_numpy(dtype=np.int64)
            is_half = (half >= 0) if name == "w1" else no
            minutes = w.map(ZONE_MINUTES).to_numpy(dtype=float)
            region = w.map(ZONE_RULES).to_numpy(dtype=object)
            in_rule = np.array([isinstance(x, str) for x in region], dtype=bool)
            ok &= is_half | ~np.isnan(minutes) | in_rule
            fixed = np.where(~np.isnan(minutes) & ~is_half, minutes, fixed)
            rule = np.where(in_rule & ~is_half, region, rule)
    if has("o"):
        lo, hi = shape.span["o"]
        body = grid[:, [i for i in range(lo + 1, hi) if texts[0][i].isdigit()]] - 48
        hours, minutes = body[:, 0] * 10 + body[:, 1], (body[:, 2] * 10 + body[:, 3] if body.shape[1] == 4 else 0)
        ok &= (hours <= 18) & (minutes < 60)
        fixed = np.where(grid[:, lo] == ord("-"), -1, 1) * (hours * 60 + minutes).astype(float)
        rule = np.full(n, None, dtype=object)
    twelve = half >= 0
    ok &= np.where(twelve, (h >= 1) & (h <= 12), h <= 23) & (mi <= 59) & (s <= 59)
    h = np.where(twelve, h % 12 + 12 * (half == 1), h)
    wall = day * 86400 + h * 3600 + mi * 60 + s
    by_rule = np.array([isinstance(r, str) for r in rule], dtype=bool)
    zoned = ~np.isnan(fixed) | by_rule
    instant = np.where(np.isnan(fixed), 0, wall - np.nan_to_num(fixed).astype(np.int64) * 60)
    exists = ~np.isnan(fixed)
    name = np.where(np.isnan(fixed), np.where(by_rule, rule, zones), None)
    for zone in {z for z in name if isinstance(z, str)}:
        at = np.flatnonzero(name == zone)
        instant[at], exists[at] = wall_to_instant(wall[at], zone, version)
    return instant * 1_000_000 + micro, ok & exists, day, ok, zoned & ok, yes


def parse_batch(text: pd.Series, mask: pd.Series, zone: pd.Series, day_first: pd.Series, version: str) -> pd.DataFrame:
    n = len(text)
    us, us_ok = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    day, day_ok = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    zoned, timed = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    codes, masks = pd.factorize(mask)
    order = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[order], np.arange(len(masks) + 1))
    values, zones, flags = text.to_numpy(dtype=object), zone.to_numpy(dtype=object), day_first.to_numpy(dtype=object)
    for i, m in enumerate(masks):
        shape = _shape(m)
        if shape is None:
            continue
        at = order[bounds[i] : bounds[i + 1]]
        us[at], us_ok[at], day[at], day_ok[at], zoned[at], timed[at] = _convert(list(values[at]), zones[at], flags[at], shape, version)
    return pd.DataFrame(
        {
            "instant_us": pd.array(us, dtype="Int64").copy() if us_ok.all() else pd.Series(us, dtype="Int64").where(us_ok),
            "wall_day": pd.Series(day, dtype="Int32").where(day_ok),
            "zoned": zoned,
            "has_time": timed,
        }
    )


def parse_timestamp(text: Column, zone: Column | None = None, day_first: Column | None = None) -> Column:
    """struct<instant_us, wall_day, zoned, has_time> of a text.

    * ``instant_us``: the instant in microseconds (finer digits are cut), where the text or else
      ``zone`` (an IANA name) settles it.  Of a wall time that occurs twice the first counts; one
      that never occurs has none.
    * ``wall_day``: the day as written, days since 1970; null where no full, real date (and, if
      a time stands there, a real time) is given.
    * ``zoned``: the text itself names a zone or offset, or counts time since 1970.
    * ``has_time``: a time of day stands in the text.

    Seconds that are missing are zero.  ``day_first`` says how all-number dates that do not begin
    with the year are read; where it is null, dots mean day first and other marks month first.
    A null or empty text, an unknown zone word and any other shape give nulls, never an error.
    """
    version = zone_version()

    @F.pandas_udf(RESULT)
    def convert(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        if (here := zone_version()) != version:
            raise RuntimeError(f"time zone database {here} here, {version} on the driver")
        for text, mask, zone, flag in batches:
            yield parse_batch(text, mask, zone, flag, version)

    clean = F.btrim(F.regexp_replace(text, BLANKS, " "))
    mask = F.translate(clean, "0123456789" + _LETTERS + _LETTERS.upper(), "9" * 10 + "A" * 52)
    none = F.lit(None)
    return convert(F.coalesce(clean, F.lit("")), F.coalesce(mask, F.lit("")), none.cast("string") if zone is None else zone, none.cast("boolean") if day_first is None else day_first)


def iso_utc(instant_us: Column) -> Column:
    return F.date_format(F.timestamp_micros(instant_us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
