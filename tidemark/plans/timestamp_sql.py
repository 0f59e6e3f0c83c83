"""SQL of p7: another reading of the same texts, by one pattern per layout, for comparison in DuckDB."""

from __future__ import annotations

Z = r" ?\(?([A-Za-z]{1,4})?\)? ?([+-]\d\d(?::?\d\d)?)?"
T = r"(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?(?: ?([AaPp]\.?[Mm]\.?))?" + Z
PRE = r"^(?:<[A-Z-]+> ?|[A-Za-z]+: ?|[A-Za-z]{2,9}\.?,? )?"
SHAPES = [
    ("ymd", PRE + r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:(?:[Tt]| )" + T + ")?$"),
    ("nny", PRE + r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:[ T]" + T + ")?$"),
    ("dby", PRE + r"(\d{1,2})[- ]([A-Za-z]{3,9})[- ](\d{4})(?: " + T + ")?$"),
    ("bdy", PRE + r"([A-Za-z]{3,9}) (\d{1,2}),? (\d{4})(?: (?:at )?" + T + ")?$"),
    ("cjk", r"^(\d{4})年(\d{1,2})月(\d{1,2})日(?: ?(\d{1,2})時(\d{1,2})分(?:(\d{1,2})秒)?()()" + Z + ")?$"),
    ("run", PRE + r"(\d{4})(\d\d)(\d\d)(?:[T ]?(\d\d)(\d\d)(\d\d)()()" + Z + ")?$"),
]
NAMES = "['a','b','c','h','mi','s','f','ap','w','o']"


def sql() -> str:
    pick = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN struct_insert(regexp_extract(s, '{p}', {NAMES}), shape := '{n}')" for n, p in SHAPES) + " END"
    return f"""
WITH feeds_r AS (SELECT DISTINCT feed, tz_name, day_first FROM feeds),
src AS (
  SELECT 'filings_raw' AS src, raw_id AS record_id, acceptance_datetime AS x, tz_name, day_first FROM filings_raw LEFT JOIN feeds_r USING (feed)
  UNION SELECT 'backtest_llm_change_monthly', row_id, rebalance_date, NULL, NULL FROM backtest_llm_change_monthly),
clean AS (SELECT src, record_id, tz_name, day_first, trim(regexp_replace(x, '[\\s\\x{{00a0}}]+', ' ', 'g')) AS s FROM src WHERE x IS NOT NULL),
epochs AS (
  SELECT *, CASE WHEN regexp_matches(s, '^\\d{{9,11}}$') THEN s::BIGINT * 1000000 WHEN regexp_matches(s, '^\\d{{13}}$') THEN s::BIGINT * 1000 WHEN regexp_matches(s, '^\\d{{15,16}}$') THEN s::BIGINT
    WHEN regexp_matches(s, '^\\d{{9,11}}\\.\\d+$') THEN split_part(s, '.', 1)::BIGINT * 1000000 + rpad(left(split_part(s, '.', 2), 6), 6, '0')::BIGINT END AS us FROM clean),
shaped AS (SELECT *, CASE WHEN us IS NULL THEN {pick} END AS p FROM epochs),
parts AS (
  SELECT src, record_id, tz_name, us, p.shape AS shape, p.a AS a, p.b AS b, p.c AS c, nullif(p.h, '') AS h, nullif(p.mi, '') AS mi, nullif(p.s, '') AS sec, nullif(p.f, '') AS f, lower(replace(nullif(p.ap, ''), '.', '')) AS ap,
    lower(nullif(p.w, '')) AS w, nullif(p.o, '') AS o, coalesce(day_first, contains(s, '.')) AS df FROM shaped),
ymd AS (
  SELECT *, CASE shape WHEN 'ymd' THEN a WHEN 'cjk' THEN a WHEN 'run' THEN a ELSE c END AS y,
    CASE WHEN shape IN ('ymd', 'cjk', 'run') THEN b WHEN shape = 'nny' THEN CASE WHEN df THEN b ELSE a END
         ELSE (list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(left(CASE shape WHEN 'dby' THEN b ELSE a END, 3))))::VARCHAR END AS m,
    CASE WHEN shape IN ('ymd', 'cjk', 'run') THEN c WHEN shape = 'nny' THEN CASE WHEN df THEN a ELSE b END WHEN shape = 'dby' THEN a ELSE b END AS d FROM parts),
walls AS (
  SELECT *, try_cast(y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') AS DATE) AS day,
    CASE WHEN ap IS NULL THEN h::INT WHEN h::INT BETWEEN 1 AND 12 THEN h::INT % 12 + CASE ap WHEN 'pm' THEN 12 ELSE 0 END END AS hh,
    rpad(left(coalesce(f, ''), 6), 6, '0')::BIGINT AS micro,
    map(['z','utc','gmt','est','edt','cst','cdt','mst','mdt','pst','pdt','bst','cet','cest','jst'], [0,0,0,-300,-240,-360,-300,-420,-360,-480,-420,60,60,120,540])[w] AS wmin,
    map(['et','ct','mt','pt'], ['America/New_York','America/Chicago','America/Denver','America/Los_Angeles'])[w] AS wzone,
    CASE WHEN o IS NOT NULL THEN (CASE left(o, 1) WHEN '-' THEN -1 ELSE 1 END) * (substr(o, 2, 2)::INT * 60 + coalesce(nullif(right(replace(substr(o, 4), ':', ''), 2), '')::INT, 0)) END AS omin FROM ymd),
ok AS (
  SELECT src, record_id, us, day, h IS NOT NULL AS timed, micro, coalesce(omin, wmin) AS fixed, CASE WHEN coalesce(omin, wmin) IS NULL THEN coalesce(wzone, tz_name) END AS zone, us IS NOT NULL OR omin IS NOT NULL OR w IS NOT NULL AS zoned,
    CASE WHEN h IS NOT NULL THEN day + to_hours(hh) + to_minutes(mi::INT) + to_seconds(coalesce(sec, '0')::INT) END AS wall
  FROM walls WHERE us IS NOT NULL OR (day IS NOT NULL AND (h IS NULL OR (hh <= 23 AND mi::INT <= 59 AND coalesce(sec, '0')::INT <= 59 AND (w IS NULL OR wmin IS NOT NULL OR wzone IS NOT NULL))))),
inst AS (
  SELECT *, CASE WHEN us IS NOT NULL THEN us WHEN fixed IS NOT NULL THEN epoch_us(wall) - fixed::BIGINT * 60000000 + micro
    WHEN zone IS NOT NULL AND wall IS NOT NULL THEN (CASE WHEN timezone(zone, timezone(zone, wall) - INTERVAL 1 HOUR) = wall THEN epoch_us(timezone(zone, wall) - INTERVAL 1 HOUR)
      WHEN timezone(zone, timezone(zone, wall)) = wall THEN epoch_us(timezone(zone, wall)) END) + micro END AS at_us FROM ok)
SELECT DISTINCT src, record_id, CASE WHEN src = 'filings_raw' THEN strftime(make_timestamp(at_us), '%Y-%m-%dT%H:%M:%S.%fZ')
    WHEN zoned THEN timezone('America/New_York', make_timestamptz(at_us))::DATE::VARCHAR ELSE day::VARCHAR END AS norm
FROM inst WHERE (src = 'filings_raw' AND (timed OR us IS NOT NULL) AND at_us IS NOT NULL) OR (src <> 'filings_raw' AND (NOT zoned OR at_us IS NOT NULL))"""
