"""Queries p1, p2, p5, p6 and p7: the temporal operators on their production tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import Catalog
from tidemark.functions import normal
from tidemark.operators import eventtime, intervals, pit, snapshots, timestamps
from tidemark.plans import timestamp_sql
from tidemark.session import pin, stage
from tidemark.sources.tables import load

catalog = Catalog()
SLICE_DAYS = 512  # width of the time slices of p6

_MEMBERS = """
WITH raw AS (
  SELECT snapshot_date, nullif(replace(upper(trim(ticker, ' ' || chr(9))), '-', '.'), '') AS ticker,
         lower(trim(sector, ' ' || chr(9))) AS sector, size_band
  FROM membership WHERE snapshot_date IS NOT NULL),
cal AS (
  SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) - 1 AS k,
         lead(snapshot_date) OVER (ORDER BY snapshot_date) AS next_date
  FROM (SELECT DISTINCT snapshot_date FROM raw)),
one AS (
  SELECT k, ticker, sector, size_band FROM raw JOIN cal USING (snapshot_date) WHERE ticker IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_date, ticker ORDER BY sector NULLS FIRST, size_band NULLS FIRST) = 1)
"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership with comparable spellings; rows without a ticker keep their date only."""
    m = load(spark, sf_dir, "membership")
    return m.select("snapshot_date", normal.ticker(F.col("ticker")).alias("ticker"), normal.label(F.col("sector")).alias("sector"), "size_band")


@catalog.query(
    "p1_found",
    _MEMBERS
    + """, marked AS (
  SELECT *, CASE WHEN lag(k) OVER w = k - 1 AND lag(sector) OVER w IS NOT DISTINCT FROM sector
                  AND lag(size_band) OVER w IS NOT DISTINCT FROM size_band THEN 0 ELSE 1 END AS is_new
  FROM one WINDOW w AS (PARTITION BY ticker ORDER BY k)),
runs AS (SELECT *, sum(is_new) OVER (PARTITION BY ticker ORDER BY k) AS run FROM marked),
ends AS (SELECT ticker, run, min(k) AS f, max(k) AS l FROM runs GROUP BY ticker, run)
SELECT ticker, strftime(c1.snapshot_date, '%Y-%m-%d') AS valid_from,
       coalesce(strftime(c2.next_date - INTERVAL 1 DAY, '%Y-%m-%d'), '9999-12-31') AS valid_to
FROM ends JOIN cal c1 ON c1.k = f JOIN cal c2 ON c2.k = l""",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = snapshots.version_history(members(pin(spark), sf_dir), date="snapshot_date", entity="ticker", payload=["sector", "size_band"])
    return h.select("ticker", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))


@catalog.query(
    "p2_found",
    _MEMBERS
    + """, sides AS (
  SELECT coalesce(n.k, o.k + 1) AS k, coalesce(n.ticker, o.ticker) AS ticker,
         CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed'
              WHEN n.sector IS DISTINCT FROM o.sector OR n.size_band IS DISTINCT FROM o.size_band THEN 'changed' END AS change_type
  FROM one n FULL JOIN one o ON n.k = o.k + 1 AND n.ticker = o.ticker)
SELECT strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, ticker, change_type
FROM sides JOIN cal USING (k) WHERE change_type IS NOT NULL AND k > 0""",
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = snapshots.snapshot_changes(members(pin(spark), sf_dir), date="snapshot_date", entity="ticker", payload=["sector", "size_band"])
    return c.select(F.col("snapshot_date").cast("string").alias("snapshot_date"), "ticker", "change_type")


@catalog.query(
    "p5_found",
    """
WITH r AS (
  SELECT nullif(replace(upper(trim(ticker, ' ' || chr(9))), '-', '.'), '') AS ticker,
         coalesce(valid_from, DATE '0001-01-01') AS a, coalesce(valid_to, DATE '9999-12-31') AS b FROM ticker_overrides),
ok AS (SELECT DISTINCT * FROM r WHERE ticker IS NOT NULL AND a <= b),
m AS (SELECT *, CASE WHEN date_diff('day', max(b) OVER (PARTITION BY ticker ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a) <= 1
                     THEN 0 ELSE 1 END AS is_new FROM ok),
g AS (SELECT *, sum(is_new) OVER (PARTITION BY ticker ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM m),
p AS (SELECT ticker, min(a) AS a, max(b) AS b FROM g GROUP BY ticker, run),
n AS (SELECT *, lead(a) OVER (PARTITION BY ticker ORDER BY a) AS nxt FROM p)
SELECT ticker, 'period' AS kind, a::VARCHAR AS day_from, b::VARCHAR AS day_to FROM n
UNION ALL
SELECT ticker, 'gap', (b + 1)::VARCHAR, (nxt - 1)::VARCHAR FROM n WHERE nxt IS NOT NULL""",
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(pin(spark), sf_dir, "ticker_overrides").select(normal.ticker(F.col("ticker")).alias("ticker"), "valid_from", "valid_to")
    out = intervals.periods_and_gaps(o, keys=["ticker"], valid_from="valid_from", valid_to="valid_to")
    return out.select("ticker", "kind", F.col("day_from").cast("string").alias("day_from"), F.col("day_to").cast("string").alias("day_to"))


@catalog.query("p7_found", timestamp_sql.sql())
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = load(pin(spark), sf_dir, "filings_raw").select("raw_id", "feed", "acceptance_datetime")
    feeds = load(spark, sf_dir, "feeds")
    at = timestamps.parse_timestamp(F.col("acceptance_datetime"), F.col("tz_name"), F.col("day_first"))
    instants = (
        raw.join(feeds, "feed", "left").withColumn("at", at).where("at.has_time AND at.instant_us IS NOT NULL")
        .select(F.lit("filings_raw").alias("src"), F.col("raw_id").alias("record_id"), timestamps.iso_utc(F.col("at.instant_us")).alias("norm"))
    )
    months = load(spark, sf_dir, "backtest_llm_change_monthly").select("row_id", "rebalance_date")
    day = F.when(F.col("at.zoned"), normal.day_in_zone(F.timestamp_micros("at.instant_us"))).otherwise(F.date_from_unix_date("at.wall_day"))
    days = (
        months.withColumn("at", timestamps.parse_timestamp(F.col("rebalance_date"))).withColumn("day", day).where("day IS NOT NULL")
        .select(F.lit("backtest_llm_change_monthly").alias("src"), F.col("row_id").alias("record_id"), F.col("day").cast("string").alias("norm"))
    )
    return instants.unionByName(days).distinct()


@catalog.query(
    "p6_found",
    """
WITH e AS (SELECT DISTINCT accession, cik, (acceptance_datetime AT TIME ZONE 'America/New_York')::DATE AS day
           FROM filings WHERE acceptance_datetime IS NOT NULL),
o AS (SELECT DISTINCT nullif(replace(upper(trim(ticker, ' ' || chr(9))), '-', '.'), '') AS ticker, cik,
             coalesce(valid_from, DATE '0001-01-01') AS a, coalesce(valid_to, DATE '9999-12-31') AS b FROM ticker_overrides),
m AS (SELECT DISTINCT snapshot_date, nullif(replace(upper(trim(ticker, ' ' || chr(9))), '-', '.'), '') AS ticker
      FROM membership WHERE snapshot_date IS NOT NULL),
cal AS (SELECT snapshot_date, lead(snapshot_date) OVER (ORDER BY snapshot_date) AS nxt FROM (SELECT DISTINCT snapshot_date FROM m))
SELECT DISTINCT e.accession, e.cik, o.ticker, cal.snapshot_date::VARCHAR AS snapshot_date
FROM e JOIN o ON o.cik = e.cik AND e.day BETWEEN o.a AND o.b
JOIN cal ON e.day >= cal.snapshot_date AND (cal.nxt IS NULL OR e.day < cal.nxt)
JOIN m ON m.snapshot_date = cal.snapshot_date AND m.ticker = o.ticker""",
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    filings = load(pin(spark), sf_dir, "filings").where("acceptance_datetime IS NOT NULL AND cik IS NOT NULL")
    events = stage(filings.select("accession", "cik", normal.day_in_zone(F.col("acceptance_datetime")).alias("day")).distinct(), "p6-events")
    overrides = load(spark, sf_dir, "ticker_overrides").select("cik", normal.ticker(F.col("ticker")).alias("ticker"), "valid_from", "valid_to")
    listed = members(spark, sf_dir)
    runs = snapshots.version_history(listed, date="snapshot_date", entity="ticker", payload=[], open_end=normal.MAX_DAY)
    both = eventtime.periods_of_both(overrides, runs, entity="cik", member="ticker", valid_from="valid_from", valid_to="valid_to", run_from="valid_from", run_to="valid_to")
    known = eventtime.valid_keys(events, stage(both, "p6-periods"), entity="cik", member="ticker", event_time="day", slice_days=SLICE_DAYS)
    snapshot_of_day = pit.in_force(events, listed, day="day", date="snapshot_date")
    return known.join(snapshot_of_day, "day").select("accession", "cik", "ticker", F.col("snapshot_date").cast("string").alias("snapshot_date")).distinct()


@catalog.query("p2_pruning")
def p2_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of the leaves the digests let p2 pass over, for every snapshot after the first."""
    out = snapshots.pruned_share(members(pin(spark), sf_dir), date="snapshot_date", entity="ticker", payload=["sector", "size_band"])
    return out.select(F.col("snapshot_date").cast("string").alias("snapshot_date"), "leaves", "differing", F.round("pruned_share", 6).alias("pruned_share"))
