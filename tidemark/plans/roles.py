"""The tables that the named queries run on, each as a DataFrame and as the same CTE in SQL.

The collection has no price table; ``lineitem`` stands in for one (symbol = supplier, price = the
mean unit price of a day or month, days moved 20 years ahead to meet the filings).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import normal
from tidemark.session import pin
from tidemark.sources.tables import load

SHIFT_DAYS = 7305  # 20 years
TICKER_SQL = "nullif(replace(upper(trim(ticker, ' ' || chr(9))), '-', '.'), '')"
NY_SQL = "(({}) AT TIME ZONE 'America/New_York')"

SQL = {
    "filings": """filings_r AS (
  SELECT accession, cik, min(acceptance_datetime) AS t, min(date_filed) AS date_filed, min(form_type) AS form_type, min(company) AS company
  FROM filings WHERE accession IS NOT NULL AND cik IS NOT NULL GROUP BY accession, cik)""",
    "signals": """signals_r AS (
  SELECT signal_id, min(accession) AS accession, min(cik) AS cik, min(known_at) AS known_at, min(tone) AS tone, min(hedging) AS hedging, min(risk_severity) AS risk_severity,
         min(llm_change) AS score FROM signals WHERE signal_id IS NOT NULL GROUP BY signal_id)""",
    "members": f"""members_r AS (SELECT DISTINCT snapshot_date, {TICKER_SQL} AS ticker FROM membership WHERE snapshot_date IS NOT NULL)""",
    "calendar": """cal_r AS (
  SELECT snapshot_date, lead(snapshot_date) OVER (ORDER BY snapshot_date) AS next_date FROM (SELECT DISTINCT snapshot_date FROM members_r))""",
    "ranges": f"""ranges_r AS (
  SELECT DISTINCT {TICKER_SQL} AS ticker, cik, valid_from, valid_to, nullif(upper(trim(yahoo_symbol)), '') AS yahoo_symbol FROM ticker_overrides
  WHERE {TICKER_SQL} IS NOT NULL AND cik IS NOT NULL)""",
    "daily": f"""daily_r AS (
  SELECT l_suppkey AS symbol, (l_shipdate::DATE + {SHIFT_DAYS}) AS date, avg(l_extendedprice / l_quantity) AS adj_close
  FROM lineitem WHERE l_quantity > 0 GROUP BY ALL)""",
    "monthly": f"""monthly_r AS (
  SELECT l_suppkey AS symbol, last_day(l_shipdate::DATE + {SHIFT_DAYS}) AS date, avg(l_extendedprice / l_quantity) AS adj_close
  FROM lineitem WHERE l_quantity > 0 GROUP BY ALL)""",
}


def ctes(*names: str) -> str:
    return ",\n".join(SQL[n] for n in names)


def filings(spark: SparkSession, d: str) -> DataFrame:
    """One row per (accession, cik): earliest acceptance, smallest spelling."""
    f = load(pin(spark), d, "filings").where("accession IS NOT NULL AND cik IS NOT NULL")
    return f.groupBy("accession", "cik").agg(
        F.min("acceptance_datetime").alias("t"), F.min("date_filed").alias("date_filed"), F.min("form_type").alias("form_type"), F.min("company").alias("company")
    )


def signals(spark: SparkSession, d: str) -> DataFrame:
    s = load(pin(spark), d, "signals").where("signal_id IS NOT NULL")
    cols = ["accession", "cik", "known_at", "tone", "hedging", "risk_severity"]
    return s.groupBy("signal_id").agg(*[F.min(c).alias(c) for c in cols], F.min("llm_change").alias("score"))


def members(spark: SparkSession, d: str) -> DataFrame:
    m = load(pin(spark), d, "membership").where("snapshot_date IS NOT NULL")
    return m.select("snapshot_date", normal.ticker(F.col("ticker")).alias("ticker")).distinct()


def ranges(spark: SparkSession, d: str) -> DataFrame:
    o = load(pin(spark), d, "ticker_overrides")
    yahoo = F.nullif(F.upper(F.btrim("yahoo_symbol")), F.lit(""))
    out = o.select(normal.ticker(F.col("ticker")).alias("ticker"), "cik", "valid_from", "valid_to", yahoo.alias("yahoo_symbol"))
    return out.where("ticker IS NOT NULL AND cik IS NOT NULL").distinct()


def _prices(spark: SparkSession, d: str, monthly: bool) -> DataFrame:
    li = load(pin(spark), d, "lineitem").where("l_quantity > 0")
    day = F.date_add(F.to_date("l_shipdate"), SHIFT_DAYS)
    return li.groupBy(F.col("l_suppkey").alias("symbol"), (F.last_day(day) if monthly else day).alias("date")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("adj_close"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    return _prices(spark, d, False)


def monthly(spark: SparkSession, d: str) -> DataFrame:
    return _prices(spark, d, True)


def min_stocks(spark: SparkSession, d: str) -> int:
    """A portfolio needs a tenth of the suppliers, five at least."""
    return max(5, load(spark, d, "supplier").count() // 10)


MIN_STOCKS_SQL = "(SELECT greatest(5, count(*) // 10) FROM supplier)"
