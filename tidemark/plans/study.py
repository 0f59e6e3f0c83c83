"""Event-study queries: prices, returns, panels, portfolios, performance, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.catalog import Catalog
from tidemark.config import DEFAULTS
from tidemark.functions import normal
from tidemark.operators import asof, pit, portfolio, ranking
from tidemark.plans import lookups, roles
from tidemark.sources.tables import load

catalog = Catalog()
HORIZON, MAX_LAG, MAX_AGE, Q, COST_BP = 21, 7, 365, 5, 10.0


@catalog.query(
    "event_day_eastern",
    f"""WITH {roles.ctes('filings')} SELECT accession, cik, {roles.NY_SQL.format('t')}::DATE::VARCHAR AS eastern_day, year({roles.NY_SQL.format('t')})::INT AS eastern_year,
  epoch_us(({roles.NY_SQL.format('t')}::DATE + INTERVAL 16 HOUR) AT TIME ZONE 'America/New_York') AS close_us FROM filings_r WHERE t IS NOT NULL""",
)
def event_day_eastern(spark: SparkSession, d: str) -> DataFrame:
    """Calendar day and year in New York of an instant, and that day's 16:00 close as an instant."""
    f = roles.filings(spark, d).where("t IS NOT NULL").withColumn("day", normal.day_in_zone(F.col("t")))
    close = F.to_utc_timestamp(F.col("day").cast("timestamp") + F.expr("INTERVAL 16 HOURS"), normal.NEW_YORK)
    return f.select("accession", "cik", F.col("day").cast("string").alias("eastern_day"), F.year("day").alias("eastern_year"), F.unix_micros(close).alias("close_us"))


def events(spark: SparkSession, d: str) -> DataFrame:
    f = roles.filings(spark, d).where("t IS NOT NULL").withColumn("known_day", normal.day_in_zone(F.col("t")))
    return lookups.with_symbol(f.select("accession", "cik", "known_day"), spark, d)


_EVENTS_SQL = f"""events_r AS (SELECT accession, cik, {roles.NY_SQL.format('t')}::DATE AS known_day, cik % (SELECT count(*) FROM supplier) + 1 AS symbol FROM filings_r WHERE t IS NOT NULL),
series AS (SELECT symbol, date, adj_close, lead(date, {HORIZON}) OVER w AS exit_date, lead(adj_close, {HORIZON}) OVER w AS exit_close FROM daily_r WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


@catalog.query(
    "forward_returns",
    f"""WITH {roles.ctes('filings', 'daily')}, {_EVENTS_SQL},
j AS (SELECT e.*, s.date AS d, s.adj_close, s.exit_date AS x, s.exit_close FROM events_r e ASOF LEFT JOIN series s ON e.symbol = s.symbol AND e.known_day < s.date)
SELECT accession, cik, symbol, CASE WHEN d - known_day <= {MAX_LAG} THEN d::VARCHAR END AS entry_date, CASE WHEN d - known_day <= {MAX_LAG} THEN x::VARCHAR END AS exit_date,
  CASE WHEN d - known_day <= {MAX_LAG} THEN round(exit_close / adj_close - 1, 6) END AS fwd_return FROM j""",
)
def forward_returns(spark: SparkSession, d: str) -> DataFrame:
    """Return over so many rows of the symbol's own series, entered on its first day after the event."""
    series = portfolio.row_horizon(roles.daily(spark, d), HORIZON).withColumn("entry", F.col("date"))
    hit = asof.asof_join(
        events(spark, d), series, keys=["symbol"], left_time="known_day", right_time="date", values=["entry", "adj_close", "exit_date", "exit_close"],
        direction="forward", exact=False, slice_width=1024,
    )
    ok = F.datediff("entry", "known_day") <= MAX_LAG
    return hit.select(
        "accession", "cik", "symbol", F.when(ok, F.col("entry").cast("string")).alias("entry_date"), F.when(ok, F.col("exit_date").cast("string")).alias("exit_date"),
        F.when(ok, F.round(F.col("exit_close") / F.col("adj_close") - 1, 6)).alias("fwd_return"),
    )


@catalog.query(
    "lookahead_violations",
    f"""WITH {roles.ctes('filings', 'daily')}, {_EVENTS_SQL},
j AS (SELECT e.*, s.date AS d FROM events_r e ASOF JOIN series s ON e.symbol = s.symbol AND e.known_day < s.date)
SELECT count(*) AS n_entries, count(*) FILTER (WHERE d <= known_day)::BIGINT AS n_violations FROM j WHERE d - known_day <= {MAX_LAG}""",
)
def lookahead_violations(spark: SparkSession, d: str) -> DataFrame:
    """The invariant that no entry lies on or before the day of the event; must count none."""
    known = events(spark, d).select("accession", "cik", "known_day")
    entries = forward_returns(spark, d).where("entry_date IS NOT NULL").join(known, ["accession", "cik"])
    return entries.agg(F.count(F.lit(1)).alias("n_entries"), F.count(F.when(F.col("entry_date").cast("date") <= F.col("known_day"), 1)).alias("n_violations"))


REBALANCE_SQL = """rebal AS (SELECT date, lead(date) OVER (ORDER BY date) AS next_date FROM (SELECT max(date) AS date FROM {p} GROUP BY date_trunc('month', date)))"""


@catalog.query(
    "rebalance_dates",
    f"""WITH {roles.ctes('daily')}, m AS (SELECT max(date) AS date FROM daily_r GROUP BY date_trunc('month', date)),
k AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM m)
SELECT date::VARCHAR AS date, (lead(date) OVER (ORDER BY date))::VARCHAR AS next_date, last_day((last_day(date) + INTERVAL 3 MONTH)::DATE)::VARCHAR AS held_to FROM k WHERE i % 3 = 0""",
)
def rebalance_dates(spark: SparkSession, d: str) -> DataFrame:
    """Last day of every third month in the calendar and the month-end its holding period runs to."""
    r = portfolio.rebalance_dates(roles.daily(spark, d), every=3)
    return r.select(F.col("date").cast("string").alias("date"), F.col("next_date").cast("string").alias("next_date"), F.last_day(F.add_months(F.last_day("date"), 3)).cast("string").alias("held_to"))


_RETURNS_SQL = f"""{REBALANCE_SQL.format(p='monthly_r')},
spans AS (SELECT date AS t, next_date AS t1 FROM rebal WHERE next_date IS NOT NULL),
ends AS (SELECT t, symbol, arg_max(adj_close, date) AS p1 FROM monthly_r JOIN spans ON date > t AND date <= t1 GROUP BY t, symbol),
returns_r AS (SELECT m.date, m.symbol, coalesce(p1 / m.adj_close - 1, 0.0) AS ret FROM monthly_r m JOIN spans ON m.date = t LEFT JOIN ends e ON e.t = m.date AND e.symbol = m.symbol)"""


def monthly_returns(spark: SparkSession, d: str) -> DataFrame:
    m = roles.monthly(spark, d)
    return portfolio.period_returns(m, portfolio.rebalance_dates(m))


@catalog.query("period_returns", f"WITH {roles.ctes('monthly')}, {_RETURNS_SQL} SELECT date::VARCHAR AS date, symbol, round(ret, 6) AS ret FROM returns_r")
def period_returns(spark: SparkSession, d: str) -> DataFrame:
    return monthly_returns(spark, d).select(F.col("date").cast("string").alias("date"), "symbol", F.round("ret", 6).alias("ret"))


_SIGNALS_SQL = f"""known_r AS (SELECT cik, known_at, {roles.NY_SQL.format('known_at')}::DATE AS known_day, score FROM signals_r WHERE score IS NOT NULL AND known_at IS NOT NULL AND cik IS NOT NULL),
latest AS (SELECT cik, known_day, arg_max(score, (known_at, score)) AS score FROM known_r GROUP BY cik, known_day),
asked_c AS (SELECT date AS t, cik FROM (SELECT date FROM rebal WHERE next_date IS NOT NULL) CROSS JOIN (SELECT DISTINCT cik FROM known_r)),
asof_r AS (SELECT a.t, a.cik, l.known_day, l.score FROM asked_c a ASOF JOIN latest l ON a.cik = l.cik AND a.t > l.known_day WHERE a.t - l.known_day <= {MAX_AGE})"""


def signals_on(dates: DataFrame, signals: DataFrame) -> DataFrame:
    """(date, cik, known_day, score): each company's latest signal strictly before each date, at most
    a year old.  A signal meets only the dates of its own next year, never all of them."""
    s = signals.where("score IS NOT NULL AND known_at IS NOT NULL AND cik IS NOT NULL").withColumn("known_day", normal.day_in_zone(F.col("known_at")))
    daily = s.groupBy("cik", "known_day").agg(F.max(F.struct("known_at", "score")).alias("m")).select("cik", "known_day", F.col("m.score").alias("score"))
    span = W.partitionBy("cik").orderBy("known_day")
    until = F.least(F.coalesce(F.lead("known_day").over(span), F.date_add("known_day", MAX_AGE)), F.date_add("known_day", MAX_AGE))
    held = daily.withColumn("until", until)
    months = F.sequence(F.trunc("known_day", "MM"), F.trunc("until", "MM"), F.expr("INTERVAL 1 MONTH"))
    reach = held.withColumn("_m", F.explode(months))
    on = (F.col("date") > F.col("known_day")) & (F.col("date") <= F.col("until"))
    return dates.select("date", F.trunc("date", "MM").alias("_m")).join(reach, "_m").where(on).select("date", "cik", "known_day", "score")


@catalog.query("signals_as_of", f"WITH {roles.ctes('monthly', 'signals')}, {_RETURNS_SQL}, {_SIGNALS_SQL} SELECT t::VARCHAR AS date, cik, known_day::VARCHAR AS known_day, round(score, 6) AS score FROM asof_r")
def signals_as_of(spark: SparkSession, d: str) -> DataFrame:
    dates = portfolio.rebalance_dates(roles.monthly(spark, d)).where("next_date IS NOT NULL")
    out = signals_on(dates, roles.signals(spark, d))
    return out.select(F.col("date").cast("string").alias("date"), "cik", F.col("known_day").cast("string").alias("known_day"), F.round("score", 6).alias("score"))


_PANEL_SQL = f"""{_RETURNS_SQL}, {_SIGNALS_SQL},
date_members AS (SELECT date AS day, ticker FROM rebal JOIN cal_r c ON date >= c.snapshot_date AND (c.next_date IS NULL OR date < c.next_date)
  JOIN members_r m ON m.snapshot_date = c.snapshot_date WHERE ticker IS NOT NULL AND rebal.next_date IS NOT NULL),
{lookups.VALID_SQL.format(out='held', asked='date_members')},
priced AS (SELECT h.day AS date, h.cik, h.ticker, r.symbol, r.ret FROM held h JOIN returns_r r ON r.date = h.day AND r.symbol = h.cik % (SELECT count(*) FROM supplier) + 1),
panel_r AS (SELECT p.*, a.score FROM priced p JOIN asof_r a ON a.t = p.date AND a.cik = p.cik QUALIFY row_number() OVER (PARTITION BY p.date, p.cik ORDER BY p.ticker) = 1)"""
_PANEL_CTES = f"{roles.ctes('monthly', 'signals', 'members', 'calendar', 'ranges')}, {_PANEL_SQL}"


def panel(spark: SparkSession, d: str, every: int = 1) -> DataFrame:
    """(date, cik, ticker, symbol, score, ret): members of the day with a signal known before it and
    a price on it; of several share classes the first ticker priced.  ``every`` so many months."""
    m = roles.monthly(spark, d)
    rebalanced = portfolio.rebalance_dates(m, every=every)
    dates = rebalanced.where("next_date IS NOT NULL")
    on_day = pit.members_as_of(dates.select(F.col("date").alias("day")), roles.members(spark, d), day="day", date="snapshot_date", member="ticker").select("day", "ticker")
    held = lookups.with_symbol(lookups.resolved(on_day, spark, d).where("cik IS NOT NULL"), spark, d).withColumnRenamed("day", "date")
    priced = held.join(portfolio.period_returns(m, rebalanced), ["date", "symbol"])
    scored = priced.join(signals_on(dates, roles.signals(spark, d)).select("date", "cik", "score"), ["date", "cik"])
    return pit.first_of(scored, ["date", "cik"], ["ticker"]).select("date", "cik", "ticker", "symbol", "score", "ret")


@catalog.query("backtest_panel", f"WITH {_PANEL_CTES} SELECT date::VARCHAR AS date, cik, ticker, symbol, round(score, 6) AS score, round(ret, 6) AS ret FROM panel_r")
def backtest_panel(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select(F.col("date").cast("string").alias("date"), "cik", "ticker", "symbol", F.round("score", 6).alias("score"), F.round("ret", 6).alias("ret"))


def _legs_sql(size: bool = False, name: str = "legs", source: str = "panel_r") -> str:
    ok = "score IS NOT NULL AND ret IS NOT NULL" + (" AND size > 0" if size else "")
    return f"""{name}_n AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY score, ticker, cik) AS r FROM {source} WHERE {ok}),
{name} AS (SELECT *, greatest(1, ((r - 1) * {Q} + n - 2) // (n - 1))::INT AS q FROM {name}_n WHERE n >= {roles.MIN_STOCKS_SQL})"""


@catalog.query("quantile_buckets", f"WITH {_PANEL_CTES}, {_legs_sql()} SELECT date::VARCHAR AS date, q, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(ret), 6) AS mean_ret FROM legs GROUP BY date, q")
def quantile_buckets(spark: SparkSession, d: str) -> DataFrame:
    legs = portfolio.legs(panel(spark, d), Q, roles.min_stocks(spark, d))
    out = legs.groupBy("date", "q").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("ret"), 6).alias("mean_ret"))
    return out.withColumn("date", F.col("date").cast("string"))


def _long_short_sql(size: bool = False, name: str = "monthly_ls", cost: str = str(COST_BP), legs: str = "legs") -> str:
    base = "size" if size else "1.0"
    x = name
    return f"""{x}_p AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM {legs})),
{x}_h AS (SELECT date, i, cik, ret, CASE WHEN q = {Q} THEN 1 ELSE -1 END AS leg, {base} / sum({base}) OVER (PARTITION BY date, q) AS w FROM {legs} JOIN {x}_p USING (date) WHERE q IN (1, {Q})),
{x}_d AS (SELECT i + 1 AS i, leg, cik, w * (1 + ret) / sum(w * (1 + ret)) OVER (PARTITION BY i, leg) AS wp FROM {x}_h),
{x}_t AS (SELECT i, sum(abs(coalesce(w, 0) - coalesce(wp, 0))) AS traded FROM {x}_h FULL JOIN {x}_d USING (i, leg, cik) WHERE i <= (SELECT max(i) FROM {x}_p) GROUP BY i),
{x}_r AS (SELECT date, i, sum(w * ret) FILTER (WHERE leg = 1) AS ret_long, sum(w * ret) FILTER (WHERE leg = -1) AS ret_short, count(*) FILTER (WHERE leg = 1) AS n_long, count(*) FILTER (WHERE leg = -1) AS n_short FROM {x}_h GROUP BY date, i),
{x}_q AS (SELECT date, any_value(n) AS n_stocks, {', '.join(f'avg(ret) FILTER (WHERE q = {k}) AS ret_q{k}' for k in range(1, Q + 1))} FROM {legs} GROUP BY date),
{x}_k AS (SELECT date, score, ret, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY date ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2 AS ry FROM {legs}),
{x}_i AS (SELECT date, CASE WHEN min(score) < max(score) AND min(ret) < max(ret) THEN corr(rx, ry) END AS ic FROM {x}_k GROUP BY date),
{x} AS (SELECT date, n_stocks, n_long, n_short, ret_long, ret_short, ret_long - ret_short AS ret_ls, traded / 4 AS turnover, traded * {cost} * 1e-4 AS cost, ic,
  ret_long - ret_short - traded * {cost} * 1e-4 AS ret_ls_net, {', '.join(f'ret_q{k}' for k in range(1, Q + 1))} FROM {x}_r JOIN {x}_t USING (i) JOIN {x}_q USING (date) JOIN {x}_i USING (date))"""


_RATES = ["ret_long", "ret_short", "ret_ls", "turnover", "cost", "ic", "ret_ls_net", *[f"ret_q{k}" for k in range(1, Q + 1)]]
_MONTHLY_OUT = "date::VARCHAR AS date, n_stocks, n_long, n_short, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _RATES)


def _rounded(monthly: DataFrame) -> DataFrame:
    return monthly.select(F.col("date").cast("string").alias("date"), "n_stocks", "n_long", "n_short", *[(F.round(c, 6) + 0.0).alias(c) for c in _RATES])


def monthly(spark: SparkSession, d: str, **kw: object) -> DataFrame:
    return portfolio.long_short(panel(spark, d), q=Q, min_stocks=roles.min_stocks(spark, d), **{"cost_bp": COST_BP, **kw})


@catalog.query("long_short_monthly", f"WITH {_PANEL_CTES}, {_legs_sql()}, {_long_short_sql()} SELECT {_MONTHLY_OUT} FROM monthly_ls")
def long_short_monthly(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(monthly(spark, d))


_SIZED = "sized AS (SELECT p.*, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS size FROM panel_r p LEFT JOIN supplier ON s_suppkey = symbol)"


def sized_panel(spark: SparkSession, d: str) -> DataFrame:
    sup = load(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("size"))
    return panel(spark, d).join(sup, "symbol", "left")


@catalog.query("long_short_value_weighted", f"WITH {_PANEL_CTES}, {_SIZED}, {_legs_sql(True, source='sized')}, {_long_short_sql(True)} SELECT {_MONTHLY_OUT} FROM monthly_ls")
def long_short_value_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(portfolio.long_short(sized_panel(spark, d), q=Q, min_stocks=roles.min_stocks(spark, d), cost_bp=COST_BP, size="size"))


_SUMMARY_SQL = """path AS (SELECT *, product(1 + ret_ls_net) OVER (ORDER BY date) AS growth, row_number() OVER (ORDER BY date) AS rn FROM monthly_ls),
dd AS (SELECT *, growth / max(growth) OVER (ORDER BY date) - 1 AS drawdown FROM path)
SELECT count(*) AS periods, round(avg(n_stocks), 6) AS avg_stocks, round(avg(ic), 6) AS mean_ic, round(CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) END, 6) AS ic_t,
  round(avg((ic > 0)::INT), 6) AS share_ic_positive, round(avg(ret_ls) * 12, 6) AS annual_return_gross, round(stddev_samp(ret_ls) * sqrt(12), 6) AS annual_vol_gross,
  round(CASE WHEN stddev_samp(ret_ls) > 0 THEN avg(ret_ls) / stddev_samp(ret_ls) * sqrt(12) END, 6) AS sharpe_gross, round(avg(ret_ls_net) * 12, 6) AS annual_return_net,
  round(CASE WHEN stddev_samp(ret_ls_net) > 0 THEN avg(ret_ls_net) / stddev_samp(ret_ls_net) * sqrt(12) END, 6) AS sharpe_net, round(avg(turnover) FILTER (WHERE rn > 1), 6) AS avg_turnover,
  round(min(drawdown), 6) AS max_drawdown_net, """ + ", ".join(f"round(avg(ret_q{k}), 6) AS mean_q{k}" for k in range(1, Q + 1)) + " FROM dd"


@catalog.query("performance_summary", f"WITH {_PANEL_CTES}, {_legs_sql()}, {_long_short_sql()}, {_SUMMARY_SQL}")
def performance_summary(spark: SparkSession, d: str) -> DataFrame:
    s = portfolio.summarize(monthly(spark, d), q=Q)
    return s.select("periods", *[F.round(c, 6).alias(c) for c in s.columns if c != "periods"])


@catalog.query(
    "growth_path",
    f"""WITH {_PANEL_CTES}, {_legs_sql()}, {_long_short_sql()}
SELECT date::VARCHAR AS date, round(product(1 + ret_ls_net) OVER (ORDER BY date), 6) AS growth, round(1.96 / sqrt(n_stocks), 6) AS ic_band FROM monthly_ls
UNION ALL SELECT (min(date) - 1)::VARCHAR, 1.0, NULL FROM monthly_ls HAVING count(*) > 0""",
)
def growth_path(spark: SparkSession, d: str) -> DataFrame:
    """Chart data: cumulative growth with its leading 1.0 and the band of an uncorrelated IC."""
    m = monthly(spark, d)
    path = portfolio.growth(m, "ret_ls_net").select("date", F.round("growth", 6).alias("growth"), F.round(1.96 / F.sqrt("n_stocks"), 6).alias("ic_band"))
    seed = m.agg(F.date_sub(F.min("date"), 1).alias("date")).where("date IS NOT NULL").select("date", F.lit(1.0).alias("growth"), F.lit(None).cast("double").alias("ic_band"))
    return path.unionByName(seed).withColumn("date", F.col("date").cast("string"))


_GRID = [("base", COST_BP, None, None), ("cost_0", 0.0, None, None), ("cost_25", 25.0, None, None), ("early", COST_BP, None, "2017-12-31"), ("late", COST_BP, "2018-01-01", None)]
_GRID_SQL = ", ".join(f"('{n}', {c}, DATE '{a or '0001-01-01'}', DATE '{b or '9999-12-31'}')" for n, c, a, b in _GRID)
HELD = 3  # months of the longer horizon
_HELD_CTES = _PANEL_CTES.replace(REBALANCE_SQL.format(p="monthly_r"), REBALANCE_SQL.format(p="monthly_r").replace(
    "FROM (SELECT max(date)", f"FROM (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT max(date)").replace("GROUP BY date_trunc('month', date))", f"GROUP BY date_trunc('month', date))) WHERE i % {HELD} = 0)"))
_GRID_CTES = f"""base_m AS (WITH {_PANEL_CTES}, {_legs_sql()}, {_long_short_sql()} SELECT * FROM monthly_ls),
sized_m AS (WITH {_PANEL_CTES}, {_SIZED}, {_legs_sql(True, source='sized')}, {_long_short_sql(True)} SELECT * FROM monthly_ls),
held_m AS (WITH {_HELD_CTES}, {_legs_sql()}, {_long_short_sql()} SELECT * FROM monthly_ls),
grid(variant, bp, a, b) AS (VALUES {_GRID_SQL}),
v AS (SELECT variant, 12 AS per_year, ic, ret_ls - turnover * 4 * bp * 1e-4 AS net FROM base_m JOIN grid ON date BETWEEN a AND b
  UNION ALL SELECT 'value_weighted', 12, ic, ret_ls_net FROM sized_m UNION ALL SELECT 'horizon_{HELD}m', {12 // HELD}, ic, ret_ls_net FROM held_m),
g AS (SELECT variant, any_value(per_year) AS per_year, count(*) AS periods, avg(ic) AS mean_ic, CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) END AS ic_t,
  CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) END AS sr, avg(net) AS mu FROM v GROUP BY variant)"""


def robustness(spark: SparkSession, d: str) -> DataFrame:
    """(variant, per_year, ic, net): every period of the base run under other costs and spans, of the
    value-weighted run, and of the run whose periods last three months."""
    day = lambda x: F.lit(x).cast("date")
    grid = [F.struct(F.lit(n).alias("variant"), F.lit(c).alias("bp"), day(a or normal.MIN_DAY).alias("a"), day(b or normal.MAX_DAY).alias("b")) for n, c, a, b in _GRID]
    net = F.col("ret_ls") - F.col("turnover") * 4 * F.col("bp") * 1e-4
    base = monthly(spark, d).select("*", F.inline(F.array(*grid))).where("date BETWEEN a AND b").select("variant", F.lit(12).alias("per_year"), "ic", net.alias("net"))
    stocks = roles.min_stocks(spark, d)
    sized = portfolio.long_short(sized_panel(spark, d), q=Q, min_stocks=stocks, cost_bp=COST_BP, size="size").select(F.lit("value_weighted").alias("variant"), F.lit(12).alias("per_year"), "ic", F.col("ret_ls_net").alias("net"))
    held = portfolio.long_short(panel(spark, d, HELD), q=Q, min_stocks=stocks, cost_bp=COST_BP).select(F.lit(f"horizon_{HELD}m").alias("variant"), F.lit(12 // HELD).alias("per_year"), "ic", F.col("ret_ls_net").alias("net"))
    return base.unionByName(sized).unionByName(held)


@catalog.query("variant_grid", f"WITH {_GRID_CTES} SELECT variant, periods, round(mean_ic, 6) AS mean_ic, round(ic_t, 6) AS ic_t, round(sr * sqrt(per_year), 6) AS sharpe_net FROM g")
def variant_grid(spark: SparkSession, d: str) -> DataFrame:
    """Costs, spans, weights and horizon as variants: periods, IC with its t, and the net Sharpe ratio a year."""
    sharpe = F.when(F.stddev_samp("net") > 0, F.avg("net") / F.stddev_samp("net") * F.sqrt(F.max("per_year")))
    ic_t = portfolio.t_stat(F.avg("ic"), F.stddev_samp("ic"), F.count("ic"))
    return robustness(spark, d).groupBy("variant").agg(F.count(F.lit(1)).alias("periods"), F.round(F.avg("ic"), 6).alias("mean_ic"), F.round(ic_t, 6).alias("ic_t"), F.round(sharpe, 6).alias("sharpe_net"))


@catalog.query(
    "variant_verdicts",
    f"""WITH {_GRID_CTES} SELECT variant, coalesce(round(mean_ic, 6) > 0.02 AND ic_t > 2, false) AS clears_ic, coalesce(sr * sqrt(per_year) > 0.5, false) AS clears_sharpe,
  CASE WHEN ic_t > 2 THEN 'significant' WHEN sr * sqrt(per_year) > 0.5 THEN 'sharpe_without_ic' ELSE 'none' END AS reading FROM g""",
)
def variant_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Which bars a variant clears, and how to read it: bars on IC, its t and the net Sharpe ratio."""
    g, bars = variant_grid(spark, d), DEFAULTS["bars"]
    sharpe, ic_t = F.col("sharpe_net") > bars["sharpe_net"], F.col("ic_t") > bars["ic_t"]
    return g.select(
        "variant", F.coalesce((F.col("mean_ic") > bars["ic"]) & ic_t, F.lit(False)).alias("clears_ic"), F.coalesce(sharpe, F.lit(False)).alias("clears_sharpe"),
        F.when(ic_t, "significant").when(sharpe, "sharpe_without_ic").otherwise("none").alias("reading"),
    )


def _ic_sql(score: str, source: str) -> str:
    return f"""k AS (SELECT date, {score} AS s, ret, rank() OVER (PARTITION BY date ORDER BY {score}) + (count(*) OVER (PARTITION BY date, {score}) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY date ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2 AS ry FROM {source}),
i AS (SELECT date, count(*) AS n, CASE WHEN min(s) < max(s) AND min(ret) < max(ret) THEN corr(rx, ry) END AS ic FROM k GROUP BY date)"""


@catalog.query("monthly_ic", f"WITH {_PANEL_CTES}, {_ic_sql('score', 'panel_r')} SELECT date::VARCHAR AS date, n, round(ic, 6) + 0.0 AS ic FROM i")
def monthly_ic(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.rank_correlation(panel(spark, d), ["date"], "score", "ret")
    return out.select(F.col("date").cast("string").alias("date"), "n", (F.round("ic", 6) + 0.0).alias("ic"))


@catalog.query(
    "planted_sanity",
    f"""WITH {_PANEL_CTES}, planted AS (SELECT * REPLACE (ret AS score) FROM panel_r), {_legs_sql(source='planted')}, {_long_short_sql()},
s AS (SELECT count(ic) AS periods, round(avg(ic), 6) AS mean_ic, round(avg(ret_ls) / stddev_samp(ret_ls) * sqrt(12), 6) AS sharpe_gross, round(avg(ret_ls) * 12, 6) AS annual_return_gross FROM monthly_ls)
SELECT *, mean_ic > 0.5 AND sharpe_gross > 3 AS passed FROM s""",
)
def planted_sanity(spark: SparkSession, d: str) -> DataFrame:
    """A score that is the next return itself must look spectacular: correlation, Sharpe ratio and the gate on both."""
    run = portfolio.long_short(panel(spark, d).withColumn("score", F.col("ret")), q=Q, min_stocks=roles.min_stocks(spark, d), cost_bp=COST_BP)
    sharpe = F.when(F.stddev_samp("ret_ls") > 0, F.avg("ret_ls") / F.stddev_samp("ret_ls") * 12**0.5)
    s = run.agg(F.count("ic").alias("periods"), F.round(F.avg("ic"), 6).alias("mean_ic"), F.round(sharpe, 6).alias("sharpe_gross"), F.round(F.avg("ret_ls") * 12, 6).alias("annual_return_gross"))
    return s.withColumn("passed", (F.col("mean_ic") > 0.5) & (F.col("sharpe_gross") > 3))


_NOISE_X = "('0x' || substr(sha256(draw::VARCHAR || ':' || cik::VARCHAR || ':' || date::VARCHAR), 1, 12))::BIGINT"


@catalog.query(
    "noise_sanity",
    f"""WITH {_PANEL_CTES}, draws AS (SELECT unnest(range(20)) AS draw), noisy AS (SELECT draw, p.date, p.ret, {_NOISE_X} AS s FROM panel_r p CROSS JOIN draws),
k AS (SELECT draw, date, s, ret, rank() OVER (PARTITION BY draw, date ORDER BY s) + (count(*) OVER (PARTITION BY draw, date, s) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY draw, date ORDER BY ret) + (count(*) OVER (PARTITION BY draw, date, ret) - 1) / 2 AS ry FROM noisy),
i AS (SELECT draw, date, CASE WHEN min(s) < max(s) AND min(ret) < max(ret) THEN corr(rx, ry) END AS ic FROM k GROUP BY draw, date),
t AS (SELECT draw, avg(ic) AS mean_ic, CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) END AS t FROM i GROUP BY draw)
SELECT count(*) AS draws, round(avg(mean_ic), 6) AS mean_ic, round(max(abs(mean_ic)), 6) AS max_abs_ic, round(stddev_pop(t), 6) AS sd_t, round(avg((abs(t) > 2)::INT), 6) AS share_large, abs(avg(mean_ic)) < 0.005 AS passed FROM t""",
)
def noise_sanity(spark: SparkSession, d: str) -> DataFrame:
    """Twenty hashed random scores: mean IC near zero, t about standard normal."""
    p = panel(spark, d).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(19))))
    h = F.sha2(F.concat_ws(":", "draw", "cik", F.col("date").cast("string")), 256)
    p = p.withColumn("score", F.conv(F.substring(h, 1, 12), 16, 10).cast("double"))
    ic = ranking.rank_correlation(p, ["draw", "date"], "score", "ret")
    t = ic.groupBy("draw").agg(F.avg("ic").alias("mean_ic"), portfolio.t_stat(F.avg("ic"), F.stddev_samp("ic"), F.count("ic")).alias("t"))
    return t.agg(
        F.count(F.lit(1)).alias("draws"), F.round(F.avg("mean_ic"), 6).alias("mean_ic"), F.round(F.max(F.abs("mean_ic")), 6).alias("max_abs_ic"),
        F.round(F.stddev_pop("t"), 6).alias("sd_t"), F.round(F.avg((F.abs("t") > 2).cast("int")), 6).alias("share_large"),
        (F.abs(F.avg("mean_ic")) < 0.005).alias("passed"),
    )


_COVER_SQL = f"""months AS (SELECT last_day(m::DATE) AS month FROM (SELECT unnest(generate_series(date_trunc('month', min(snapshot_date)), date_trunc('month', max(snapshot_date)), INTERVAL 1 MONTH)) AS m FROM members_r)),
month_members AS (SELECT month AS day, ticker FROM months JOIN cal_r c ON month >= c.snapshot_date AND (c.next_date IS NULL OR month < c.next_date)
  JOIN members_r m ON m.snapshot_date = c.snapshot_date WHERE ticker IS NOT NULL),
{lookups.VALID_SQL.format(out='held', asked='month_members')},
last_days AS (SELECT date_trunc('month', date) AS m, max(date) AS trading_day FROM daily_r GROUP BY 1),
cover_r AS (SELECT mm.day AS month, mm.ticker, h.cik, h.yahoo_symbol, p.symbol IS NOT NULL AS has_price,
  CASE WHEN h.cik IS NULL THEN 'no_cik' WHEN h.yahoo_symbol IS NULL THEN 'no_symbol' WHEN p.symbol IS NULL THEN 'no_price' END AS missing_reason
  FROM month_members mm LEFT JOIN held h ON h.day = mm.day AND h.ticker = mm.ticker LEFT JOIN last_days l ON l.m = date_trunc('month', mm.day)
  LEFT JOIN daily_r p ON p.symbol = h.cik % (SELECT count(*) FROM supplier) + 1 AND p.date = l.trading_day AND h.yahoo_symbol IS NOT NULL)"""
_COVER_CTES = f"{roles.ctes('daily', 'members', 'calendar', 'ranges')}, {_COVER_SQL}"


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """(month, ticker, cik, yahoo_symbol, has_price, missing_reason) of every member at every month-end;
    membership counts on the calendar month-end, prices on the last trading day of the month.  The
    months run from the first snapshot's to the last one's."""
    members = roles.members(spark, d)
    span = members.agg(F.trunc(F.min("snapshot_date"), "MM").alias("a"), F.trunc(F.max("snapshot_date"), "MM").alias("b")).where("a IS NOT NULL")
    months = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("m")).select(F.last_day("m").alias("day"))
    on_day = pit.members_as_of(months, members, day="day", date="snapshot_date", member="ticker").select("day", "ticker")
    daily = roles.daily(spark, d)
    trading = daily.groupBy(F.trunc("date", "MM").alias("_m")).agg(F.max("date").alias("date"))
    priced = daily.join(trading, "date").select("_m", "symbol", F.lit(True).alias("priced"))
    r = lookups.with_symbol(lookups.resolved(on_day, spark, d), spark, d).withColumn("_m", F.trunc("day", "MM"))
    r = r.join(priced, ["_m", "symbol"], "left").withColumn("has_price", F.col("priced").isNotNull() & F.col("yahoo_symbol").isNotNull())
    reason = F.when(F.col("cik").isNull(), "no_cik").when(F.col("yahoo_symbol").isNull(), "no_symbol").when(~F.col("has_price"), "no_price")
    return r.select(F.col("day").alias("month"), "ticker", "cik", "yahoo_symbol", "has_price", reason.alias("missing_reason"))


@catalog.query("coverage_panel", f"WITH {_COVER_CTES} SELECT month::VARCHAR AS month, ticker, cik, has_price, missing_reason FROM cover_r")
def coverage_panel(spark: SparkSession, d: str) -> DataFrame:
    return coverage(spark, d).select(F.col("month").cast("string").alias("month"), "ticker", "cik", "has_price", "missing_reason")


@catalog.query("coverage_by_year", f"WITH {_COVER_CTES} SELECT year(month)::INT AS year, count(*) AS n, round(avg(has_price::INT), 6) AS share FROM cover_r GROUP BY 1")
def coverage_by_year(spark: SparkSession, d: str) -> DataFrame:
    return coverage(spark, d).groupBy(F.year("month").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("has_price").cast("int")), 6).alias("share"))


_PERIODS = [("all", normal.MIN_DAY, normal.MAX_DAY), ("early", normal.MIN_DAY, "2015-12-31"), ("late", "2015-01-01", normal.MAX_DAY)]


@catalog.query(
    "coverage_summary",
    f"""WITH {_COVER_CTES}, periods(period, a, b) AS (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in _PERIODS)})
SELECT period, count(*) AS n, sum(has_price::INT)::BIGINT AS n_priced, round(avg(has_price::INT), 6) AS share, count(*) FILTER (WHERE missing_reason = 'no_cik') AS no_cik,
  count(*) FILTER (WHERE missing_reason = 'no_symbol') AS no_symbol, count(*) FILTER (WHERE missing_reason = 'no_price') AS no_price FROM cover_r JOIN periods ON month BETWEEN a AND b GROUP BY period""",
)
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping labelled periods, ends included."""
    periods = [F.struct(F.lit(n).alias("period"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, a, b in _PERIODS]
    c = coverage(spark, d).select("*", F.inline(F.array(*periods))).where("month BETWEEN a AND b")
    why = lambda r: F.count(F.when(F.col("missing_reason") == r, 1)).alias(r)
    priced = F.col("has_price").cast("int")
    return c.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.sum(priced).alias("n_priced"), F.round(F.avg(priced), 6).alias("share"), why("no_cik"), why("no_symbol"), why("no_price"))


@catalog.query(
    "missing_companies",
    f"""WITH {_COVER_CTES} SELECT ticker, cik, yahoo_symbol, missing_reason, count(*) AS n_months, min(month)::VARCHAR AS first_month, max(month)::VARCHAR AS last_month
FROM cover_r WHERE NOT has_price GROUP BY ticker, cik, yahoo_symbol, missing_reason""",
)
def missing_companies(spark: SparkSession, d: str) -> DataFrame:
    """Gaps grouped with null keys kept, the longest first."""
    gaps = coverage(spark, d).where("NOT has_price").groupBy("ticker", "cik", "yahoo_symbol", "missing_reason")
    out = gaps.agg(F.count(F.lit(1)).alias("n_months"), F.min("month").cast("string").alias("first_month"), F.max("month").cast("string").alias("last_month"))
    return out.orderBy(F.desc("n_months"), "ticker", "cik", "yahoo_symbol")


@catalog.query(
    "filing_ic",
    f"""WITH {roles.ctes('signals', 'daily')}, e AS (SELECT signal_id, cik % (SELECT count(*) FROM supplier) + 1 AS symbol, score, {roles.NY_SQL.format('known_at')}::DATE AS known_day FROM signals_r WHERE known_at IS NOT NULL AND score IS NOT NULL),
series AS (SELECT symbol, date, adj_close, lead(adj_close, {HORIZON}) OVER w AS exit_close FROM daily_r WINDOW w AS (PARTITION BY symbol ORDER BY date)),
j AS (SELECT year(known_day)::INT AS date, score, exit_close / s.adj_close - 1 AS ret FROM e ASOF JOIN series s ON e.symbol = s.symbol AND e.known_day < s.date WHERE s.date - known_day <= {MAX_LAG} AND exit_close IS NOT NULL),
{_ic_sql('score', 'j')} SELECT date AS year, n, round(ic, 6) + 0.0 AS ic, round(CASE WHEN n > 2 AND 1 - ic * ic > 1e-12 THEN ic * sqrt((n - 2) / (1 - ic * ic)) END, 5) + 0.0 AS t FROM i""",
)
def filing_ic(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of signals with the return that follows, by year, with its t."""
    s = roles.signals(spark, d).where("known_at IS NOT NULL AND score IS NOT NULL").withColumn("known_day", normal.day_in_zone(F.col("known_at")))
    series = portfolio.row_horizon(roles.daily(spark, d), HORIZON).withColumn("entry", F.col("date"))
    hit = asof.asof_join(
        lookups.with_symbol(s.select("signal_id", "cik", "score", "known_day"), spark, d), series, keys=["symbol"], left_time="known_day", right_time="date",
        values=["entry", "adj_close", "exit_close"], direction="forward", exact=False, slice_width=1024,
    ).where((F.datediff("entry", "known_day") <= MAX_LAG) & F.col("exit_close").isNotNull())
    j = hit.select(F.year("known_day").alias("year"), "score", (F.col("exit_close") / F.col("adj_close") - 1).alias("ret"))
    ic = ranking.rank_correlation(j, ["year"], "score", "ret")
    return ic.select("year", "n", (F.round("ic", 6) + 0.0).alias("ic"), (F.round(ranking.ic_t(F.col("ic"), F.col("n")), 5) + 0.0).alias("t"))


