"""Holding periods, panels, quantile portfolios, turnover and cost, performance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.pit import in_force
from tidemark.operators.ranking import bucket, ordinals, rank_correlation
from tidemark.session import stage


def rebalance_dates(calendar: DataFrame, *, date: str = "date", every: int = 1) -> DataFrame:
    """(date, next_date): the last day of each month in the calendar, every k-th, with the one after.

    The windows run over months of the calendar, not over the data.
    """
    last = calendar.select(date).distinct().groupBy(F.trunc(date, "MM").alias("_m")).agg(F.max(date).alias(date))
    w = W.orderBy(date)
    kept = last.withColumn("_i", F.row_number().over(w) - 1).where(F.col("_i") % every == 0)
    return kept.select(date, F.lead(date).over(w).alias("next_date"))


def period_returns(prices: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, symbol, ret): return from each rebalance date to the next, of symbols priced on it.

    The end price is the last in (date, next_date]; a symbol not priced again returns 0.  Repeated
    prices of a day are averaged.  Every price meets its period through the calendar of distinct
    days, so nothing is compared pairwise.
    """
    clean = prices.where("adj_close IS NOT NULL AND NOT isnan(adj_close)").groupBy("date", "symbol").agg(F.avg("adj_close").alias("p"))
    spans = dates.where("next_date IS NOT NULL").select(F.col("date").alias("t"), F.col("next_date").alias("t1"))
    before = clean.select(F.date_sub("date", 1).alias("eve"))
    period = in_force(before, spans, day="eve", date="t").select(F.date_add("eve", 1).alias("date"), "t")
    ends = clean.join(period, "date").join(spans, "t").where("date <= t1").groupBy("t", "symbol").agg(F.max_by("p", "date").alias("p1"))
    starts = clean.join(spans.select(F.col("t").alias("date")), "date").select(F.col("date").alias("t"), "symbol", F.col("p").alias("p0"))
    return starts.join(ends, ["t", "symbol"], "left").select(
        F.col("t").alias("date"), "symbol", F.coalesce(F.col("p1") / F.when(F.col("p0") != 0, F.col("p0")) - 1, F.lit(0.0)).alias("ret")
    )


def row_horizon(prices: DataFrame, rows: int) -> DataFrame:
    """Each price with the date and price ``rows`` rows further in its symbol's own series."""
    clean = prices.where("adj_close IS NOT NULL").groupBy("symbol", "date").agg(F.avg("adj_close").alias("adj_close"))
    w = W.partitionBy("symbol").orderBy("date")
    return clean.withColumns({"exit_date": F.lead("date", rows).over(w), "exit_close": F.lead("adj_close", rows).over(w)})


def legs(panel: DataFrame, q: int, min_stocks: int, size: str | None = None) -> DataFrame:
    """The panel's usable rows of periods that have enough of them, with ``n``, the place ``r`` by
    (score, ticker, cik) and the bucket ``q``; a period may be of any size."""
    ok = panel.where("score IS NOT NULL AND ret IS NOT NULL AND NOT isnan(score) AND NOT isnan(ret)")
    if size:
        ok = ok.where(F.col(size) > 0)
    placed = ordinals(ok, ["date"], ["score", "ticker", "cik"], "r")
    n = placed.groupBy("date").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_stocks)
    return placed.join(n, "date").withColumn("q", bucket(F.col("r"), F.col("n"), q))


def long_short(panel: DataFrame, *, q: int = 5, min_stocks: int = 100, cost_bp: float = 10.0, size: str | None = None) -> DataFrame:
    """One row per kept period: counts, leg returns, turnover, cost and rank correlation.

    ``panel`` is (date, cik, ticker, score, ret[, size]).  Weights are equal within the top and
    bottom bucket, or in proportion to ``size``.  The turnover compares each period's targets with
    the targets of the kept period before, drifted by its returns; the first is bought from cash.
    Periods with fewer than ``min_stocks`` usable rows are left out.  No row's state depends on
    more than the period before, so all periods are computed at once.
    """
    rows = stage(legs(panel, q, min_stocks, size), "legs")  # read by returns, trades, quantiles and ranks
    periods = rows.select("date").distinct().withColumn("i", F.row_number().over(W.orderBy("date")))
    leg = F.when(F.col("q") == q, 1).when(F.col("q") == 1, -1)
    base = F.col(size) if size else F.lit(1.0)
    held = rows.withColumn("leg", leg).where("leg IS NOT NULL").join(periods, "date")
    grown = base * (1 + F.coalesce("ret", F.lit(0.0)))
    sums = held.groupBy("i", "leg").agg(F.sum(base).alias("_base"), F.sum(grown).alias("_grown"))  # two rows a period
    held = held.join(sums, ["i", "leg"]).withColumns({"w": base / F.col("_base"), "_drift": grown / F.col("_grown")})
    drifted = held.select((F.col("i") + 1).alias("i"), "leg", "cik", F.col("_drift").alias("w_prev"))
    target = held.select("i", "leg", "cik", "w")
    trades = (
        target.join(drifted, ["i", "leg", "cik"], "full")
        .groupBy("i").agg(F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("w_prev", F.lit(0.0)))).alias("traded"))
        .join(periods.select("i"), "i", "left_semi")  # the last targets drift into no period
    )
    returns = held.groupBy("date", "i").agg(
        _leg_return(1).alias("ret_long"), _leg_return(-1).alias("ret_short"),
        F.count(F.when(F.col("leg") == 1, 1)).alias("n_long"), F.count(F.when(F.col("leg") == -1, 1)).alias("n_short"),
    )
    quantiles = rows.groupBy("date").agg(F.first("n").alias("n_stocks"), *[F.avg(F.when(F.col("q") == k, F.col("ret"))).alias(f"ret_q{k}") for k in range(1, q + 1)])
    ic = rank_correlation(rows, ["date"], "score", "ret", x_place="r").select("date", "ic")
    cost = F.col("traded") * cost_bp * 1e-4
    spread = F.col("ret_long") - F.col("ret_short")
    return (
        returns.join(trades, "i").join(quantiles, "date").join(ic, "date")
        .select("date", "n_stocks", "n_long", "n_short", "ret_long", "ret_short", spread.alias("ret_ls"), (F.col("traded") / 4).alias("turnover"),
                cost.alias("cost"), "ic", (spread - cost).alias("ret_ls_net"), *[f"ret_q{k}" for k in range(1, q + 1)])
    )


def _leg_return(leg: int) -> Column:
    return F.sum(F.when(F.col("leg") == leg, F.col("w") * F.col("ret")))


def t_stat(mean: Column, sd: Column, n: Column) -> Column:
    """mean / (sd / sqrt n); without spread infinite with the mean's sign, NaN where that is zero
    too, null where the sd is missing."""
    flat = F.when(mean > 0, float("inf")).when(mean < 0, float("-inf")).when(mean == 0, float("nan"))
    return F.when(sd > 0, mean / (F.when(sd > 0, sd) / F.sqrt(n))).when(sd == 0, flat)


def growth(monthly: DataFrame, value: str, groups: Sequence[str] = (), order: str = "date") -> DataFrame:
    """Cumulative growth and drawdown of a period series; the running maximum begins with period 1."""
    w = W.partitionBy(*groups).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    path = monthly.withColumn("growth", F.product(1 + F.col(value)).over(w))
    return path.withColumn("drawdown", F.col("growth") / F.max("growth").over(w) - 1)


def summarize(monthly: DataFrame, *, months_held: int = 1, q: int = 5) -> DataFrame:
    """One row of performance: annual return, volatility, Sharpe gross and net, IC, turnover (first
    period aside), drawdown of the net series, quantile means.  Null where a ratio has no scale."""
    per_year = 12 / months_held
    path = growth(monthly, "ret_ls_net").withColumn("_first", F.row_number().over(W.orderBy("date")) == 1)
    sharpe = lambda c: F.when(F.stddev_samp(c) > 0, F.avg(c) / F.stddev_samp(c) * (per_year**0.5))
    return path.agg(
        F.count(F.lit(1)).alias("periods"), F.avg("n_stocks").alias("avg_stocks"), F.avg("ic").alias("mean_ic"),
        t_stat(F.avg("ic"), F.stddev_samp("ic"), F.count("ic")).alias("ic_t"), F.avg((F.col("ic") > 0).cast("int")).alias("share_ic_positive"),
        (F.avg("ret_ls") * per_year).alias("annual_return_gross"), (F.stddev_samp("ret_ls") * per_year**0.5).alias("annual_vol_gross"), sharpe("ret_ls").alias("sharpe_gross"),
        (F.avg("ret_ls_net") * per_year).alias("annual_return_net"), sharpe("ret_ls_net").alias("sharpe_net"),
        F.avg(F.when(~F.col("_first"), F.col("turnover"))).alias("avg_turnover"), F.min("drawdown").alias("max_drawdown_net"),
        *[F.avg(f"ret_q{k}").alias(f"mean_q{k}") for k in range(1, q + 1)],
    )
