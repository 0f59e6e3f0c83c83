from __future__ import annotations

import math
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import portfolio, ranking, statistics

MONTHS = [date(2021, m, 28) for m in (1, 2, 3)]


def panel(spark, flip=True, ret=0.0):
    data = []
    for m, d in enumerate(MONTHS):
        for i in range(10):
            score = float(-i if flip and m == 2 else i)
            data.append((d, i, f"T{i}", score, ret if isinstance(ret, float) else ret[i]))
    return spark.createDataFrame(data, "date date, cik int, ticker string, score double, ret double")


def test_turnover_and_cost_of_a_flipped_ranking(spark):
    out = portfolio.long_short(panel(spark), q=5, min_stocks=10, cost_bp=10).orderBy("date").collect()
    assert [r["turnover"] for r in out] == pytest.approx([0.5, 0.0, 1.0])
    assert [r["cost"] for r in out] == pytest.approx([0.002, 0.0, 0.004])
    assert all(r["ic"] is None and r["n_long"] == 2 and r["n_short"] == 2 for r in out)


def test_a_period_with_too_few_stocks_is_left_out_and_skipped_over(spark):
    thin = panel(spark).where(~((F.col("date") == F.lit(MONTHS[1])) & (F.col("cik") > 4)))
    out = portfolio.long_short(thin, q=5, min_stocks=10, cost_bp=10).orderBy("date").collect()
    assert [r["date"] for r in out] == [MONTHS[0], MONTHS[2]] and out[1]["turnover"] == pytest.approx(1.0)


def test_value_weights_and_unsized_rows(spark):
    rows = [(MONTHS[0], i, f"T{i}", float(i), r, s) for i, r, s in [(0, -0.1, 1.0), (1, -0.1, 3.0), (2, 0.0, 1.0), (3, 0.10, 3.0), (4, 0.40, 1.0), (5, 9.9, None), (6, 9.9, 0.0)]]
    p = spark.createDataFrame(rows, "date date, cik int, ticker string, score double, ret double, size double")
    out = portfolio.long_short(p, q=2, min_stocks=5, size="size").first()
    assert out["n_stocks"] == 5 and out["ret_long"] == pytest.approx((3 * 0.10 + 0.40) / 4)


def test_planted_score_is_monotone(spark):
    out = portfolio.long_short(panel(spark, flip=False, ret=[i / 100 for i in range(10)]), q=5, min_stocks=10).first()
    assert out["ic"] == pytest.approx(1.0) and [out[f"ret_q{k}"] for k in range(1, 6)] == sorted(out[f"ret_q{k}"] for k in range(1, 6))


def test_period_return_of_a_stock_that_ends(spark):
    d = [date(2021, 1, 29), date(2021, 2, 10), date(2021, 2, 26)]
    prices = spark.createDataFrame([(d[0], "A", 100.0), (d[1], "A", 80.0), (d[0], "B", 50.0), (d[0], "C", 10.0), (d[2], "C", 11.0), (d[2], "C", 13.0)], "date date, symbol string, adj_close double")
    out = portfolio.period_returns(prices, spark.createDataFrame([(d[0], d[2]), (d[2], None)], "date date, next_date date"))
    assert {r["symbol"]: round(r["ret"], 6) for r in out.collect()} == {"A": -0.2, "B": 0.0, "C": 0.2}


def test_prices_outside_the_period_change_nothing(spark):
    d = [date(2021, 1, 29), date(2021, 2, 26)]
    dates = spark.createDataFrame([(d[0], d[1])], "date date, next_date date")
    base = [(d[0], "A", 100.0), (d[1], "A", 110.0)]
    run = lambda x: portfolio.period_returns(spark.createDataFrame(x, "date date, symbol string, adj_close double"), dates).collect()
    assert run(base) == run([*base, (date(2021, 1, 28), "A", 1.0), (date(2021, 3, 1), "A", 999.0)])


def test_row_horizon_counts_own_rows(spark):
    days = [date(2021, 3, x) for x in (1, 2, 5, 9)]
    p = spark.createDataFrame([(d, "A", 100 * 1.01**i) for i, d in enumerate(days)], "date date, symbol string, adj_close double")
    out = portfolio.row_horizon(p, 2).orderBy("date").collect()
    assert [r["exit_date"] for r in out] == [days[2], days[3], None, None]
    assert out[0]["exit_close"] / out[0]["adj_close"] == pytest.approx(1.01**2)


def test_buckets_and_ranks(spark):
    df = spark.range(1, 11).select(F.col("id").alias("r"), F.lit(10).alias("n"))
    assert [x["b"] for x in df.select(ranking.bucket(F.col("r"), F.col("n"), 5).alias("b")).collect()] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert spark.range(1).select(ranking.bucket(F.lit(1), F.lit(1), 5).alias("b")).first()["b"] == 1
    ties = spark.createDataFrame([("g", 1.0, 1.0), ("g", 1.0, 2.0), ("g", 2.0, 3.0), ("g", 3.0, 3.0), ("h", 1.0, 1.0), ("h", 1.0, 2.0), ("g", None, 1.0)], "g string, x double, y double")
    out = {r["g"]: (r["n"], r["ic"]) for r in ranking.rank_correlation(ties, ["g"], "x", "y").collect()}
    assert out["h"] == (2, None) and out["g"][0] == 4
    assert out["g"][1] == pytest.approx(np.corrcoef([1.5, 1.5, 3, 4], [1, 2, 3.5, 3.5])[0, 1])


def test_growth_with_a_total_loss(spark):
    m = spark.createDataFrame([(1, 0.5), (2, -1.2), (3, 0.1)], "date int, r double")
    assert [round(r["growth"], 6) for r in portfolio.growth(m, "r").orderBy("date").collect()] == [1.5, -0.3, -0.33]


def test_expected_max_sharpe():
    assert statistics.expected_max_sharpe(1, 0.5) == 0
    assert statistics.expected_max_sharpe(10, 1.0) == pytest.approx(1.575, abs=1e-3)
    assert statistics.expected_max_sharpe(1000, 1.0) == pytest.approx(3.255, abs=1e-3)


def test_hac_without_lags_is_the_sandwich_and_recovers_a_slope():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(400), rng.normal(size=400)])
    y = x @ np.array([0.1, 2.0]) + rng.normal(size=400)
    beta, t, r2 = statistics.hac_ols(y, x, 0)
    u = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    inv = np.linalg.inv(x.T @ x)
    se = np.sqrt(np.diag(inv @ (x.T * u**2) @ x @ inv))
    assert beta[1] == pytest.approx(2.0, abs=0.15) and t == pytest.approx(beta / se) and 0.7 < r2 < 0.9
    assert statistics.newey_west_lags(167) == 4 and statistics.newey_west_lags(71) == 3


def test_factor_regression_per_strategy(spark):
    rng = np.random.default_rng(1)
    f = [(i, *rng.normal(size=2).tolist()) for i in range(60)]
    r = [(i, s, 0.5 + k * a) for i, a, _ in f for s, k in (("x", 1.0), ("y", 2.0))]
    out = statistics.factor_regression(spark.createDataFrame(r, "m int, s string, ret double"), spark.createDataFrame(f, "m int, f0 double, f1 double"), on="m", value="ret", names=["f0", "f1"], group="s")
    got = {(x["s"], x["term"]): x["coef"] for x in out.collect()}
    assert got["x", "f0"] == pytest.approx(1.0) and got["y", "f0"] == pytest.approx(2.0) and got["y", "alpha"] == pytest.approx(0.5)


def test_bootstrap_is_seeded_and_centred(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([("g", float(x), float(-x), float(x + rng.normal())) for x in rng.normal(size=80)], "g string, a double, b double, y double")
    run = lambda: statistics.bootstrap_gap(df, group="g", a="a", b="b", y="y", draws=50, per_task=20)
    one, two = ({r["draw"]: r["gap"] for r in run().collect()} for _ in range(2))
    assert one == two and len(one) == 50 and all(g > 0.5 for g in one.values())
    ci = statistics.interval(run(), ["g"], "gap").first()
    assert ci["low"] == pytest.approx(np.percentile(list(one.values()), 2.5)) and ci["high"] == pytest.approx(np.percentile(list(one.values()), 97.5))


def test_deflated_sharpe(spark):
    m = statistics.sharpe_moments(spark.createDataFrame([("v", float(x)) for x in [0.01, 0.02, -0.01, 0.03, 0.0]] + [("one", 1.0), ("one", math.nan)], "v string, r double"), ["v"], "r")
    out = {r["v"]: r for r in statistics.deflated(m, 10, 0.01).collect()}
    x = np.array([0.01, 0.02, -0.01, 0.03, 0.0])
    assert out["v"]["sharpe"] == pytest.approx(x.mean() / x.std(ddof=1)) and 0 < out["v"]["dsr"] < 1 and out["one"]["dsr"] is None


@pytest.mark.parametrize("seed", range(3))
def test_ordinals_and_rank_correlation_equal_brute_force(spark, seed):
    """Most rows in one group, half of its values equal, null groups, NaN and null values, repeated rows."""
    r = np.random.default_rng(seed)
    data = [(None if i % 17 == 0 else "hot" if i % 3 else "b", float(r.integers(0, 5)) if i % 2 else 7.0, None if i % 29 == 0 else float("nan") if i % 31 == 0 else float(r.integers(0, 40))) for i in range(400)]
    data += data[:9] + [("one", 1.0, 2.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0)]
    df = spark.createDataFrame(data, "g string, x double, y double").withColumn("extra", F.lit(1)).repartition(5)
    placed = ranking.ordinals(df, ["g"], ["x", "y"], "p").toPandas()
    for _, part in placed.groupby("g", dropna=False):
        assert sorted(part["p"]) == list(range(1, len(part) + 1)) and part.sort_values("p")["x"].is_monotonic_increasing
    got = {x["g"]: (x["n"], x["ic"]) for x in ranking.rank_correlation(df, ["g"], "x", "y").collect()}
    pdf = pd.DataFrame(data, columns=["g", "x", "y"]).dropna(subset=["x", "y"])
    for g, part in pdf.groupby("g", dropna=False):
        n, ic = got.pop(None if g != g or g is None else g)
        want = part["x"].rank().corr(part["y"].rank()) if part["x"].nunique() > 1 and part["y"].nunique() > 1 else None
        assert n == len(part) and ic == (None if want is None else pytest.approx(want))
    assert not got and ranking.rank_correlation(df.limit(0), ["g"], "x", "y").collect() == []


def test_t_without_spread(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, None), (1.0, 2.0)], "m double, s double")
    got = [x[0] for x in df.select(portfolio.t_stat(F.col("m"), F.col("s"), F.lit(4))).collect()]
    assert got[0] == float("inf") and got[1] == float("-inf") and got[2] != got[2] and got[3:] == [None, 1.0]
