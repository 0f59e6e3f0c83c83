"""Regression with autocorrelation-robust errors, deflated Sharpe ratio, bootstrap."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EULER = 0.5772156649015329


def newey_west_lags(t: int) -> int:
    """Rule of thumb floor(4 (T/100)^(2/9))."""
    return int(4 * (t / 100) ** (2 / 9))


def hac_ols(y: np.ndarray, x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, t values, R squared) of y on x (with its constant), Bartlett-weighted errors."""
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    u = y - x @ beta
    xu = x * u[:, None]
    s = xu.T @ xu
    for k in range(1, lags + 1):
        cross = xu[k:].T @ xu[:-k]
        s += (1 - k / (lags + 1)) * (cross + cross.T)
    se = np.sqrt(np.diag(inv @ s @ inv))
    total = ((y - y.mean()) ** 2).sum()
    return beta, beta / np.where(se > 0, se, np.nan), float(1 - (u @ u) / total) if total > 0 else float("nan")


def factor_regression(returns: DataFrame, factors: DataFrame, *, on: str, value: str, names: Sequence[str], group: str, lags: int | None = None) -> DataFrame:
    """(group, term, coef, t, r2, months, lags) per strategy; months missing on either side drop out.

    A strategy is one series with a row per month, so a group is as long as its history.
    """
    names = list(names)
    joined = returns.join(factors, on).dropna(subset=[value, *names]).select(group, on, F.col(value).cast("double").alias("_y"), *names)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(on)
        x = np.column_stack([np.ones(len(pdf)), pdf[names].to_numpy(dtype=float)])
        n, terms = len(pdf), ["alpha", *names]
        use = newey_west_lags(n) if lags is None else lags
        if n <= len(terms):
            return pd.DataFrame({group: [], "term": [], "coef": [], "t": [], "r2": [], "months": [], "lags": []})
        beta, t, r2 = hac_ols(pdf["_y"].to_numpy(dtype=float), x, use)
        return pd.DataFrame({group: pdf[group].iloc[0], "term": terms, "coef": beta, "t": t, "r2": r2, "months": n, "lags": use})

    kind = dict(returns.dtypes)[group]
    return joined.groupBy(group).applyInPandas(fit, f"{group} {kind}, term string, coef double, t double, r2 double, months int, lags int")


def expected_max_sharpe(trials: int, variance: float) -> float:
    """Expected greatest of ``trials`` independent Sharpe estimates with this variance; 0 for one."""
    if trials < 2:
        return 0.0
    z = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - EULER) * z(1 - 1 / trials) + EULER * z(1 - 1 / (trials * math.e)))


def sharpe_moments(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups..., n, sharpe, skew, kurt): moments that the deflated Sharpe ratio needs."""
    ok = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    sd = F.stddev_samp(value)
    return ok.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.when(sd > 0, F.avg(value) / sd).alias("sharpe"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt")
    )


def deflated_sharpe(n: int, sharpe: float, skew: float, kurt: float, threshold: float) -> float:
    """Probability that the true Sharpe ratio exceeds the threshold."""
    scale = 1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2
    return NormalDist().cdf((sharpe - threshold) * math.sqrt(n - 1) / math.sqrt(scale))


def deflated(moments: DataFrame, trials: int, variance: float) -> DataFrame:
    """Adds ``threshold`` and ``dsr`` to rows of :func:`sharpe_moments`."""
    threshold = expected_max_sharpe(trials, variance)

    @F.pandas_udf("double")
    def dsr(n: pd.Series, s: pd.Series, skew: pd.Series, kurt: pd.Series) -> pd.Series:
        ok = n.gt(1) & s.notna() & skew.notna() & kurt.notna()
        return pd.Series([deflated_sharpe(*r, threshold) if good else None for good, r in zip(ok, zip(n, s, skew, kurt))], dtype=float)

    return moments.withColumn("threshold", F.lit(threshold)).withColumn("dsr", dsr("n", "sharpe", "skew", "kurt"))


def rank_ic(x: np.ndarray, y: np.ndarray) -> float:
    if len(np.unique(x)) < 2 or len(np.unique(y)) < 2:
        return float("nan")
    rx, ry = pd.Series(x).rank().to_numpy(), pd.Series(y).rank().to_numpy()
    return float(np.corrcoef(rx, ry)[0, 1])


def bootstrap_gap(df: DataFrame, *, group: str, a: str, b: str, y: str, draws: int, seed: int = 42, per_task: int = 100) -> DataFrame:
    """(group, draw, gap): rank correlation of ``a`` with ``y`` less that of ``b``, per resample.

    A group (a cell of an experiment) is gathered with its rows, so groups must be of experiment
    size; the draws of a group are spread over tasks, each of which repeats the rows.
    """
    blocks = -(-draws // per_task)
    kind = dict(df.dtypes)[group]
    rows = df.dropna(subset=[a, b, y]).select(group, a, b, y).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["_block"].iloc[0])
        pdf = pdf.sort_values([a, b, y])
        va, vb, vy = (pdf[c].to_numpy(dtype=float) for c in (a, b, y))
        out = []
        for d in range(block * per_task, min(draws, (block + 1) * per_task)):
            at = np.random.default_rng([seed, d]).integers(0, len(vy), len(vy))
            out.append((d, rank_ic(va[at], vy[at]) - rank_ic(vb[at], vy[at])))
        return pd.DataFrame({group: pdf[group].iloc[0], "draw": [d for d, _ in out], "gap": [g for _, g in out]})

    return rows.groupBy(group, "_block").applyInPandas(resample, f"{group} {kind}, draw int, gap double")


def interval(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups..., n, low, high): 2.5 and 97.5 percentiles, linear, NaN and null aside."""
    ok = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    return ok.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high"))
