"""Portfolio construction: covariances by distributed sums, then small dense solves.

The sums over days (of products, squares' products, cubes' products) are Spark aggregates over a long table of returns; what
is left has the size of the number of assets squared, which is checked before it is collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

YEAR = 252.0
MOST_ASSETS = 2_000


def expected_returns(returns: DataFrame) -> DataFrame:
    return returns.groupBy("ticker").agg((F.avg("ret") * YEAR).alias("expected_return"))


def covariances(returns: DataFrame) -> DataFrame:
    """(a, b, cov) for a <= b, sample covariance a year; rows of a date meet each other only."""
    a, b = (returns.select(F.col("ticker").alias(k), "date", F.col("ret").alias(f"r{k}")) for k in "ab")
    return a.join(b, "date").where("a <= b").groupBy("a", "b").agg((F.covar_samp("ra", "rb") * YEAR).alias("cov"))


def centred(returns: DataFrame) -> DataFrame:
    means = returns.groupBy("ticker").agg(F.avg("ret").alias("m"))
    return returns.join(means, "ticker").select("ticker", "date", (F.col("ret") - F.col("m")).alias("x"))


def moment_sums(returns: DataFrame) -> DataFrame:
    """(a, b, n, s11, s22, s31): mean products of centred returns, of their squares, and of cubes of a with b, for all a, b."""
    c = centred(returns)
    a, b = (c.select(F.col("ticker").alias(k), "date", F.col("x").alias(f"x{k}")) for k in "ab")
    x, y = F.col("xa"), F.col("xb")
    return a.join(b, "date").groupBy("a", "b").agg(F.count("*").alias("n"), F.avg(x * y).alias("s11"), F.avg(x * x * y * y).alias("s22"), F.avg(x * x * x * y).alias("s31"))


def _square(rows: DataFrame, names: list[str]) -> tuple[list[str], dict[str, np.ndarray], int]:
    if rows.select("a").distinct().limit(MOST_ASSETS + 1).count() > MOST_ASSETS:
        raise ValueError(f"more than {MOST_ASSETS} assets")
    pdf = rows.toPandas()
    tickers = sorted(pdf["a"].unique())
    out = {n: pdf.pivot(index="a", columns="b", values=n).loc[tickers, tickers].to_numpy(float) for n in names}
    return tickers, out, int(pdf["n"].iloc[0]) if "n" in pdf else 0


def shrink(s: np.ndarray, s22: np.ndarray, s31: np.ndarray, t: int) -> tuple[np.ndarray, float]:
    """Ledoit-Wolf towards constant correlation; (daily covariance, intensity). s is over T, not T - 1."""
    n, dev = len(s), np.sqrt(np.diag(s))
    off = ~np.eye(n, dtype=bool)
    r = (s / np.outer(dev, dev))[off].mean() if n > 1 else 0.0
    target = np.where(off, r * np.outer(dev, dev), s)
    pi = s22 - s * s
    rho = np.trace(pi) + r * (np.outer(1 / dev, dev) * (s31 - np.diag(s)[:, None] * s))[off].sum()
    gap = ((target - s) ** 2).sum()
    delta = float(np.clip((pi.sum() - rho) / (gap * t), 0, 1)) if gap > 0 else 0.0
    return delta * target + (1 - delta) * s, delta


def ledoit_wolf(returns: DataFrame) -> DataFrame:
    """(a, b, cov, shrinkage), a year."""
    tickers, m, t = _square(moment_sums(returns), ["s11", "s22", "s31"])
    cov, delta = shrink(m["s11"], m["s22"], m["s31"], t)
    rows = [(a, b, float(cov[i, j] * YEAR), delta) for i, a in enumerate(tickers) for j, b in enumerate(tickers)]
    return returns.sparkSession.createDataFrame(rows, "a string, b string, cov double, shrinkage double")


def inputs(returns: DataFrame, shrunk: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(tickers, yearly means, yearly covariance), for the solvers."""
    if shrunk:
        tickers, m, _ = _square(ledoit_wolf(returns), ["cov"])
        cov = m["cov"]
    else:
        rows = covariances(returns)
        both = rows.union(rows.where("a < b").select("b", "a", "cov"))
        tickers, m, _ = _square(both, ["cov"])
        cov = m["cov"]
    mu = {r.ticker: r.expected_return for r in expected_returns(returns).collect()}  # a row for each asset
    return tickers, np.array([mu[t] for t in tickers]), cov


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        np.linalg.cholesky(a)
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def portfolio_stats(w: np.ndarray, mu: np.ndarray, cov: np.ndarray, rf: float = 0.02) -> tuple[float, float, float]:
    r, v = float(w @ mu), float(np.sqrt(max(w @ cov @ w, 0.0)))
    return r, v, (r - rf) / v if v > 1e-12 else 0.0


def minimum_variance(cov: np.ndarray) -> np.ndarray:
    x = _solve(cov, np.ones(len(cov)))
    return x / x.sum()


def target_return(mu: np.ndarray, cov: np.ndarray, target: float) -> np.ndarray:
    one = np.ones(len(mu))
    si, sm = _solve(cov, one), _solve(cov, mu)
    a, b, c = one @ si, one @ sm, mu @ sm
    d = a * c - b * b
    if abs(d) < 1e-12:
        return minimum_variance(cov)
    return (c - b * target) / d * si + (a * target - b) / d * sm


def tangency(mu: np.ndarray, cov: np.ndarray, rf: float = 0.02) -> np.ndarray:
    x = _solve(cov, mu - rf)
    return x / x.sum() if abs(x.sum()) > 1e-12 else minimum_variance(cov)


def risk_parity(cov: np.ndarray, most: int = 10_000, tolerance: float = 1e-14) -> np.ndarray:
    """Equal contributions to risk: coordinate steps on y'Cy / 2 - mean(log y), scaled to add up to 1 at the end."""
    n = len(cov)
    y = 1 / np.sqrt(np.diag(cov))
    for _ in range(most):
        old = y.copy()
        for i in range(n):
            b = cov[i] @ y - cov[i, i] * y[i]
            y[i] = (-b + np.sqrt(b * b + 4 * cov[i, i] / n)) / (2 * cov[i, i])
        if np.abs(y - old).max() <= tolerance * np.abs(y).max():
            break
    return y / y.sum()


def project(v: np.ndarray, low: float, high: float) -> np.ndarray:
    """The nearest weights in [low, high] that add up to 1: sums at all breakpoints of the shift, then one segment."""
    n = len(v)
    if n * low > 1 + 1e-12 or n * high < 1 - 1e-12:
        raise ValueError("no weights within these bounds add up to 1")
    shift = np.sort(np.concatenate([v - high, v - low]))
    total = np.clip(v[None, :] - shift[:, None], low, high).sum(axis=1)  # falls as the shift rises
    k = int(np.searchsorted(-total, -1.0))
    if k < len(shift) and total[k] == 1.0 or k == 0:
        theta = shift[min(k, len(shift) - 1)]
    else:
        a, b = shift[k - 1], shift[min(k, len(shift) - 1)]
        free = (v - high <= a) & (v - low >= b)
        theta = a + (total[k - 1] - 1.0) / free.sum() if free.any() else a
    return np.clip(v - theta, low, high)


def utility(mu: np.ndarray, cov: np.ndarray, gamma: float, low: float = 0.0, high: float = 1.0, most: int = 20_000, tolerance: float = 1e-12) -> np.ndarray:
    """min w'Cw / 2 - gamma mu'w within the bounds: accelerated projected gradient that restarts when it would climb."""
    step = 1 / max(float(np.linalg.eigvalsh(cov)[-1]), 1e-300)
    w = z = project(np.full(len(mu), 1 / len(mu)), low, high)
    t = 1.0
    for _ in range(most):
        new = project(z - step * (cov @ z - gamma * mu), low, high)
        if (z - new) @ (new - w) > 0:
            z, t = w, 1.0
            new = project(z - step * (cov @ z - gamma * mu), low, high)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        moved = np.abs(new - w).max()
        z, w, t = new + (t - 1) / nt * (new - w), new, nt
        if moved <= tolerance and np.abs(z - w).max() <= tolerance:
            break
    return w


def max_sharpe(mu: np.ndarray, cov: np.ndarray, rf: float = 0.02, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    """The best of a logarithmic grid of risk appetites, refined by bisection on the tangency condition."""
    grid = np.logspace(-6, 4, 101)
    found = [utility(mu, cov, g, low, high) for g in grid]
    best = int(np.argmax([portfolio_stats(w, mu, cov, rf)[2] for w in found]))
    # on the tangent, gamma is the variance over the excess return
    gap = lambda w, g: g * (w @ mu - rf) - w @ cov @ w
    a, b = grid[max(best - 1, 0)], grid[min(best + 1, 100)]
    for _ in range(60):
        g = np.sqrt(a * b)
        w = utility(mu, cov, g, low, high)
        a, b = (g, b) if gap(w, g) < 0 else (a, g)
    return max([found[best], utility(mu, cov, np.sqrt(a * b), low, high)], key=lambda w: portfolio_stats(w, mu, cov, rf)[2])


def frontier(spark: SparkSession, mu: np.ndarray, cov: np.ndarray, points: int = 35, low: float = 0.0, high: float = 1.0, rf: float = 0.02) -> DataFrame:
    """Constrained frontier, a risk appetite a row, solved side by side."""
    data = spark.sparkContext.broadcast((mu, cov))
    gammas = [0.0] + [10 ** (-3 + 5 * i / (points - 1)) for i in range(1, points)]

    def solve(batches):
        for pdf in batches:
            yield pd.DataFrame([portfolio_stats(utility(*data.value, g, low, high), *data.value, rf) for g in pdf["gamma"]], columns=["expected_return", "volatility", "sharpe"])

    rows = spark.createDataFrame([(g,) for g in gammas], "gamma double").repartition(min(points, spark.sparkContext.defaultParallelism))
    return rows.mapInPandas(solve, "expected_return double, volatility double, sharpe double").orderBy("volatility")


def unconstrained_frontier(mu: np.ndarray, cov: np.ndarray, points: int = 35, rf: float = 0.02) -> list[tuple[float, float, float]]:
    start = portfolio_stats(minimum_variance(cov), mu, cov, rf)[0]
    stop = 1.5 * mu.max()
    return [portfolio_stats(target_return(mu, cov, start + (stop - start) * i / max(points - 1, 1)), mu, cov, rf) for i in range(points)]


def weights_table(spark: SparkSession, returns: DataFrame, cap: float = 0.4, rf: float = 0.02) -> DataFrame:
    tickers, mu, cov = inputs(returns)
    cols = {"gmv_unconstrained": minimum_variance(cov), "tangency_unconstrained": tangency(mu, cov, rf), "gmv_constrained": utility(mu, cov, 0.0, 0.0, cap), "max_sharpe_constrained": max_sharpe(mu, cov, rf, 0.0, cap), "risk_parity": risk_parity(cov)}
    return spark.createDataFrame([(t, *(float(cols[c][i]) for c in cols)) for i, t in enumerate(tickers)], "ticker string, " + ", ".join(f"{c} double" for c in cols))
