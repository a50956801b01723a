"""Tests of strategy returns: bootstrap, probabilistic and deflated Sharpe ratios, superior predictive ability.

Resamples are rows of a range, each with a random stream of its own number; the returns they read are one array of a single
strategy or benchmark (a few thousand numbers), which is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import Streams
from ..functions.scalar import normal_cdf, normal_quantile

YEAR = 252.0
EULER = 0.5772156649015329


def series(returns: DataFrame, order: str = "date", most: int = 2_000_000) -> np.ndarray:
    """One strategy's returns in order; refuses more than ``most`` of them."""
    rows = returns.select(order, "ret").orderBy(order).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError("more returns than one series may have")
    return rows["ret"].to_numpy(float)


def sharpe_of(x: np.ndarray, rf: float = 0.02) -> np.ndarray:
    """Along the last axis."""
    vol = x.std(axis=-1, ddof=1) * math.sqrt(YEAR)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(vol > 1e-9, (x.mean(axis=-1) * YEAR - rf) / vol, 0.0)


def politis_white(x: np.ndarray) -> float:
    """The automatic block length of a stationary bootstrap; NaN for short or constant series."""
    n = len(x)
    if n < 16 or np.ptp(x) <= 1e-12 * np.abs(x).max():
        return math.nan
    k = int(max(5.0, math.sqrt(math.log10(n))))
    most = math.ceil(math.sqrt(n)) + k
    lags = min(n - 1, 2 * most)
    g = autocovariances(x)[: lags + 1]
    small = np.abs(g / g[0]) < 2 * math.sqrt(math.log10(n) / n)
    m = next((a for a in range(1, lags - k + 1) if small[a + 1 : a + k + 1].all()), math.ceil(math.sqrt(n)))
    wide = max(1, min(2 * m, most, lags))
    i = np.arange(1, wide + 1)
    flat = np.where(i / wide <= 0.5, 1.0, 2 * (1 - i / wide))
    spec, slope = g[0] + 2 * (flat * g[1 : wide + 1]).sum(), 2 * (flat * i * g[1 : wide + 1]).sum()
    d = 2 * spec * spec
    if d <= 0:
        return math.nan
    return min(max((2 * slope * slope / d) ** (1 / 3) * n ** (1 / 3), 1.0), max(1.0, min(3 * math.sqrt(n), n / 3)))


def block_length(x: np.ndarray, asked: float = 0.0) -> float:
    b = asked if asked > 0 else politis_white(x)
    return min(max(len(x) ** (1 / 3) if math.isnan(b) else b, 1.0), float(len(x)))


def bootstrap_sharpe(spark: SparkSession, strategy: np.ndarray, benchmark: np.ndarray | None = None, resamples: int = 10_000, block: float = 0.0, rf: float = 0.02, seed: int = 42) -> DataFrame:
    """(resample, sharpe, excess): Sharpe ratios of resampled returns; the same days are drawn for a benchmark."""
    n, block = len(strategy), block_length(strategy, block)
    data = spark.sparkContext.broadcast(np.stack([strategy, strategy if benchmark is None else benchmark]))

    def draw(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                ids = pdf["id"].to_numpy()[at : at + 512]
                days = Streams(seed, ids).blocks(n, n, block)
                a, b = sharpe_of(data.value[0][days], rf), sharpe_of(data.value[1][days], rf)
                yield pd.DataFrame({"resample": ids, "sharpe": a, "excess": a - b})

    return spark.range(0, resamples, 1, min(resamples, 2 * spark.sparkContext.defaultParallelism)).mapInPandas(draw, "resample long, sharpe double, excess double")


def bootstrap_summary(draws: DataFrame, x: str, estimate: float, confidence: float = 0.95) -> DataFrame:
    """Percentile interval and p-values, one-sided and two-sided, of draws centred at the estimate."""
    low = (1 - confidence) / 2
    centred = F.col(x) - estimate
    return draws.agg(
        F.lit(estimate).alias("estimate"), F.percentile(x, low).alias("low"), F.percentile(x, 1 - low).alias("high"), F.stddev_samp(x).alias("error"),
        ((1 + F.count(F.when(centred >= estimate, 1))) / (F.count(x) + 1)).alias("p_one_sided"), ((1 + F.count(F.when(F.abs(centred) >= abs(estimate), 1))) / (F.count(x) + 1)).alias("p_two_sided"))


def probabilistic_sharpe(moments: DataFrame, hurdle: float | str = 0.0, rf: float = 0.02) -> DataFrame:
    """Adds ``psr`` to rows with n, mean, std, skew, kurtosis (excess) of per-period returns: the probability that the true Sharpe ratio is above
    a yearly hurdle (a number or a column). The risk-free rate goes off the mean before the ratio is formed."""
    sr = F.when(F.col("std") > 0, F.try_divide(F.col("mean") - rf / YEAR, F.col("std"))).otherwise(0.0)
    target = (F.col(hurdle) if isinstance(hurdle, str) else F.lit(float(hurdle))) / math.sqrt(YEAR)
    var = 1 - F.col("skew") * sr + (F.col("kurtosis") + 2) / 4 * sr * sr
    z = (sr - target) * F.sqrt(F.col("n") - 1.0) / F.sqrt(F.nullif(F.greatest(var, F.lit(0.0)), F.lit(0.0)))
    return moments.withColumn("psr", F.when(F.col("n") < 3, 0.5).when(var <= 0, (sr > target).cast("double")).otherwise(normal_cdf(z)))


def expected_max_sharpe(trials, deviation):
    """The highest Sharpe ratio that so many trials without skill would show."""
    n = F.col(trials) if isinstance(trials, str) else F.lit(float(trials))
    d = F.col(deviation) if isinstance(deviation, str) else F.lit(float(deviation))
    value = d * ((1 - EULER) * normal_quantile(1 - 1 / n) + EULER * normal_quantile(1 - 1 / (n * math.e)))
    return F.when(n <= 1, 0.0).otherwise(value)


def pair_correlations(returns: DataFrame, key: str = "ticker", order: str = "date") -> DataFrame:
    """Correlations of all pairs a < b of series; rows meet by their date, never all at once."""
    a, b = (returns.select(F.col(key).alias(k), order, F.col("ret").alias(f"ret_{k}")) for k in "ab")
    return a.join(b, order).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("ret_a", "ret_b").alias("correlation"))


def effective_trials(returns: DataFrame, key: str = "ticker", order: str = "date") -> DataFrame:
    """1 + (N - 1)(1 - mean correlation), the mean kept in [0, 1]."""
    mean = pair_correlations(returns, key, order).where("n >= 3 and correlation is not null and not isnan(correlation)").agg(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("correlation"))), F.lit(0.0)).alias("mean_correlation"))
    n = returns.agg(F.count_distinct(key).alias("trials"))
    return mean.crossJoin(n).select("trials", "mean_correlation", (1 + (F.col("trials") - 1) * (1 - F.col("mean_correlation"))).alias("effective"))  # one row each


def deflated_sharpe(moments: DataFrame, trials: list[float] | np.ndarray, effective: float | None = None, rf: float = 0.02) -> DataFrame:
    """``probabilistic_sharpe`` against the highest yearly Sharpe ratio that chance would show among the trials, whose ratios are given.

    effective: how many trials they count for, all of them unless told (``effective_trials``).
    """
    trials = np.asarray(trials, float)
    spread = float(trials.std(ddof=1)) if len(trials) > 1 else 0.0
    told = moments.withColumn("trials", F.lit(float(effective if effective is not None else len(trials)))).withColumn("trial_sharpe_std", F.lit(spread))
    told = told.withColumn("threshold", expected_max_sharpe("trials", "trial_sharpe_std"))
    return probabilistic_sharpe(told, "threshold", rf).withColumnRenamed("psr", "dsr")


def autocovariances(x: np.ndarray) -> np.ndarray:
    """Sums of products of centred values so many places apart, over their number, by a transform of twice the length."""
    n = len(x)
    waves = np.fft.rfft(x - x.mean(), 2 * n)
    return np.fft.irfft(waves * waves.conj(), 2 * n)[:n] / n


def long_run_variance(x: np.ndarray, block: float) -> float:
    """The variance of root n times the mean under the stationary bootstrap (Politis and Romano 1994): every autocovariance, on both sides,
    weighted by the chance that a resample keeps two days so far apart together, around the end of the series as well."""
    gamma = autocovariances(x)
    apart = np.arange(len(x)) / len(x)
    stay = (1 - 1 / block) ** np.arange(len(x) + 1)
    kept = (1 - apart) * stay[:-1] + apart * stay[:0:-1]
    return float(2 * kept @ gamma - kept[0] * gamma[0])


def predictive_ability(spark: SparkSession, strategies: np.ndarray, benchmark: np.ndarray, resamples: int = 10_000, block: float = 0.0, seed: int = 42) -> DataFrame:
    """One row: reality check and SPA p-values (lower, consistent, upper) of (K, n) strategy returns over a benchmark."""
    d = strategies - benchmark
    k, n = d.shape
    block = block_length(d[0], block)
    mean, omega = d.mean(axis=1), np.sqrt(np.maximum([long_run_variance(x, block) for x in d], 0))
    use = omega > 1e-12
    root = math.sqrt(n)
    t = np.where(use, root * mean / np.where(use, omega, 1), 0.0)
    rc, spa = float((root * mean).max()), max(0.0, float(t[use].max(initial=0.0)))
    recentre = {"lower": np.minimum(mean, 0), "consistent": np.where(t < -math.sqrt(2 * math.log(math.log(n))), mean, 0.0), "upper": np.zeros(k)}
    data = spark.sparkContext.broadcast(d)

    def draw(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                ids = pdf["id"].to_numpy()[at : at + 256]
                days = Streams(seed, ids).blocks(n, n, block)
                c = np.stack([x[days].mean(axis=1) for x in data.value], axis=1) - mean
                out = {"rc": ((root * c).max(axis=1) >= rc).astype(int)}
                for name, mu in recentre.items():
                    top = (root * (c + mu)[:, use] / omega[use]).max(axis=1, initial=0.0)
                    out[name] = (np.maximum(top, 0) >= spa).astype(int)
                yield pd.DataFrame(out)

    drawn = spark.range(0, resamples, 1, 2 * spark.sparkContext.defaultParallelism).mapInPandas(draw, "rc int, lower int, consistent int, upper int")
    p = lambda c: ((1 + F.sum(c)) / (F.count("*") + 1)).alias(f"p_{c}")
    return drawn.agg(F.lit(rc).alias("rc_statistic"), F.lit(spa).alias("spa_statistic"), F.lit(block).alias("block"), p("rc"), p("lower"), p("consistent"), p("upper"))
