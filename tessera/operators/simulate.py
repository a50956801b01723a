"""Monte Carlo over a range of paths: bootstrap of a return history, or correlated geometric Brownian motion.

A path is a random stream of its own; a task computes all days of a batch of paths side by side and emits one row for each
path. Only aggregates of these rows leave the cluster.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar
from ..functions.rng import Streams

YEAR = 252.0
PATHS_AT_ONCE = 4096
PATH = "path long, terminal double, max_drawdown double"


def quantile_of(p: float) -> float:
    """The normal quantile of one number."""
    if p <= 0 or p >= 1:
        return -10.0 if p <= 0 else 10.0
    poly = lambda x, c: float(np.polyval(c, x))
    if scalar.ACKLAM_LOW <= p <= 1 - scalar.ACKLAM_LOW:
        q = p - 0.5
        return poly(q * q, scalar.ACKLAM_A) * q / poly(q * q, (*scalar.ACKLAM_B, 1.0))
    tail = math.sqrt(-2 * math.log(min(p, 1 - p)))
    side = poly(tail, scalar.ACKLAM_C) / poly(tail, (*scalar.ACKLAM_D, 1.0))
    return side if p < 0.5 else -side


def _paths(spark: SparkSession, paths: int, walk) -> DataFrame:
    """walk: stream numbers to growth factors by day, as an iterator of arrays."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), PATHS_AT_ONCE):
                ids = pdf["id"].to_numpy()[at : at + PATHS_AT_ONCE]
                wealth = peak = np.ones(len(ids))
                worst = np.zeros(len(ids))
                for value in walk(ids):
                    wealth = value(wealth)
                    peak = np.maximum(peak, wealth)
                    worst = np.maximum(worst, 1 - wealth / peak)
                yield pd.DataFrame({"path": ids, "terminal": wealth, "max_drawdown": worst})

    return spark.range(0, paths, 1, max(1, min(-(-paths // 512), spark.sparkContext.defaultParallelism * max(1, paths // (16 * PATHS_AT_ONCE * spark.sparkContext.defaultParallelism))))).mapInPandas(run, PATH)


def bootstrap_paths(spark: SparkSession, history: np.ndarray, paths: int = 50_000, days: int = 252, block: float = 1.0, seed: int = 42) -> DataFrame:
    data = spark.sparkContext.broadcast(np.asarray(history, float))

    def walk(ids):
        rng, x = Streams(seed, ids), data.value
        n = len(x)
        pos = rng.index(n)
        yield lambda w: np.maximum(w * (1 + x[pos]), 0.0)
        for _ in range(1, days):
            again = np.flatnonzero(rng.uniform() < 1 / block)
            pos = (pos + 1) % n
            if len(again):
                pos[again] = rng.index(n, again)
            yield lambda w: np.maximum(w * (1 + x[pos]), 0.0)

    return _paths(spark, paths, walk)


def fitted_gbm_paths(spark: SparkSession, history: np.ndarray, paths: int = 50_000, days: int = 252, seed: int = 42) -> DataFrame:
    """One asset whose daily log-normal steps have the history's mean and deviation."""
    mu, sigma = float(np.mean(history)), float(np.std(history, ddof=1))

    def walk(ids):
        rng = Streams(seed, ids)
        for _ in range(days):
            step = np.exp(mu - sigma * sigma / 2 + sigma * rng.normal())
            yield lambda w: w * step

    return _paths(spark, paths, walk)


def cholesky(cov: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.cholesky(cov)
    except np.linalg.LinAlgError:
        return np.linalg.cholesky(cov + np.eye(len(cov)) * 1e-12 * np.trace(cov) / len(cov))


def gbm_portfolio_paths(spark: SparkSession, mu: np.ndarray, cov_daily: np.ndarray, weights: np.ndarray, paths: int = 50_000, days: int = 252, rebalance: bool = False, seed: int = 42) -> DataFrame:
    """Correlated assets: yearly drifts, a daily covariance; bought and held, or rebalanced each day."""
    chol = spark.sparkContext.broadcast((cholesky(cov_daily), np.asarray(mu) / YEAR - np.diag(cov_daily) / 2, np.asarray(weights, float)))

    def walk(ids):
        rng = Streams(seed, ids)
        lower, drift, w0 = chol.value
        held = np.tile(w0, (len(ids), 1))
        for _ in range(days):
            z = np.stack([rng.normal() for _ in range(len(w0))], axis=1)
            grow = np.exp(drift + z @ lower.T)
            if rebalance:
                yield lambda w: w * (grow @ w0)
            else:
                held *= grow
                yield lambda w: held.sum(axis=1)

    return _paths(spark, paths, walk)


def summarise(paths: DataFrame, cash: float = 1.0) -> DataFrame:
    """Moments, percentiles, loss probabilities, value at risk, and the mean of the worst twentieth of outcomes.

    Paths are read twice, so they are kept meanwhile; what is lost with an executor is simulated again, to the same numbers.
    """
    paths = paths.persist()
    try:
        return _summary(paths, cash)
    finally:
        paths.unpersist()


def _summary(paths: DataFrame, cash: float) -> DataFrame:
    w = F.col("terminal") * cash
    at, deep = (1, 5, 25, 50, 75, 95, 99), (50, 95, 99)
    every = lambda x, points: F.percentile(x, F.array(*[F.lit(p / 100) for p in points]))
    base = paths.agg(
        F.count("*").alias("paths"), F.avg(w).alias("mean"), F.stddev_samp(w).alias("std"), every(w, at).alias("ps"), every("max_drawdown", deep).alias("dds"),
        F.avg((F.col("terminal") < 1).cast("double")).alias("p_loss"), F.avg((F.col("terminal") < 0.9).cast("double")).alias("p_loss_10"), F.avg((F.col("terminal") < 0.8).cast("double")).alias("p_loss_20"))
    base = base.select("paths", "mean", "std", *[F.col("ps")[k].alias(f"p{p:02d}") for k, p in enumerate(at)], *[F.col("dds")[k].alias(f"dd{p:02d}") for k, p in enumerate(deep)], "p_loss", "p_loss_10", "p_loss_20")
    row = base.first().asDict()
    # the worst twentieth: all outcomes below its last one, and that one as often as it takes
    many, edge = math.ceil(row["paths"] * 0.05), row["p05"]
    below = w < F.lit(edge if edge is not None else 0.0)
    low = paths.agg(F.sum(F.when(below, w)).alias("s"), F.count(F.when(below, 1)).alias("c"), F.min(F.when(~below, w)).alias("next")).first()
    if row["paths"]:
        short = ((low.s or 0.0) + max(many - low.c, 0) * (low.next if many > low.c else 0.0)) / max(many, low.c)
        row |= {"var_95": (cash - edge) / cash, "cvar_95": (cash - short) / cash}
    else:
        row |= {"var_95": None, "cvar_95": None}
    kinds = ", ".join(f"{k} {'long' if k == 'paths' else 'double'}" for k in row)
    return paths.sparkSession.createDataFrame([tuple(row.values())], kinds)


def gbm_price_paths(spark: SparkSession, start: float, mu: float, sigma: float, days: int, paths: int, seed: int = 42) -> DataFrame:
    """(path, day, price): yearly drift and deviation, a row for each day from 0 on."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                ids = pdf["id"].to_numpy()[at : at + 256]
                rng, price = Streams(seed, ids), np.full((days + 1, len(ids)), float(start))
                for d in range(1, days + 1):
                    price[d] = price[d - 1] * np.exp((mu - sigma * sigma / 2) / YEAR + sigma / math.sqrt(YEAR) * rng.normal())
                yield pd.DataFrame({"path": np.tile(ids, days + 1), "day": np.repeat(np.arange(days + 1), len(ids)), "price": price.ravel()})

    return spark.range(0, paths, 1, min(paths, 2 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "path long, day long, price double")


def correlated_price_paths(spark: SparkSession, tickers: list[str], start: np.ndarray, mu: np.ndarray, cov_daily: np.ndarray, days: int, paths: int, seed: int = 42) -> DataFrame:
    """(path, day, ticker, price) of correlated assets."""
    data = spark.sparkContext.broadcast((cholesky(cov_daily), np.asarray(mu) / YEAR - np.diag(cov_daily) / 2, np.asarray(start, float)))

    def run(batches):
        lower, drift, first = data.value
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                ids = pdf["id"].to_numpy()[at : at + 64]
                rng, price = Streams(seed, ids), np.empty((days + 1, len(ids), len(first)))
                price[0] = first
                for d in range(1, days + 1):
                    z = np.stack([rng.normal() for _ in first], axis=1)
                    price[d] = price[d - 1] * np.exp(drift + z @ lower.T)
                shape = price.shape
                yield pd.DataFrame({"path": np.tile(np.repeat(ids, shape[2]), shape[0]), "day": np.repeat(np.arange(shape[0]), shape[1] * shape[2]), "ticker": np.tile(tickers, shape[0] * shape[1]), "price": price.ravel()})

    return spark.range(0, paths, 1, min(paths, 2 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "path long, day long, ticker string, price double")


def resampled_days(spark: SparkSession, returns: DataFrame, days: int, paths: int, block: float = 1.0, seed: int = 42) -> DataFrame:
    """(path, day, ticker, ret): every asset of a path takes the same drawn date. Dates are drawn, then joined with the returns."""
    dates = returns.select("date").distinct()
    order = dates.withColumn("pos", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))  # a row for each date
    n = dates.count()

    def draw(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                ids = pdf["id"].to_numpy()[at : at + 512]
                pos = Streams(seed, ids).blocks(n, days, block)
                yield pd.DataFrame({"path": np.repeat(ids, days), "day": np.tile(np.arange(days), len(ids)), "pos": pos.ravel()})

    drawn = spark.range(0, paths, 1, min(paths, 2 * spark.sparkContext.defaultParallelism)).mapInPandas(draw, "path long, day long, pos long")
    return drawn.join(order, "pos").join(returns, "date").select("path", "day", "ticker", "ret")
