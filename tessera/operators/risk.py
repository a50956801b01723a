"""Risk and performance measures as aggregates by ticker (or run) over a column ``ret``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import cagr, calmar, cornish_fisher, normal_pdf, normal_quantile

YEAR = 252.0


def _or0(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def mean(x: str = "ret") -> Column:
    return _or0(F.avg(x))


def std(x: str = "ret") -> Column:
    return _or0(F.stddev_samp(x))


def volatility(x: str = "ret") -> Column:
    return std(x) * F.sqrt(F.lit(YEAR))


def sharpe(x: str = "ret", rf: float = 0.02) -> Column:
    vol = volatility(x)
    return F.when((F.count(x) < 2) | (vol <= 1e-9), 0.0).otherwise(F.try_divide(mean(x) * YEAR - rf, vol))


def sortino(x: str = "ret", mar: float = 0.0) -> Column:
    below = F.least(F.lit(0.0), F.col(x) - mar / YEAR)
    down = F.sqrt(F.avg(below * below)) * F.sqrt(F.lit(YEAR))
    return F.when((F.count(x) < 2) | (down <= 1e-9), 0.0).otherwise(F.try_divide(mean(x) * YEAR - mar, down))


def skewness(x: str = "ret") -> Column:
    """Adjusted Fisher-Pearson; Spark's own is that of a population."""
    n = F.count(x)
    return F.when((n < 3) | (std(x) <= 1e-9), 0.0).otherwise(F.skewness(x) * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0)))


def excess_kurtosis(x: str = "ret") -> Column:
    n = F.count(x)
    return F.when((n < 4) | (std(x) <= 1e-9), 0.0).otherwise((n - 1.0) / F.nullif((n - 2.0) * (n - 3.0), F.lit(0.0)) * ((n + 1.0) * F.kurtosis(x) + 6.0))


def moments(returns: DataFrame, key: str = "ticker", rf: float = 0.02) -> DataFrame:
    return returns.groupBy(key).agg(F.count("ret").alias("n"), mean().alias("mean"), std().alias("std"), volatility().alias("volatility"), sharpe(rf=rf).alias("sharpe"), sortino().alias("sortino"), skewness().alias("skew"), excess_kurtosis().alias("kurtosis"))


def historical_var(returns: DataFrame, confidence: float = 0.95, key: str = "ticker") -> DataFrame:
    """The loss at index floor((1 - confidence) n) of the returns in order, and the mean of all up to it."""
    n = F.count("ret").over(Window.partitionBy(key))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("ret"))
    index = F.floor(F.lit(1 - confidence) * n + 1e-9)
    tail = returns.withColumn("rank", rank).withColumn("last", F.least(index, n - 1) + 1).where("rank <= last")
    return tail.groupBy(key).agg((-F.max("ret")).alias("var"), (-F.avg("ret")).alias("cvar"))


def parametric_var(returns: DataFrame, confidence: float = 0.95, key: str = "ticker") -> DataFrame:
    """Gaussian and Cornish-Fisher value at risk and expected shortfall."""
    alpha = 1 - confidence
    m = moments(returns, key)
    z = normal_quantile(F.lit(confidence))
    zc = F.when(F.col("n") < 4, z).otherwise(-cornish_fisher(-z, "skew", "kurtosis"))
    few = F.col("n") < 2
    value = lambda q: F.when(few, 0.0).otherwise(-F.col("mean") + q * F.col("std"))
    short = lambda q: F.when(few, 0.0).otherwise(-F.col("mean") + F.col("std") * normal_pdf(q) / alpha)
    return m.select(key, value(z).alias("var_gauss"), short(z).alias("cvar_gauss"), value(zc).alias("var_cf"), short(zc).alias("cvar_cf"))


def drawdown_details(curve: DataFrame, value: str = "close", key: str = "ticker") -> DataFrame:
    """Deepest fall from a running peak: its size, the places of peak, trough and recovery, and the longest time under water."""
    order = Window.partitionBy(key).orderBy("date")
    rows = curve.withColumn("i", (F.row_number().over(order) - 1).cast("long")).withColumn("peak", F.max(value).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("dd", F.when(F.col("peak") > 0, (F.col("peak") - F.col(value)) / F.col("peak")).otherwise(0.0)).withColumn("new_peak", (F.col(value) >= F.col("peak")).cast("int"))
    island = F.sum("new_peak").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("island", island).withColumn("peak_i", F.max(F.when(F.col("new_peak") == 1, F.col("i"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    worst = rows.groupBy(key).agg(F.max("dd").alias("max_drawdown"), F.min(F.struct((-F.col("dd")).alias("d"), F.col("i").alias("i"), F.col("peak_i").alias("p"), F.col("peak").alias("v"))).alias("w"))
    under = rows.where("new_peak = 0").groupBy(key, "island").agg(F.count("*").alias("days")).groupBy(key).agg(F.max("days").alias("longest"))
    again = rows.join(worst, key).where((F.col("i") > F.col("w.i")) & (F.col(value) >= F.col("w.v"))).groupBy(key).agg(F.min("i").alias("back"))
    none = F.col("max_drawdown") <= 0
    out = worst.join(under, key, "left").join(again, key, "left")
    return out.select(key, "max_drawdown", F.when(none, 0).otherwise(F.col("w.p")).cast("long").alias("peak_index"), F.when(none, 0).otherwise(F.col("w.i")).cast("long").alias("trough_index"), F.when(none, 0).otherwise(F.coalesce("back", "w.i")).cast("long").alias("recovery_index"), F.coalesce("longest", F.lit(0)).cast("long").alias("longest_underwater"))


def performance(returns: DataFrame, key: str = "ticker", rf: float = 0.02, order: str = "date") -> DataFrame:
    """Compounded return, the deepest fall of wealth that starts at 1, Sharpe, days, growth a year and Calmar."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.withColumn("wealth", F.product(1 + F.col("ret")).over(w)).withColumn("peak", F.greatest(F.lit(1.0), F.max("wealth").over(w)))
    out = rows.groupBy(key).agg((F.max_by("wealth", order) - 1).alias("total_return"), F.max((F.col("peak") - F.col("wealth")) / F.col("peak")).alias("max_drawdown"), sharpe(rf=rf).alias("sharpe"), F.count("*").alias("days"))
    growth = cagr("total_return", F.col("days") / YEAR)
    return out.withColumn("cagr", growth).withColumn("calmar", calmar("cagr", "max_drawdown"))


def trade_metrics(fills: DataFrame, key: str = "run_id") -> DataFrame:
    """Counts and profits of fills that close positions."""
    closed = F.col("closes_position")
    pnl = F.when(closed, F.col("realized_pnl"))
    won, lost = F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)), F.coalesce(-F.sum(F.when(pnl < 0, pnl)), F.lit(0.0))
    n, wins = F.count(pnl), F.count(F.when(pnl > 0, 1))
    return fills.groupBy(key).agg(
        F.count("*").alias("fills"), n.alias("closed_trades"), wins.alias("winning"), F.coalesce(F.try_divide(wins.cast("double"), n), F.lit(0.0)).alias("win_rate"),
        F.when(lost > 0, F.try_divide(won, lost)).when(won > 0, float("inf")).otherwise(0.0).alias("profit_factor"), F.coalesce(F.avg(pnl), F.lit(0.0)).alias("average_pnl"),
        F.greatest(F.lit(0.0), F.coalesce(F.max(pnl), F.lit(0.0))).alias("largest_win"), F.least(F.lit(0.0), F.coalesce(F.min(pnl), F.lit(0.0))).alias("largest_loss"))


def cost_totals(fills: DataFrame, key: str = "run_id") -> DataFrame:
    return fills.groupBy(key).agg(F.sum("commission").alias("commissions"), F.sum(F.col("slippage") * F.col("quantity")).alias("slippage_cost"), F.sum("spread_cost").alias("spread_cost"))


def exposure(curve: DataFrame, key: str = "run_id") -> DataFrame:
    return curve.groupBy(key).agg(F.avg((F.abs("positions_value") > 1e-9).cast("double")).alias("exposure"))


def percentiles(rows: DataFrame, x: str, at: list[float], key: str) -> DataFrame:
    """Exact, linear between neighbours."""
    return rows.groupBy(key).agg(*[F.percentile(x, p).alias(f"p{round(p * 100):02d}") for p in at])


def autocovariances(returns: DataFrame, lags: int, key: str = "ticker") -> DataFrame:
    """Sum of products of centred returns ``lag`` apart, over n; a window function for each lag, one shuffle in all."""
    w = Window.partitionBy(key)
    rows = returns.withColumn("c", F.col("ret") - F.avg("ret").over(w))
    order = w.orderBy("date")
    one = rows.select(key, "c", *[F.lag("c", k).over(order).alias(f"c{k}") for k in range(1, lags + 1)]).groupBy(key).agg(F.count("*").alias("n"), *[F.sum(F.col("c") * F.col(f"c{k}" if k else "c")).alias(f"s{k}") for k in range(lags + 1)])
    return one.select(key, "n", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"s{k}") / F.col("n")).alias("autocovariance")) for k in range(lags + 1)])).alias("x")).select(key, "x.lag", "x.autocovariance")
