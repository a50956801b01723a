"""Technical indicators. Frames where a window function says it; a grouped map over a ticker's series for recursions.

Warm-up values are NULL. A ticker's daily series is small; tickers are what is spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .panel import by_ticker, previous


def last(n: int):
    return by_ticker().rowsBetween(-(n - 1), 0)


def _full(value: Column, n: int) -> Column:
    return F.when(F.row_number().over(by_ticker()) >= n, value)


def sma(period: int, c: str = "close") -> Column:
    if period < 1:
        raise ValueError("a period is at least 1")
    return _full(F.avg(c).over(last(period)), period)


def bollinger(period: int = 20, k: float = 2.0) -> dict[str, Column]:
    middle = sma(period)
    dev = F.coalesce(_full(F.stddev_samp("close").over(last(period)), period), F.when(middle.isNotNull(), 0.0))
    upper, lower = middle + k * dev, middle - k * dev
    width = upper - lower
    flat = width <= F.abs(middle) * 1e-12
    return {"middle": middle, "upper": upper, "lower": lower, "percent_b": F.when(flat, 0.5).otherwise(F.try_divide(F.col("close") - lower, width)), "bandwidth": F.try_divide(width, middle)}


def rolling_volatility(window: int = 20, annual: float = 252.0, log: bool = True) -> Column:
    """Needs a column ``ret`` with the return to each bar; a pair of prices without one counts as 0."""
    if window < 2:
        raise ValueError("a window is at least 2")
    return F.when(F.row_number().over(by_ticker()) > window, F.stddev_samp(F.coalesce("ret", F.lit(0.0))).over(last(window)) * F.sqrt(F.lit(annual)))


def true_range() -> Column:
    before = previous()
    return F.coalesce(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)), F.col("high") - F.col("low"))


def trailing_return(n: int) -> Column:
    return F.col("close") / previous("close", n) - 1


# recursions, as functions of a series


def smoothed(x: np.ndarray, period: int, rate: float, start: int = 0) -> np.ndarray:
    """The mean of the first ``period`` numbers from ``start`` on, then moves towards each next one by ``rate``."""
    out = np.full(len(x), np.nan)
    at = start + period - 1
    if period < 1:
        raise ValueError("a period is at least 1")
    if len(x) <= at:
        return out
    e = out[at] = x[start : at + 1].mean()
    for i in range(at + 1, len(x)):
        e += (x[i] - e) * rate
        out[i] = e
    return out


def ema(x: np.ndarray, period: int, smoothing: float = 2.0, start: int = 0) -> np.ndarray:
    return smoothed(x, period, smoothing / (period + 1), start)


def rsi(x: np.ndarray, period: int = 14) -> np.ndarray:
    change = np.diff(x, prepend=x[:1])
    up, down = (smoothed(np.maximum(s * change, 0.0), period, 1 / period, 1) for s in (1, -1))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 100 - 100 / (1 + up / down)
    return np.where(down == 0, np.where(up == 0, 50.0, 100.0), out) if len(x) > period else np.full(len(x), np.nan)


def macd(x: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if fast >= slow:
        raise ValueError("the fast period is shorter than the slow one")
    line = ema(x, fast) - ema(x, slow)
    sig = ema(line, signal, start=slow - 1)
    return line, sig, line - sig


def atr(tr: np.ndarray, period: int = 14) -> np.ndarray:
    return smoothed(tr, period, 1 / period) if len(tr) > period else np.full(len(tr), np.nan)


def _null(x: np.ndarray) -> pd.Series:
    return pd.Series(x, dtype=object).where(~np.isnan(x), None)


def recursive(bars: DataFrame, names: dict[str, tuple]) -> DataFrame:
    """Bars with columns such as {"ema12": ("ema", 12)}; kinds: ema, rsi, macd, macd_signal, macd_hist, atr."""
    rows = bars.withColumn("tr", true_range())
    schema = ", ".join(["ticker string", f"date {dict(bars.dtypes)['date']}", *(f"{n} double" for n in names)])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", ignore_index=True)
        x, out = pdf["close"].to_numpy(float), pdf[["ticker", "date"]].copy()
        for name, (kind, *args) in names.items():
            if kind.startswith("macd"):
                value = macd(x, *args)[["macd", "macd_signal", "macd_hist"].index(kind)]
            elif kind == "atr":
                value = atr(pdf["tr"].to_numpy(float), *args)
            else:
                value = {"ema": ema, "rsi": rsi}[kind](x, *args)
            out[name] = _null(value)
        return out

    return rows.select("ticker", "date", "close", "tr").groupBy("ticker").applyInPandas(one, schema)


def crossovers(bars: DataFrame, fast: int = 20, slow: int = 50) -> DataFrame:
    """Days on which the fast average crosses the slow one: 1 upwards, -1 downwards."""
    rows = bars.select("ticker", "date", "close", sma(fast).alias("fast"), sma(slow).alias("slow"))
    f0, s0 = F.lag("fast").over(by_ticker()), F.lag("slow").over(by_ticker())
    signal = F.when((f0 <= s0) & (F.col("fast") > F.col("slow")), 1).when((f0 >= s0) & (F.col("fast") < F.col("slow")), -1)
    return rows.withColumn("signal", signal).where("signal is not null")


def drawdowns(curve: DataFrame, value: str = "close") -> DataFrame:
    peak = F.max(value).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    return curve.select("ticker", "date", value, peak.alias("peak"), ((peak - F.col(value)) / peak).alias("drawdown"))
