"""Alignment of many assets on one timeline, and returns.

Timelines come from aggregates over dates, so that no asset is joined with another; the number of assets is a single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def by_ticker():
    """A window in the order of days, made when it is used: workers import this module without a session."""
    return Window.partitionBy("ticker").orderBy("date")


def intersection(bars: DataFrame) -> DataFrame:
    """Bars on the dates that every ticker has."""
    tickers = bars.agg(F.count_distinct("ticker").alias("tickers"))
    dates = bars.groupBy("date").agg(F.count_distinct("ticker").alias("n")).join(F.broadcast(tickers), F.col("n") == F.col("tickers")).select("date")  # one row broadcast
    return bars.join(dates, "date", "left_semi")


def timeline(bars: DataFrame) -> DataFrame:
    """(t, date): dates in order. The index counts inside ranges of dates, then adds what ranges before hold."""
    dates = bars.select("date").distinct()
    part = F.year("date")
    months = dates.groupBy(part.alias("y")).agg(F.count("*").alias("n"))
    offset = months.select("y", F.coalesce(F.sum("n").over(Window.orderBy("y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each year
    ranked = dates.select("date", part.alias("y"), (F.row_number().over(Window.partitionBy(part).orderBy("date")) - 1).alias("i"))
    return ranked.join(F.broadcast(offset), "y").select((F.col("before") + F.col("i")).cast("long").alias("t"), "date")


def forward_filled(bars: DataFrame) -> DataFrame:
    """A bar for every ticker on every date from its first on: the last one known, with volume 0 and is_filled, where it has none."""
    first = bars.groupBy("ticker").agg(F.min("date").alias("first"))
    dates = bars.select("date").distinct()
    grid = dates.join(first, dates["date"] >= first["first"]).select("ticker", "date")
    price = F.struct("open", "high", "low", "close")
    joined = grid.join(bars, ["ticker", "date"], "left")
    last = F.last(F.when(F.col("close").isNotNull(), price), ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    return joined.select("ticker", "date", last.alias("bar"), F.coalesce("volume", F.lit(0.0)).alias("volume"), F.col("close").isNull().alias("is_filled")).select("ticker", "date", "bar.*", "volume", "is_filled")


def sliced(panel: DataFrame, begin: int, end: int) -> DataFrame:
    """Rows whose place on the timeline is in [begin, end)."""
    if begin > end:
        raise ValueError("a slice begins after its end")
    return panel.join(timeline(panel), "date").where((F.col("t") >= begin) & (F.col("t") < end))


def closes_wide(bars: DataFrame, tickers: list[str]) -> DataFrame:
    return bars.groupBy("date").pivot("ticker", tickers).agg(F.first("close"))


def previous(c: str = "close", n: int = 1) -> Column:
    return F.lag(c, n).over(by_ticker())


def simple_returns(bars: DataFrame) -> DataFrame:
    return bars.select("ticker", "date", (F.col("close") / previous() - 1).alias("ret")).where("ret is not null")


def log_returns(bars: DataFrame) -> DataFrame:
    return bars.select("ticker", "date", F.ln(F.col("close") / previous()).alias("ret")).where("ret is not null")


def aligned_returns(panel: DataFrame, log: bool = False) -> DataFrame:
    """Returns on an aligned panel, 0 where a price is missing or not positive."""
    before, now = previous(), F.col("close")
    good = (before > 0) & (now > 0) if log else before > 0
    value = F.ln(now / before) if log else (now - before) / before
    rows = panel.select("ticker", "date", F.when(F.coalesce(good, F.lit(False)), value).otherwise(0.0).alias("ret"), F.row_number().over(by_ticker()).alias("n"))
    return rows.where("n > 1").drop("n")


def dedupe_first(rows: DataFrame, order: str) -> DataFrame:
    """The first row, by ``order``, of each ticker and date."""
    first = F.row_number().over(Window.partitionBy("ticker", "date").orderBy(order))
    return rows.withColumn("nth", first).where("nth = 1").drop("nth")
