"""Bars from the driver's tables, and a validity check for any bars.

Bars have the columns ticker, date, open, high, low, close, volume; `lines` and `orders` are daily, `events` hourly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BAR = ("open", "high", "low", "close", "volume")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticker for each return flag; the close is the volume-weighted price, the open the previous close within the day's range."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    day = table(spark, sf_dir, "lineitem").where("l_quantity > 0").groupBy(F.col("l_returnflag").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(
        F.max(price).alias("high"), F.min(price).alias("low"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))
    return day.withColumn("open", F.when(before.isNull(), F.col("close")).otherwise(F.least(F.greatest(before, "low"), "high"))).select("ticker", "date", *BAR)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticker for each order priority; first and last price of a day by order key. Few dates are common to all tickers."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count("*").cast("double").alias("volume"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticker for each event type, by the hour (column ``date`` is a timestamp)."""
    key = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").alias("date")).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").cast("double").alias("volume"))


def finite(x: str) -> Column:
    return F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def is_valid() -> Column:
    """Prices finite and positive, high and low around open and close, volume finite and not negative."""
    prices = [finite(c) & (F.col(c) > 0) for c in ("open", "high", "low", "close")]
    ok = prices[0] & prices[1] & prices[2] & prices[3] & finite("volume") & (F.col("volume") >= 0)
    shape = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close"))
    return F.coalesce(ok & shape, F.lit(False))
