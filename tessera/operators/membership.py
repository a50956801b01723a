"""Point-in-time membership: spells (ticker, start_date, end_date), both ends inclusive, NULL for an open end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .panel import timeline



def _inside(date: Column) -> Column:
    return (date >= F.coalesce("start_date", F.lit("0001-01-01").cast("date"))) & (date <= F.coalesce("end_date", F.lit("9999-12-31").cast("date")))


def members(bars: DataFrame, spells: DataFrame) -> DataFrame:
    """Rows of tickers that are members on their date; all of them where there are no spells at all."""
    some = spells.limit(1).count()
    if not some:
        return bars
    s = spells.withColumnRenamed("ticker", "s_ticker")
    return bars.join(s, (F.col("ticker") == F.col("s_ticker")) & _inside(F.col("date")), "left_semi")


def not_members(bars: DataFrame, spells: DataFrame) -> DataFrame:
    s = spells.withColumnRenamed("ticker", "s_ticker")
    return bars.join(s, (F.col("ticker") == F.col("s_ticker")) & _inside(F.col("date")), "left_anti")


def members_on(spells: DataFrame, date: str) -> DataFrame:
    return spells.where(_inside(F.lit(date).cast("date"))).select("ticker").distinct().orderBy("ticker")


def spells_from_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots (date, ticker) to spells; one ends the day before the first snapshot that lacks the ticker."""
    dates = snapshots.select("date").distinct()
    # a row for each snapshot: the index of members, not of the rows of members
    order = dates.select("date", F.row_number().over(Window.orderBy("date")).alias("i"), F.lead("date").over(Window.orderBy("date")).alias("next"))
    rows = snapshots.distinct().join(order, "date")
    island = F.col("i") - F.row_number().over(Window.partitionBy("ticker").orderBy("i"))
    spans = rows.withColumn("island", island).groupBy("ticker", "island").agg(F.min("date").alias("start_date"), F.max_by("next", "i").alias("next"))
    return spans.select("ticker", "start_date", F.date_sub("next", 1).alias("end_date"))


def spells_from_changes(changes: DataFrame) -> DataFrame:
    """Changes (date, ticker, added boolean) to spells. Removed before ever added: the start is open; an add while a member is ignored."""
    order = Window.partitionBy("ticker").orderBy("date", F.col("added").cast("int"))
    rows = changes.withColumn("was", F.lag("added").over(order)).where("was is null or was <> added")
    rows = rows.withColumn("next", F.lead("date").over(order))
    opened = rows.where("added").select("ticker", F.col("date").alias("start_date"), F.date_sub("next", 1).alias("end_date"))
    early = rows.where("not added and was is null").select("ticker", F.lit(None).cast("date").alias("start_date"), F.date_sub("date", 1).alias("end_date"))
    return opened.unionByName(early)


def symbols(text: Column) -> Column:
    """A list such as "AAPL, 'MSFT'|brk.b" as upper-case symbols."""
    parts = F.transform(F.split(text, r"[,;|\s]+"), lambda x: F.upper(F.regexp_replace(x, "[\"']", "")))
    return F.filter(parts, lambda x: x != "")


def momentum_ranking(bars: DataFrame, lookback: int = 60, every: int = 20, top: int = 2, spells: DataFrame | None = None, absolute: bool = False) -> DataFrame:
    """(date, ticker, ret, rank) of the best on rebalance days, counted on the timeline of all tickers; ties by ticker.

    The price to compare with is the ticker's own on the day ``lookback`` places before; without one it isn't ranked.
    """
    days = timeline(bars)
    held = bars.select("ticker", "date", "close").join(days, "date")
    past = held.select("ticker", (F.col("t") + lookback).alias("t"), F.col("close").alias("past"))
    rows = held.where((F.col("t") >= lookback) & ((F.col("t") - lookback) % every == 0)).join(past, ["ticker", "t"]).where((F.col("past") > 0) & (F.col("close") > 0))
    rows = rows.withColumn("ret", F.col("close") / F.col("past") - 1)
    if spells is not None:
        rows = members(rows, spells)
    if absolute:
        rows = rows.where("ret > 0")
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("ret"), "ticker"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("date", "ticker", "ret", "rank")
