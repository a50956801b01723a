"""Bars and indicators from a stream of ticks (ts, event_type, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tick_bars(ticks: DataFrame, width: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) bars by event type; ticks later than the watermark are dropped, repeated event ids counted once."""
    rows = ticks.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time zone
    rows = rows.withWatermark("ts", late) if ticks.isStreaming else rows
    rows = rows.dropDuplicatesWithinWatermark(["event_id"]) if ticks.isStreaming else rows.dropDuplicates(["event_id"])
    key = F.struct("ts", "event_id")
    out = rows.groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type").agg(F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").cast("double").alias("volume"))
    return out.select(F.col("event_type").alias("ticker"), F.col("window.start").alias("date"), "open", "high", "low", "close", "volume")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a user's ticks without a gap."""
    rows = ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if ticks.isStreaming else rows
    out = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("ticks"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "ticks", "total")


def streaming_ema(bars: DataFrame, period: int = 12) -> DataFrame:
    """The exponential average of each ticker's closes as bars arrive; the state is the average and the seed's sum and count."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, e = state.get if state.exists else (0, 0.0, 0.0)
        out = []
        for row in pd.concat(list(batches)).sort_values("date").itertuples(index=False):
            n, total = n + 1, total + row.close if n < period else total
            if n == period:
                e = total / period
            elif n > period:
                e += (row.close - e) * 2 / (period + 1)
            out.append((key[0], row.date, row.close, e if n >= period else None))
        state.update((n, total, e))
        yield pd.DataFrame(out, columns=["ticker", "date", "close", "ema"])

    return bars.select("ticker", "date", "close").groupBy("ticker").applyInPandasWithState(step, "ticker string, date timestamp, close double, ema double", "n long, total double, e double", "append", GroupStateTimeout.NoTimeout)
