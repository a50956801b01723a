"""Market regimes of a price series, and strategy results by regime."""

from __future__ import annotations

from bisect import insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .indicators import last, trailing_return
from .panel import previous
from .risk import sharpe

BUCKETS = ("All", "Bull", "Bear", "TrendUnknown", "LowVol", "MidVol", "HighVol", "VolUnknown")
YEAR = 252.0


def _with_cuts(rows: DataFrame, least: int) -> DataFrame:
    """Adds low_cut and high_cut: a third and two thirds of the way up a ticker's volatilities so far, linear between neighbours.

    A percentile over a frame that grows is made anew for every row; here each ticker's values are kept in order as they come.
    """
    day = dict(rows.dtypes)["date"]
    schema = f"ticker string, date {day}, trailing_return double, realized_vol double, low_cut double, high_cut double"

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("date")
        seen, cuts = [], ([], [])
        for v in table["realized_vol"].to_pylist():
            if v is not None:
                insort(seen, v)
            for p, out in zip((1 / 3, 2 / 3), cuts):
                at = p * (len(seen) - 1)
                k = int(at)
                out.append(None if v is None or len(seen) < least else seen[k] + (at - k) * (seen[min(k + 1, len(seen) - 1)] - seen[k]))
        return table.append_column("low_cut", pa.array(cuts[0], pa.float64())).append_column("high_cut", pa.array(cuts[1], pa.float64()))

    return rows.select("ticker", "date", "trailing_return", "realized_vol").groupBy("ticker").applyInArrow(one, schema)


def classify(bars: DataFrame, trend: int = 200, window: int = 21, least: int = 252) -> DataFrame:
    """A trend by the trailing return, a volatility class by terciles of all volatilities so far (today's among them)."""
    good = (previous() > 0) & (F.col("close") > 0)
    rows = bars.select("ticker", "date", "close", trailing_return(trend).alias("trailing_return"), F.when(good, F.col("close") / previous() - 1).alias("ret"))
    vol = F.when(F.count("ret").over(last(window)) == window, F.stddev_samp("ret").over(last(window)) * F.sqrt(F.lit(YEAR)))
    rows = rows.withColumn("realized_vol", vol)
    rows = _with_cuts(rows, least)
    low, high = F.col("low_cut"), F.col("high_cut")
    return rows.select(
        "ticker", "date", F.when(F.col("trailing_return").isNull(), "TrendUnknown").when(F.col("trailing_return") > 0, "Bull").otherwise("Bear").alias("trend"),
        F.when(low.isNull(), "VolUnknown").when(F.col("realized_vol") <= low, "LowVol").when(F.col("realized_vol") >= high, "HighVol").otherwise("MidVol").alias("volatility"),
        "trailing_return", "realized_vol", "low_cut", "high_cut")


def breakdown(labels: DataFrame, returns: DataFrame, rf: float = 0.02) -> DataFrame:
    """Results by regime; a label holds for the return from its day to the next. Buckets without days are there too.

    Grouping sets aggregate all, each trend and each volatility class in one pass over the joined rows.
    """
    order = Window.partitionBy("ticker").orderBy("date")
    next_day = F.lead("date").over(order)
    tagged = labels.select("ticker", next_day.alias("date"), "trend", "volatility").where("date is not null")
    rows = returns.join(tagged, ["ticker", "date"])
    each = rows.select("ticker", "date", "ret", F.explode(F.array(F.lit("All"), "trend", "volatility")).alias("regime"))
    w = Window.partitionBy("ticker", "regime").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    wealth = each.withColumn("wealth", F.product(1 + F.col("ret")).over(w)).withColumn("peak", F.greatest(F.lit(1.0), F.max("wealth").over(w)))
    told = wealth.groupBy("ticker", "regime").agg(F.count("*").alias("days"), (F.max_by("wealth", "date") - 1).alias("total_return"), sharpe(rf=rf).alias("sharpe"), F.max((F.col("peak") - F.col("wealth")) / F.col("peak")).alias("max_drawdown"))
    dim = returns.select("ticker").distinct().select("ticker", F.explode(F.array(*[F.lit(b) for b in BUCKETS])).alias("regime"))
    out = dim.join(told, ["ticker", "regime"], "left")
    growth = F.when(F.col("total_return") <= -1, -1.0).otherwise(F.pow(1 + F.col("total_return"), YEAR / F.col("days")) - 1)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.withColumn("annualized_return", F.coalesce(growth, F.lit(0.0))).select("ticker", "regime", zero("days"), zero("total_return"), "annualized_return", zero("sharpe"), zero("max_drawdown"))


def counts(labels: DataFrame) -> DataFrame:
    """Days by trend, by volatility class, and in all: grouping sets."""
    labels.createOrReplaceTempView("tessera_regime_labels")
    return labels.sparkSession.sql("select ticker, trend, volatility, count(*) as days from tessera_regime_labels group by grouping sets ((ticker), (ticker, trend), (ticker, volatility))")


def rolling_sharpe(returns: DataFrame, window: int = 252, rf: float = 0.02) -> DataFrame:
    frame = last(window)
    vol = F.stddev_samp("ret").over(frame) * F.sqrt(F.lit(YEAR))
    value = F.when(vol <= 1e-9, 0.0).otherwise((F.avg("ret").over(frame) * YEAR - rf) / F.nullif(vol, F.lit(0.0)))
    return returns.select("ticker", "date", value.alias("sharpe"), F.count("ret").over(frame).alias("n")).where(F.col("n") == window).drop("n")


def rolling_summary(rolling: DataFrame, benchmark: str) -> DataFrame:
    """Windows, extremes, median, last value, and shares above 0 and above a benchmark ticker.

    The benchmark's ratios are looked up among the rows: computed a second time for a join, their sums could come in another
    order and differ in the last bits, and the benchmark would be above itself. A row without a date has no benchmark.
    """
    base = F.max(F.when(F.col("ticker") == benchmark, F.col("sharpe"))).over(Window.partitionBy("date"))
    rows = rolling.withColumn("bench", F.when(F.col("date").isNotNull(), base))
    return rows.groupBy("ticker").agg(F.count("*").alias("windows"), F.min("sharpe").alias("least"), F.median("sharpe").alias("median"), F.max("sharpe").alias("most"), F.max_by("sharpe", "date").alias("last"), F.avg((F.col("sharpe") > 0).cast("double")).alias("above_zero"), F.avg((F.col("sharpe") > F.col("bench")).cast("double")).alias("above_benchmark"))


def analyze(bars: DataFrame, returns: DataFrame, trend: int = 200, window: int = 21, least: int = 252, rolling: int = 252, rf: float = 0.02) -> dict[str, DataFrame]:
    """Labels of the bars, and of the returns their results by regime and the rolling Sharpe ratio."""
    labels = classify(bars, trend, window, least)
    return {"labels": labels, "breakdown": breakdown(labels, returns, rf), "rolling": rolling_sharpe(returns, rolling, rf)}
