"""Many backtests as one job: grids, walk-forward folds, cost and capacity levels are rows of a configuration table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import COSTS, scale_costs
from ..operators.backtest import CONFIG, curve_returns, fills, run_backtests, summaries

FAST, SLOW = (5, 10, 15, 20, 30, 40, 50), (50, 75, 100, 125, 150, 200)
WALK_FAST, WALK_SLOW = (5, 10, 20, 30, 50), (50, 100, 150, 200)
LEVELS = (0.0, 0.5, 1.0, 2.0, 5.0, 10.0)
CAPITALS = (1e5, 1e6, 1e7, 1e8, 1e9)


def config(run_id: str, strategy: str, cash: float = 1e5, costs: dict | None = None, next_open: bool = True, begin: int | None = None, end: int | None = None, warmup: int = 0, carry: bool = False, **args) -> tuple:
    return (run_id, strategy, json.dumps(args), float(cash), json.dumps(costs or {}), next_open, begin, end, warmup, carry)


def configs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, CONFIG)


def tournament(ticker: str, **common) -> list[tuple]:
    return [
        config("buy_and_hold", "buy_and_hold", ticker=ticker, **common), config("sma_crossover", "sma_crossover", ticker=ticker, **common),
        config("rsi_reversion", "rsi_reversion", ticker=ticker, **common), config("momentum", "momentum", **common), config("vol_target", "vol_target", ticker=ticker, **common)]


def grid(spark: SparkSession, fast=FAST, slow=SLOW) -> DataFrame:
    """(fast, slow, place) with fast < slow, in grid order."""
    f = spark.createDataFrame([(x, i) for i, x in enumerate(fast)], "fast int, fi int")
    s = spark.createDataFrame([(x, i) for i, x in enumerate(slow)], "slow int, si int")
    return f.join(F.broadcast(s), F.col("fast") < F.col("slow")).select("fast", "slow", (F.col("fi") * len(slow) + F.col("si")).alias("place"))


def sma_sweep(bars: DataFrame, ticker: str, fast=FAST, slow=SLOW, rf: float = 0.02, **common) -> DataFrame:
    """Results of each pair, best Sharpe first, ties in grid order."""
    spark = bars.sparkSession
    pairs = [(a, b, i * len(slow) + j) for i, a in enumerate(fast) for j, b in enumerate(slow) if a < b]
    runs = run_backtests(bars, configs(spark, [config(f"{a}/{b}", "sma_crossover", ticker=ticker, fast=a, slow=b, **common) for a, b, _ in pairs]))
    names = spark.createDataFrame([(f"{a}/{b}", a, b, p) for a, b, p in pairs], "run_id string, fast int, slow int, place int")
    out = summaries(runs, rf).join(F.broadcast(names), "run_id")
    return out.select("fast", "slow", "sharpe", "total_return", "max_drawdown", "fills", "place").orderBy(F.desc("sharpe"), "place")


def sweep_statistics(points: DataFrame, benchmark_sharpe: float) -> DataFrame:
    """Best, upper median and worst Sharpe, and how many pairs beat the benchmark."""
    held = F.sort_array(F.collect_list("sharpe"))  # a number for each pair of the grid
    return points.agg(F.count("*").alias("pairs"), F.max("sharpe").alias("best"), F.element_at(held, (F.floor(F.size(held) / 2) + 1).cast("int")).alias("median"), F.min("sharpe").alias("worst"), F.count(F.when(F.col("sharpe") > benchmark_sharpe, 1)).alias("beat_benchmark"))


def buy_and_hold_sharpe(bars: DataFrame, ticker: str, rf: float = 0.02, **common) -> float:
    """What a sweep's pairs are measured by."""
    run = run_backtests(bars, configs(bars.sparkSession, [config("hold", "buy_and_hold", ticker=ticker, **common)]))
    return summaries(run, rf).select("sharpe").first()[0]


def top_pairs(points: DataFrame, n: int = 5) -> DataFrame:
    return points.orderBy(F.desc("sharpe"), "place").limit(n)


def best_active(summary: DataFrame, passive: str = "buy_and_hold") -> DataFrame:
    """The run with the highest Sharpe ratio among those that don't just hold."""
    return summary.where(F.col("run_id") != passive).orderBy(F.desc("sharpe"), "run_id").limit(1)


def folds(spark: SparkSession, bars: int, train: int = 504, test: int = 126) -> DataFrame:
    """(fold, train_begin, train_end, test_begin, test_end), as long as a whole test window fits."""
    n = max(0, (bars - train) // test)
    at = F.col("id") * test
    return spark.range(n).select(F.col("id").alias("fold"), at.alias("train_begin"), (at + train).alias("train_end"), (at + train).alias("test_begin"), (at + train + test).alias("test_end"))


def walk_forward(bars: DataFrame, ticker: str, train: int = 504, test: int = 126, fast=WALK_FAST, slow=WALK_SLOW, carry: bool = False, rf: float = 0.02, **common) -> tuple[DataFrame, DataFrame]:
    """(folds with their chosen pair and results, out-of-sample returns in order): every fold's training sweep is one job, all test runs another."""
    spark = bars.sparkSession
    n = bars.select("date").distinct().count()
    plan = folds(spark, n, train, test).collect()  # a row for each fold
    pairs = [(a, b, i * len(slow) + j) for i, a in enumerate(fast) for j, b in enumerate(slow) if a < b]
    trials = run_backtests(bars, configs(spark, [config(f"{r.fold}/{a}/{b}/{p}", "sma_crossover", begin=r.train_begin, end=r.train_end, ticker=ticker, fast=a, slow=b, **common) for r in plan for a, b, p in pairs]))
    part = lambda i: F.split("run_id", "/")[i].cast("int")
    ranked = summaries(trials, rf).select(part(0).alias("fold"), part(1).alias("fast"), part(2).alias("slow"), part(3).alias("place"), F.col("sharpe").alias("is_sharpe"))
    best = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("is_sharpe"), "place"))).where("rank = 1").drop("rank", "place")
    chosen = {r.fold: r for r in best.collect()}  # a row for each fold
    rows = []
    for r in plan:
        c = chosen[r.fold]
        rows.append(config(f"{r.fold}/test", "sma_crossover", begin=r.test_begin, end=r.test_end, warmup=max(slow), carry=carry, ticker=ticker, fast=c.fast, slow=c.slow, **common))
        rows.append(config(f"{r.fold}/hold", "buy_and_hold", begin=r.test_begin, end=r.test_end, ticker=ticker, **common))
    tests = run_backtests(bars, configs(spark, rows))
    told = summaries(tests, rf).select(part(0).alias("fold"), F.split("run_id", "/")[1].alias("kind"), "sharpe", "total_return", "max_drawdown")
    oos = told.where("kind = 'test'").select("fold", F.col("sharpe").alias("oos_sharpe"), F.col("total_return").alias("oos_return"), F.col("max_drawdown").alias("oos_max_drawdown"))
    hold = told.where("kind = 'hold'").select("fold", F.col("total_return").alias("benchmark_return"))
    table = spark.createDataFrame([(r.fold, r.train_begin, r.train_end, r.test_begin, r.test_end, chosen[r.fold].fast, chosen[r.fold].slow, chosen[r.fold].is_sharpe) for r in plan], "fold int, train_begin int, train_end int, test_begin int, test_end int, fast int, slow int, is_sharpe double")
    stitched = curve_returns(tests).where("run_id like '%/test'").select(part(0).alias("fold"), "date", "ret")
    return table.join(oos, "fold").join(hold, "fold"), stitched


def walk_forward_sweep(bars: DataFrame, ticker: str, train: int = 504, test: int = 126, fast=WALK_FAST, slow=WALK_SLOW, rf: float = 0.02, **common) -> DataFrame:
    """A fold summary for each feasible window around the defaults, with positions dropped and carried between folds.

    All windows' training sweeps are one job, all their tests another, as in ``walk_forward``.
    """
    spark = bars.sparkSession
    n = bars.select("date").distinct().count()
    windows = [(x, y) for x, y in ((int(train * i), int(test * j)) for i in (1, 0.5, 1.5) for j in (1, 0.5, 1.5)) if x + y <= n]
    if not windows:
        raise ValueError("no window fits the bars")
    plan = [(w, k, k * y, k * y + x, k * y + x + y) for w, (x, y) in enumerate(windows) for k in range((n - x) // y)]  # (window, fold, begin, cut, end)
    pairs = [(f, g, i * len(slow) + j) for i, f in enumerate(fast) for j, g in enumerate(slow) if f < g]
    trials = run_backtests(bars, configs(spark, [config(f"{w}/{k}/{f}/{g}/{p}", "sma_crossover", begin=begin, end=cut, ticker=ticker, fast=f, slow=g, **common) for w, k, begin, cut, _ in plan for f, g, p in pairs]))
    part = lambda i: F.split("run_id", "/")[i].cast("int")
    ranked = summaries(trials, rf).select(part(0).alias("w"), part(1).alias("fold"), part(2).alias("fast"), part(3).alias("slow"), part(4).alias("place"), F.col("sharpe").alias("is_sharpe"))
    best = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("w", "fold").orderBy(F.desc("is_sharpe"), "place"))).where("rank = 1")
    chosen = {(r.w, r.fold): r for r in best.collect()}  # a row for each fold
    rows = []
    for w, k, _, cut, end in plan:
        c = chosen[w, k]
        rows += [config(f"{w}/{k}/{carry}", "sma_crossover", begin=cut, end=end, warmup=max(slow), carry=carry, ticker=ticker, fast=c.fast, slow=c.slow, **common) for carry in (False, True)]
        rows.append(config(f"{w}/{k}/hold", "buy_and_hold", begin=cut, end=end, ticker=ticker, **common))
    told = summaries(run_backtests(bars, configs(spark, rows)), rf).select(part(0).alias("w"), part(1).alias("fold"), F.split("run_id", "/")[2].alias("kind"), "sharpe", "total_return")
    hold = told.where("kind = 'hold'").select("w", "fold", F.col("total_return").alias("benchmark_return"))
    sizes = spark.createDataFrame([(w, k, *windows[w], float(chosen[w, k].is_sharpe)) for w, k, *_ in plan], "w int, fold int, train int, test int, is_sharpe double")
    table = told.where("kind <> 'hold'").join(hold, ["w", "fold"]).join(sizes, ["w", "fold"])
    return table.withColumn("carried", F.col("kind") == "True").groupBy("train", "test", "carried").agg(*_fold_means(F.col("sharpe"), F.col("total_return")))


def _fold_means(oos_sharpe, oos_return) -> list:
    return [F.count("*").alias("folds"), F.avg("is_sharpe").alias("mean_is_sharpe"), F.avg(oos_sharpe).alias("mean_oos_sharpe"), F.avg(oos_return).alias("mean_oos_return"), F.count(F.when(oos_return > F.col("benchmark_return"), 1)).alias("beat_benchmark")]


def fold_summary(table: DataFrame) -> DataFrame:
    return table.agg(*_fold_means(F.col("oos_sharpe"), F.col("oos_return")))


def first_crossing(points: DataFrame, key: str, x: str, y: str, target: float, log_x: bool = False) -> DataFrame:
    """Where y first falls from above the target to it or below, linear (or log-linear) between points; NULL if it never does."""
    order = Window.partitionBy(key).orderBy(x)
    at = F.ln(x) if log_x else F.col(x)
    rows = points.withColumn("x0", F.lag(at).over(order)).withColumn("y0", F.lag(y).over(order)).withColumn("first", F.first(x).over(order))
    cross = F.col("x0") + (F.col("y0") - target) / (F.col("y0") - F.col(y)) * (at - F.col("x0"))
    hit = (F.col("y0") > target) & (F.col(y) <= target)
    value = F.exp(cross) if log_x else cross
    return rows.withColumn("value", F.when(hit & ((F.col("first") > 0) if log_x else F.lit(True)), value)).groupBy(key).agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col(x))).alias("breakeven"))


def cost_sweep(bars: DataFrame, strategies: list[tuple], levels=LEVELS, rf: float = 0.02) -> DataFrame:
    """(strategy, multiplier, results...) at multiples of the costs."""
    spark = bars.sparkSession
    rows = [(f"{s[0]}@{m}", *s[1:4], json.dumps(scale_costs(COSTS | json.loads(s[4]), m)), *s[5:]) for s in strategies for m in sorted(levels)]
    out = summaries(run_backtests(bars, configs(spark, rows)), rf)
    return out.select(F.split("run_id", "@")[0].alias("strategy"), F.split("run_id", "@")[1].cast("double").alias("multiplier"), "sharpe", "total_return", "max_drawdown", "fills", (F.col("commissions") + F.col("slippage_cost") + F.col("spread_cost")).alias("costs"))


def cost_breakeven(sweep: DataFrame, target: float = 0.0, of: str = "total_return") -> DataFrame:
    """The multiple of the costs at which each strategy's result falls to the target."""
    return first_crossing(sweep, "strategy", "multiplier", of, target)


def capacity_breakeven(sweep: DataFrame, target: float = 0.0, of: str = "total_return") -> DataFrame:
    """The capital at which each strategy's result falls to the target, linear in its logarithm."""
    return first_crossing(sweep, "strategy", "capital", of, target, log_x=True)


def capacity_sweep(bars: DataFrame, strategies: list[tuple], capitals=CAPITALS, cap: float = 0.10, rf: float = 0.02) -> DataFrame:
    """(strategy, capital, results...) with a cap on the part of a bar's volume, set if there is none."""
    spark = bars.sparkSession
    rows = []
    for s in strategies:
        costs = json.loads(s[4])
        costs["participation"] = costs.get("participation") or cap
        rows += [(f"{s[0]}@{c}", *s[1:3], float(c), json.dumps(costs), *s[5:]) for c in sorted(capitals)]
    runs = run_backtests(bars, configs(spark, rows))
    peak = fills(runs).groupBy("run_id").agg(F.max("participation").alias("peak_participation"))
    out = summaries(runs, rf).join(peak, "run_id", "left")
    return out.select(F.split("run_id", "@")[0].alias("strategy"), F.split("run_id", "@")[1].cast("double").alias("capital"), "total_return", "sharpe", "max_drawdown", "fills", (F.col("commissions") + F.col("slippage_cost") + F.col("spread_cost")).alias("transaction_costs"), F.coalesce("peak_participation", F.lit(0.0)).alias("peak_participation"), F.col("capped").alias("capped_fills"))


def look_ahead_cost(bars: DataFrame, strategies: list[tuple], rf: float = 0.02) -> DataFrame:
    """What filling at the close that made the signal would add to each strategy's return."""
    spark = bars.sparkSession
    rows = [(f"{s[0]}@{k}", *s[1:5], k == "next", *s[6:]) for s in strategies for k in ("next", "same")]
    out = summaries(run_backtests(bars, configs(spark, rows)), rf).select(F.split("run_id", "@")[0].alias("strategy"), F.split("run_id", "@")[1].alias("fill"), "total_return")
    wide = out.groupBy("strategy").pivot("fill", ["next", "same"]).agg(F.first("total_return"))
    return wide.select("strategy", F.col("next").alias("next_open"), F.col("same").alias("same_close"), (F.col("same") - F.col("next")).alias("difference"))
