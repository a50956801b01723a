"""The engine for notebooks: load a universe, pick strategies, run and measure."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import COSTS, scale_costs
from .operators import backtest as bt
from .operators import panel, significance
from .plans import sweeps
from .sources import files


@dataclass(frozen=True)
class CostModel:
    per_share: float = COSTS["per_share"]
    min_ticket: float = COSTS["min_ticket"]
    pct: float = COSTS["pct"]
    slip_bps: float = COSTS["slip_bps"]
    spread_bps: float = COSTS["spread_bps"]
    eta: float = COSTS["eta"]
    impact: bool = True
    participation: float = 0.0
    borrow: float = 0.0

    @staticmethod
    def free() -> CostModel:
        return CostModel(0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False)

    def scaled(self, by: float) -> CostModel:
        return CostModel(**scale_costs(self.__dict__, by))


class Universe:
    """Bars of many tickers on one timeline."""

    def __init__(self, bars: DataFrame, align: str = "intersection"):
        if align not in ("intersection", "union"):
            raise ValueError("align is 'intersection' or 'union'")
        self.raw = bars
        self.bars = (panel.intersection(bars) if align == "intersection" else panel.forward_filled(bars)).cache()

    def tickers(self) -> list[str]:
        return [r.ticker for r in self.bars.select("ticker").distinct().orderBy("ticker").collect()]

    def dates(self) -> DataFrame:
        return panel.timeline(self.bars)

    def closes(self) -> DataFrame:
        return panel.closes_wide(self.bars, self.tickers()).orderBy("date")

    def returns(self) -> DataFrame:
        return panel.aligned_returns(self.bars)

    def slice(self, begin: int, end: int) -> DataFrame:
        return panel.sliced(self.bars, begin, end)

    def __len__(self) -> int:
        return self.bars.select("date").distinct().count()


def load_universe(spark: SparkSession, path: str, align: str = "intersection", least: int = 60) -> Universe:
    universe = Universe(files.read_bars(spark, path), align)
    if len(universe) < least:
        raise ValueError(f"fewer than {least} aligned bars")
    return universe


def _checked(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def buy_and_hold(ticker: str, allocation: float = 0.99) -> tuple:
    _checked(0 < allocation <= 1, "an allocation is above 0 and at most 1")
    return "buy_and_hold", {"ticker": ticker, "allocation": allocation}


def sma_crossover(ticker: str, fast: int = 20, slow: int = 50, allocation: float = 0.95) -> tuple:
    _checked(0 < fast < slow, "the fast period is above 0 and below the slow one")
    _checked(0 < allocation <= 1, "an allocation is above 0 and at most 1")
    return "sma_crossover", {"ticker": ticker, "fast": fast, "slow": slow, "allocation": allocation}


def rsi_reversion(ticker: str, period: int = 14, low: float = 30, high: float = 70, allocation: float = 0.95) -> tuple:
    _checked(period > 0 and 0 <= low < high <= 100, "a period is above 0, and 0 <= low < high <= 100")
    return "rsi_reversion", {"ticker": ticker, "period": period, "low": low, "high": high, "allocation": allocation}


def momentum(lookback: int = 60, every: int = 20, top: int = 2, invested: float = 0.95, absolute: bool = False, spells: list | None = None) -> tuple:
    _checked(lookback > 0 and every > 0 and top > 0, "periods and the number of winners are above 0")
    return "momentum", {"lookback": lookback, "every": every, "top": top, "invested": invested, "absolute": absolute, "spells": spells}


def vol_target(ticker: str, target: float = 0.10, window: int = 20, most: float = 1.0, threshold: float = 0.05) -> tuple:
    _checked(target > 0 and window > 1, "a target is above 0, a window above 1")
    return "vol_target", {"ticker": ticker, "target": target, "window": window, "most": most, "threshold": threshold}


class Backtests:
    """Runs of one universe, computed once and kept."""

    def __init__(self, runs: DataFrame, rf: float):
        self.runs, self.rf = runs.cache(), rf

    def summary(self) -> DataFrame:
        return bt.summaries(self.runs, self.rf)

    def fills(self) -> DataFrame:
        return bt.fills(self.runs)

    def equity_curve(self) -> DataFrame:
        return bt.curves(self.runs)

    def returns(self) -> DataFrame:
        return bt.curve_returns(self.runs)


def backtest(universe: Universe, strategies: dict[str, tuple] | tuple, cash: float = 100_000.0, costs: CostModel | None = None, next_open: bool = True, rf: float = 0.02) -> Backtests:
    """One strategy, or many by name, in one job."""
    named = {"run": strategies} if isinstance(strategies, tuple) else strategies
    _checked(cash > 0, "cash is above 0")
    rows = [(name, kind, json.dumps(args), float(cash), json.dumps((costs or CostModel()).__dict__), next_open, None, None, 0, False) for name, (kind, args) in named.items()]
    return Backtests(bt.run_backtests(universe.bars, sweeps.configs(universe.bars.sparkSession, rows)), rf)


def sma_sweep(universe: Universe, ticker: str, fast=sweeps.FAST, slow=sweeps.SLOW, **common) -> DataFrame:
    return sweeps.sma_sweep(universe.bars, ticker, fast, slow, **common)


def walk_forward(universe: Universe, ticker: str, **options) -> tuple[DataFrame, DataFrame]:
    return sweeps.walk_forward(universe.bars, ticker, **options)


def bootstrap_sharpe(spark: SparkSession, returns: DataFrame, order: str = "date", **options) -> DataFrame:
    x = significance.series(returns, order)
    return significance.bootstrap_summary(significance.bootstrap_sharpe(spark, x, **options), "sharpe", float(significance.sharpe_of(x, options.get("rf", 0.02))))


def buy_and_hold_sharpe(universe: Universe, ticker: str, rf: float = 0.02) -> float:
    from .operators.risk import sharpe

    return universe.returns().where(F.col("ticker") == ticker).agg(sharpe(rf=rf)).first()[0]
