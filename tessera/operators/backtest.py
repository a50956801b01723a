"""Event-driven backtests: a pure fold over the bars of a run, and Spark's part, many runs at once.

``simulate`` knows nothing of Spark. Runs are rows of a configuration table; a panel of bars whose size is checked is
broadcast and runs are spread over tasks, a larger one is joined to its runs and folded by group.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.scalar import COSTS
from .indicators import rsi

#: Rows of a panel that are broadcast; more are dealt by run.
MOST_BROADCAST_ROWS = 1_000_000
EPS = 1e-7


@dataclass
class Panel:
    """Prices by (day, ticker), NaN where there is none."""

    dates: list
    tickers: list[str]
    open: np.ndarray
    close: np.ndarray
    volume: np.ndarray

    @staticmethod
    def of(pdf: pd.DataFrame) -> Panel:
        wide = {c: pdf.pivot(index="date", columns="ticker", values=c).sort_index().sort_index(axis=1) for c in ("open", "close", "volume")}
        close = wide["close"]
        return Panel(list(close.index), list(close.columns), wide["open"].to_numpy(float), close.to_numpy(float), wide["volume"].fillna(0.0).to_numpy(float))

    def slice(self, a: int, b: int) -> Panel:
        return Panel(self.dates[a:b], self.tickers, self.open[a:b], self.close[a:b], self.volume[a:b])


@dataclass
class Account:
    cash: float
    quantity: np.ndarray
    average: np.ndarray
    equity: float  # as last marked

    def take(self, i: int, signed: float, price: float, fee: float) -> tuple[float, bool]:
        """Books a fill; (realised profit, whether it closes)."""
        held, closing = self.quantity[i], abs(self.quantity[i]) > EPS and self.quantity[i] * signed < 0
        self.cash -= signed * price + fee
        if not closing:
            total = held + signed if abs(held) > EPS else signed
            self.average[i] = (held * self.average[i] + signed * price) / total if abs(held) > EPS else price
            self.quantity[i] = total
            return 0.0, False
        pnl = min(abs(held), abs(signed)) * (price - self.average[i]) * math.copysign(1, held) - fee
        left = held + signed
        if abs(left) < EPS:
            left, self.average[i] = 0.0, 0.0
        elif left * held < 0:
            self.average[i] = price
        self.quantity[i] = left
        return pnl, True


@dataclass
class Order:
    ticker: int
    quantity: float  # above 0
    buy: bool
    id: int = 0


@dataclass
class Result:
    fills: list[dict] = field(default_factory=list)
    curve: list[tuple] = field(default_factory=list)
    rejected: int = 0
    capped: int = 0
    cancelled: int = 0
    unfilled: int = 0
    borrow: float = 0.0


class Strategy:
    """Sees the panel once, for signals that use the past alone; then decides bar by bar."""

    def start(self, panel: Panel) -> None:
        pass

    def decide(self, t: int, panel: Panel, account: Account) -> list[Order]:
        return []


def _rolling_mean(x: np.ndarray, n: int) -> np.ndarray:
    return pd.Series(x).rolling(n).mean().to_numpy()


class _Single(Strategy):
    def __init__(self, ticker: str, allocation: float):
        self.ticker, self.allocation = ticker, allocation

    def start(self, panel: Panel) -> None:
        self.i = panel.tickers.index(self.ticker)
        self.signal(panel.close[:, self.i])

    def signal(self, close: np.ndarray) -> None:
        pass

    def buy(self, price: float, account: Account) -> list[Order]:
        money = min(account.cash * 0.98, account.equity * self.allocation)
        shares = math.floor(money / price) if money > 100 and price > 0 else 0
        return [Order(self.i, float(shares), True)] if shares > 0 else []


class BuyAndHold(_Single):
    def __init__(self, ticker: str, allocation: float = 0.99):
        super().__init__(ticker, allocation)
        self.sent = None

    def decide(self, t, panel, account):
        price = panel.close[t, self.i]
        if not price > 0 or account.quantity[self.i] != 0 or (self.sent is not None and t <= self.sent + 1):
            return []
        shares = math.floor(account.equity * self.allocation / price)
        if shares <= 0:
            return []
        self.sent = t
        return [Order(self.i, float(shares), True)]


class SmaCrossover(_Single):
    def __init__(self, ticker: str, fast: int = 20, slow: int = 50, allocation: float = 0.95):
        super().__init__(ticker, allocation)
        self.fast, self.slow = fast, slow

    def signal(self, close):
        with np.errstate(invalid="ignore"):
            self.gap = _rolling_mean(close, self.fast) - _rolling_mean(close, self.slow)

    def decide(self, t, panel, account):
        if t == 0 or not panel.close[t, self.i] > 0 or math.isnan(self.gap[t - 1]) or math.isnan(self.gap[t]):
            return []
        held = account.quantity[self.i]
        if self.gap[t - 1] <= 0 < self.gap[t]:
            return self.buy(panel.close[t, self.i], account) if held <= 0 else []
        if self.gap[t - 1] >= 0 > self.gap[t] and held > 0:
            return [Order(self.i, held, False)]
        return []


class RsiReversion(_Single):
    def __init__(self, ticker: str, period: int = 14, low: float = 30, high: float = 70, allocation: float = 0.95):
        super().__init__(ticker, allocation)
        self.period, self.low, self.high = period, low, high

    def signal(self, close):
        self.rsi = rsi(close, self.period)

    def decide(self, t, panel, account):
        now, held = self.rsi[t], account.quantity[self.i]
        if math.isnan(now) or math.isnan(panel.close[t, self.i]):
            return []
        if now < self.low and held <= 0:
            return self.buy(panel.close[t, self.i], account)
        return [Order(self.i, held, False)] if now > self.high and held > 0 else []


class Momentum(Strategy):
    def __init__(self, lookback: int = 60, every: int = 20, top: int = 2, invested: float = 0.95, absolute: bool = False, spells: list | None = None):
        self.lookback, self.every, self.top, self.invested, self.absolute, self.spells = lookback, every, top, invested, absolute, spells

    def member(self, ticker: str, date) -> bool:
        if not self.spells:
            return True
        day = str(date)[:10]
        return any(k == ticker and (not a or a <= day) and (not b or day <= b) for k, a, b in self.spells)

    def decide(self, t, panel, account):
        if not self.every or not self.top or t < self.lookback or (t - self.lookback) % self.every:
            return []
        now, past = panel.close[t], panel.close[t - self.lookback]
        found = [(-(now[i] / past[i] - 1), k, i) for i, k in enumerate(panel.tickers) if now[i] > 0 and past[i] > 0 and self.member(k, panel.dates[t])]
        chosen = [i for r, _, i in sorted(found) if not self.absolute or r < 0][: self.top]
        out = [Order(i, abs(q), q < 0) for i, q in enumerate(account.quantity) if abs(q) > EPS and i not in chosen]
        for i in chosen:
            more = math.floor(account.equity * self.invested / len(chosen) / now[i]) - account.quantity[i]
            if abs(more) >= 1:
                out.append(Order(i, abs(more), more > 0))
        return out


class VolTarget(_Single):
    def __init__(self, ticker: str, target: float = 0.10, window: int = 20, most: float = 1.0, threshold: float = 0.05):
        super().__init__(ticker, 1.0)
        self.target, self.window, self.most, self.threshold = target, window, most, threshold

    def signal(self, close):
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.diff(np.log(close), prepend=np.nan)
        step[1:] = np.where(np.isfinite(step[1:]), step[1:], 0.0)
        self.sigma = pd.Series(step).rolling(self.window).std().to_numpy() * math.sqrt(252)

    def decide(self, t, panel, account):
        sigma, price = self.sigma[t], panel.close[t, self.i]
        if not sigma > 1e-9 or not price > 0 or account.equity <= 0:
            return []
        held = account.quantity[self.i]
        more = math.floor(min(self.most, self.target / sigma) * account.equity / price) - held
        if abs(more) * price < self.threshold * account.equity:
            return []
        n = min(more, math.floor(account.cash * 0.98 / price)) if more > 0 else min(-more, held)
        return [Order(self.i, float(n), more > 0)] if n > 0 else []


STRATEGIES = {"buy_and_hold": BuyAndHold, "sma_crossover": SmaCrossover, "rsi_reversion": RsiReversion, "momentum": Momentum, "vol_target": VolTarget}


def _price(costs: dict, price: float, quantity: float, volume: float, buy: bool) -> dict:
    half = price * costs["spread_bps"] * 1e-4 / 2
    slip = price * (costs["slip_bps"] * 1e-4 + (costs["eta"] * math.sqrt(quantity / volume) if costs["impact"] and volume > 0 else 0.0))
    done = price + half + slip if buy else max(price - half - slip, 0.0001)
    fee = max(costs["min_ticket"], quantity * costs["per_share"] + quantity * done * costs["pct"])
    return {"quantity": quantity, "price": price, "execution_price": done, "commission": fee, "slippage": slip, "spread_cost": half * quantity, "participation": quantity / volume if volume > 0 else 0.0}


def simulate(panel: Panel, strategy: Strategy, cash: float = 100_000.0, costs: dict = COSTS, next_open: bool = True, buffer: float = 0.995, start: int = 0) -> Result:
    """Orders of a bar fill at the next open (or at its close); sells before buys; costs, liquidity and cash limit fills."""
    n = len(panel.tickers)
    account, out = Account(cash, np.zeros(n), np.zeros(n), cash), Result()
    peak, ids, queue, carried = cash, 0, [], []
    strategy.start(panel)
    known = pd.DataFrame(panel.close).ffill().fillna(0.0).to_numpy()  # the last price known

    def execute(orders: list[Order], t: int, prices: np.ndarray) -> list[Order]:
        nonlocal ids
        left = []
        for o in sorted(orders, key=lambda o: o.buy):
            price, volume = prices[t, o.ticker], panel.volume[t, o.ticker]
            if o.quantity <= 0 or not (price > 0 and math.isfinite(price)):
                out.rejected += 1
                continue
            if not o.id:
                ids += 1
                o.id = ids
            capped = costs["participation"] > 0 and volume > 0 and math.floor(costs["participation"] * volume) < o.quantity
            quantity = float(math.floor(costs["participation"] * volume)) if capped else o.quantity
            rest = Order(o.ticker, o.quantity - quantity, o.buy, o.id)
            if quantity <= 0:
                left.append(rest)
                continue
            fill, short = _price(costs, price, quantity, volume, o.buy), False
            need = lambda f: f["quantity"] * f["execution_price"] + f["commission"]
            if o.buy and need(fill) > account.cash:
                short, quantity = True, float(math.floor(account.cash * buffer / fill["execution_price"]))
                while quantity > 0 and need(fill := _price(costs, price, quantity, volume, True)) > account.cash:
                    quantity -= 1
                if quantity <= 0:
                    out.rejected += 1
                    continue
            pnl, closes = account.take(o.ticker, fill["quantity"] if o.buy else -fill["quantity"], fill["execution_price"], fill["commission"])
            out.fills.append(fill | {"order_id": o.id, "date": panel.dates[t], "ticker": panel.tickers[o.ticker], "side": "BUY" if o.buy else "SELL", "realized_pnl": pnl, "closes_position": closes})
            if capped:
                out.capped += 1
                if not short:
                    left.append(rest)
        return left

    for t, date in enumerate(panel.dates):
        if next_open and queue:
            carried += execute(queue, t, panel.open)
            queue = []
        new = strategy.decide(t, panel, account) if t >= start else (strategy.decide(t, panel, account), [])[1]
        named = {o.ticker for o in new}
        kept = [o for o in carried if o.ticker not in named]
        out.cancelled += len(carried) - len(kept)
        batch, carried = kept + new, []
        if next_open:
            queue = batch
        else:
            carried = execute(batch, t, panel.close)
        if account.quantity.any():
            if costs["borrow"] > 0:
                close = panel.close[t]
                short = (account.quantity < -EPS) & ~np.isnan(close)
                fee = float((-account.quantity[short] * close[short]).sum()) * costs["borrow"] / 252
                account.cash -= fee
                out.borrow += fee
            value = float(account.quantity @ known[t])
        else:
            value = 0.0
        account.equity = account.cash + value
        peak = max(peak, account.equity)
        out.curve.append((date, account.equity, account.cash, value, (peak - account.equity) / peak if peak > 0 else 0.0))
    out.unfilled = len(queue) + len(carried)
    return out


def run_one(panel: Panel, config: dict) -> Result:
    """A run of a configuration: strategy, args, cash, costs, next_open, window [begin, end), warmup bars before it, carry."""
    begin, end = config.get("begin") or 0, config.get("end") or len(panel.dates)
    first = max(0, begin - (config.get("warmup") or 0))
    offset = begin - first
    strategy = STRATEGIES[config["strategy"]](**json.loads(config.get("args") or "{}"))
    costs = COSTS | json.loads(config.get("costs") or "{}")
    return simulate(panel.slice(first, end), strategy, config.get("cash") or 100_000.0, costs, config.get("next_open", True) is not False, start=0 if config.get("carry") else offset)


_FILL = "order_id long, date {d}, ticker string, side string, quantity double, price double, execution_price double, commission double, slippage double, spread_cost double, participation double, realized_pnl double, closes_position boolean"
_POINT = "date {d}, equity double, cash double, positions_value double, drawdown double"
CONFIG = "run_id string, strategy string, args string, cash double, costs string, next_open boolean, begin int, `end` int, warmup int, carry boolean"


def _schema(kind: str) -> str:
    return f"run_id string, fills array<struct<{_FILL.format(d=kind).replace(' ', ':').replace(',:', ', ')}>>, curve array<struct<{_POINT.format(d=kind).replace(' ', ':').replace(',:', ', ')}>>, rejected long, capped long, cancelled long, unfilled long, borrow double, offset int"


_COUNTERS = ("rejected", "capped", "cancelled", "unfilled", "borrow")


def _table(configs: list[dict], results: list[Result], schema: pa.Schema) -> pa.Table:
    """Runs as rows; the points of all curves stand in one array for each field."""
    point = schema.field("curve").type.value_type
    points = [x for r in results for x in r.curve]
    columns = [pa.array(x, f.type) for x, f in zip(zip(*points), point)] if points else [pa.array([], f.type) for f in point]
    edges = np.cumsum([0, *(len(r.curve) for r in results)])
    begins = [c.get("begin") or 0 for c in configs]
    made = {
        "run_id": [c["run_id"] for c in configs], "fills": [r.fills for r in results], **{k: [getattr(r, k) for r in results] for k in _COUNTERS},
        "offset": [b - max(0, b - (c.get("warmup") or 0)) for b, c in zip(begins, configs)]}
    made = {k: pa.array(v, schema.field(k).type) for k, v in made.items()}
    made["curve"] = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(point)), type=schema.field("curve").type)
    return pa.table([made[f.name] for f in schema], schema=schema)


def _clean(row: dict) -> dict:
    return {k: None if isinstance(v, float) and math.isnan(v) else v for k, v in row.items()}


def run_backtests(bars: DataFrame, configs: DataFrame, most_broadcast: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """One row for each run: its fills, equity curve and counters. ``configs`` has the columns of ``CONFIG``."""
    spark = bars.sparkSession
    panel = bars.select("ticker", "date", "open", "close", "volume")
    schema = _schema(dict(bars.dtypes)["date"])
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    some = panel.limit(most_broadcast + 1).toPandas()
    if len(some) <= most_broadcast:
        held = spark.sparkContext.broadcast(Panel.of(some))

        def spread(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 8):
                    some = [_clean(c) for c in batch.slice(at, 8).to_pylist()]
                    yield from _table(some, [run_one(held.value, c) for c in some], arrow).to_batches()

        n = max(1, min(configs.count(), 4 * spark.sparkContext.defaultParallelism))
        return configs.repartition(n).mapInArrow(spread, schema).persist()  # summaries read runs several times

    names = [c.split()[0].strip("`") for c in CONFIG.split(", ")]

    def fold(table: pa.Table) -> pa.Table:
        some = [_clean(table.select(names).slice(0, 1).to_pylist()[0])]
        return _table(some, [run_one(Panel.of(table.to_pandas(date_as_object=True)), some[0])], arrow)

    return panel.join(F.broadcast(configs.limit(100_000)) if configs.limit(100_001).count() <= 100_000 else configs).groupBy("run_id").applyInArrow(fold, schema).persist()


def curves(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", "offset", F.posexplode("curve").alias("t", "p")).select("run_id", "offset", "t", "p.*")


def fills(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", F.posexplode("fills").alias("fill_id", "f")).select("run_id", "fill_id", "f.*")


def curve_returns(runs: DataFrame) -> DataFrame:
    """Returns of the equity curve after each run's warm-up."""
    from pyspark.sql.window import Window

    rows = curves(runs)
    before = F.lag("equity").over(Window.partitionBy("run_id").orderBy("t"))
    return rows.withColumn("ret", F.when(before > 0, F.col("equity") / before - 1).when(before.isNotNull(), 0.0)).where("ret is not null and t > offset").select("run_id", "t", "date", "ret")


def summaries(runs: DataFrame, rf: float = 0.02, confidence: float = 0.95) -> DataFrame:
    """A row for each run: returns, risk, trades, costs. Years are those between the first and the last day."""
    from .risk import cost_totals, performance, sortino, trade_metrics, volatility
    from ..functions.scalar import cagr, calmar

    rets = curve_returns(runs)
    perf = performance(rets, "run_id", rf, "t").drop("cagr", "calmar")
    x = F.sort_array(F.collect_list("ret"))  # of one run
    k = F.floor((1 - F.lit(confidence)) * F.size("x") + 1e-9).cast("int") + 1
    tail = rets.groupBy("run_id").agg(x.alias("x"), sortino().alias("sortino"), volatility().alias("volatility"))
    worst = F.slice("x", 1, F.least(k, F.size("x")))
    tail = tail.select("run_id", "sortino", "volatility", (-F.element_at(worst, -1)).alias("var_95"), (-F.aggregate(worst, F.lit(0.0), lambda a, b: a + b) / F.size(worst)).alias("cvar_95"))
    f = fills(runs)
    ends = [F.get("curve", F.col("offset"))["date"], F.element_at("curve", -1)["date"]]
    out = runs.select("run_id", *_COUNTERS, F.element_at("curve", -1)["equity"].alias("final_equity"), ends[0].alias("start_date"), ends[1].alias("end_date"))
    out = out.join(perf, "run_id", "left").join(tail, "run_id", "left").join(trade_metrics(f), "run_id", "left").join(cost_totals(f), "run_id", "left")
    years = F.datediff("end_date", "start_date") / 365.25
    out = out.withColumn("cagr", cagr("total_return", F.when(years > 0, years).otherwise(F.col("days") / 252.0)))
    return out.withColumn("calmar", calmar("cagr", "max_drawdown")).fillna(0.0).fillna(0)
