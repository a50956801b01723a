"""Worked examples of kernels that need no session."""

import math

import numpy as np
import pytest

from tessera.functions.rng import Streams, splitmix
from tessera.operators import backtest as bt
from tessera.operators import indicators, optimize, significance, simulate

FREE = {"per_share": 0.0, "min_ticket": 0.0, "pct": 0.0, "slip_bps": 0.0, "spread_bps": 0.0, "eta": 0.0, "impact": False, "participation": 0.0, "borrow": 0.0}


class Script(bt.Strategy):
    def __init__(self, *orders):
        self.orders = orders

    def decide(self, t, panel, account):
        return [bt.Order(0, float(q), buy) for at, q, buy in self.orders if at == t]


def panel(close, opens=None, volume=1e6):
    close = np.array(close, float)[:, None]
    return bt.Panel(list(range(len(close))), ["A"], close if opens is None else np.array(opens, float)[:, None], close, np.full(close.shape, volume))


def test_ema_and_sma_seed():
    out = indicators.ema(np.array([2.0, 4, 6, 8, 12]), 3)
    assert np.isnan(out[:2]).all() and list(out[2:]) == [4, 6, 9]


def test_rsi_of_straight_lines():
    up = np.arange(1.0, 21)
    assert indicators.rsi(up)[-1] == 100 and indicators.rsi(up[::-1].copy())[-1] == 0 and indicators.rsi(np.ones(20))[-1] == 50
    assert np.isnan(indicators.rsi(up[:14])).all()


def test_macd_needs_a_faster_line():
    with pytest.raises(ValueError):
        indicators.macd(np.ones(50), 26, 12)
    line, sig, hist = indicators.macd(np.arange(60.0))
    assert np.isnan(line[24]) and not np.isnan(line[25]) and np.isnan(sig[32]) and not np.isnan(sig[33])


def test_execution_prices():
    costs = FREE | {"spread_bps": 4.0, "slip_bps": 5.0}
    assert bt._price(costs, 100, 10, 0, True)["execution_price"] == pytest.approx(100.07)
    assert bt._price(costs, 100, 10, 0, False)["execution_price"] == pytest.approx(99.93)


def test_average_price_and_profit():
    account = bt.Account(1e6, np.zeros(1), np.zeros(1), 1e6)
    account.take(0, 100, 150, 1), account.take(0, 100, 160, 1)
    assert account.average[0] == 155
    assert account.take(0, -100, 175, 1) == (1999, True)


def test_next_open_fill():
    r = bt.simulate(panel([100, 101, 102, 103, 104], [200, 201, 202, 203, 204]), Script((1, 5, True)), costs=FREE)
    assert [(f["date"], f["execution_price"]) for f in r.fills] == [(2, 202.0)]


def test_buy_is_cut_to_cash():
    r = bt.simulate(panel([100] * 4), Script((0, 1000, True)), cash=10_000, costs=FREE)
    assert [f["quantity"] for f in r.fills] == [99]


def test_participation_carries_the_rest():
    r = bt.simulate(panel([10] * 6), Script((0, 2500, True)), costs=FREE | {"participation": 0.001})
    assert [f["quantity"] for f in r.fills] == [1000, 1000, 500] and len({f["order_id"] for f in r.fills}) == 1 and r.capped == 2


def test_new_order_replaces_the_rest():
    r = bt.simulate(panel([10] * 6), Script((0, 2500, True), (1, 100, False)), costs=FREE | {"participation": 0.001})
    assert r.cancelled == 1 and sum(f["quantity"] * (1 if f["side"] == "BUY" else -1) for f in r.fills) == 900


def test_borrow_on_shorts():
    r = bt.simulate(panel([100] * 4), Script((0, 100, False)), costs=FREE | {"borrow": 0.252}, next_open=False)
    assert r.borrow == pytest.approx(40)


def test_future_does_not_change_the_past():
    x = 100 + np.cumsum(np.sin(np.arange(200) * 1.7))
    y = x.copy()
    y[150:] *= 3
    runs = [bt.simulate(panel(v), bt.SmaCrossover("A", 5, 20), costs=FREE).curve[:150] for v in (x, y)]
    assert runs[0] == runs[1]


def test_warm_up_blocks_orders_alone():
    r = bt.simulate(panel([100] * 5), bt.BuyAndHold("A"), costs=FREE, start=2)
    assert [f["date"] for f in r.fills] == [3]  # sent again at bar 2


def test_streams_do_not_depend_on_batches():
    a = Streams(42, np.arange(10))
    b = Streams(42, np.arange(5, 10))
    assert (np.stack([a.normal() for _ in range(9)])[:, 5:] == np.stack([b.normal() for _ in range(9)])).all()
    assert int(splitmix(np.zeros(1, np.uint64))[0]) == 0xE220A8397B1DCDAF
    x = np.concatenate([Streams(1, np.arange(2000)).normal() for _ in range(1)])
    assert abs(x.mean()) < 0.1 and abs(x.std() - 1) < 0.1


def test_projection_and_parity():
    for v in np.random.default_rng(0).normal(size=(50, 6)):
        w = optimize.project(v, 0.0, 0.4)
        assert w.sum() == pytest.approx(1) and w.min() >= 0 and w.max() <= 0.4 + 1e-12
        theta = np.median((v - w)[(w > 1e-9) & (w < 0.4 - 1e-9)]) if ((w > 1e-9) & (w < 0.4 - 1e-9)).any() else None
        if theta is not None:
            assert np.allclose(np.clip(v - theta, 0, 0.4), w)
    with pytest.raises(ValueError):
        optimize.project(np.zeros(3), 0.0, 0.2)
    a = np.random.default_rng(1).normal(size=(40, 4))
    cov = a.T @ a / 40
    y = optimize.risk_parity(cov)
    assert np.allclose(y * (cov @ y), (y @ cov @ y) / 4)


def test_constrained_solutions():
    cov, mu = np.diag([0.04, 0.09, 0.16]), np.array([0.08, 0.10, 0.15])
    assert np.allclose(optimize.utility(mu, cov, 0.0), optimize.minimum_variance(cov), atol=1e-8)
    w = optimize.max_sharpe(mu, cov, 0.02)
    assert np.allclose(w, optimize.tangency(mu, cov, 0.02), atol=1e-5)
    assert optimize.portfolio_stats(optimize.target_return(mu, cov, 0.11), mu, cov)[0] == pytest.approx(0.11)


def test_quantile_and_block_length():
    assert simulate.quantile_of(0.975) == pytest.approx(1.959964, abs=1e-6) and simulate.quantile_of(0) == -10
    t = np.arange(750)
    x = 0.0004 + 0.01 * np.sin(0.7 * t) + 0.006 * np.sin(0.013 * t * t) + 0.003 * np.cos(1.9 * t)
    assert 1 <= significance.politis_white(x) <= 3 * math.sqrt(750) and math.isnan(significance.politis_white(np.ones(100)))


def test_shrinkage_is_between():
    t, i = np.meshgrid(np.arange(60), np.arange(3), indexing="ij")
    x = 0.01 * np.sin(0.37 * t + 1.3 * i) + 0.004 * np.cos(1.7 * t * (i + 1)) + 0.001 * (i - 1)
    x = x - x.mean(axis=0)
    cov, delta = optimize.shrink(x.T @ x / 60, (x**2).T @ x**2 / 60, (x**3).T @ x / 60, 60)
    assert 0 <= delta <= 1 and np.allclose(np.diag(cov), (x * x).mean(axis=0)) and np.allclose(cov, cov.T)


def test_streams_give_published_numbers():
    """First outputs that the generators' authors and other libraries publish: splitmix from 0, xoshiro256** from the state 1, 2, 3, 4."""
    assert [int(splitmix(np.array([k * 0x9E3779B97F4A7C15 % 2**64], np.uint64))[0]) for k in range(3)] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]
    rng = Streams(0, np.array([0, 1]))
    rng.s = [np.full(2, k, np.uint64) for k in (1, 2, 3, 4)]
    assert [int(rng.next()[0]) for _ in range(5)] == [11520, 0, 1509978240, 1215971899390074240, 1216172134540287360]
    assert int(rng.next(np.array([1]))[0]) == 607988272756665600 == int(rng.next(np.array([0]))[0])
    assert int(rng.next()[1]) == 16172922978634559625


def test_stationary_long_run_variance():
    """Against the definition, resample by resample position: the chance that two days stay together, over all lags."""
    x = np.sin(np.arange(40) * 1.3) + 0.1 * np.arange(40) % 1
    n, p, c = 40, 1 / 6, x - x.mean()
    want = 0.0
    for i in range(n):
        for j in range(n):
            k = abs(i - j)
            want += c[i] * c[j] / n * ((n - k) / n * (1 - p) ** k + (k / n * (1 - p) ** (n - k) if k else 0.0))
    assert significance.long_run_variance(x, 6.0) == pytest.approx(want, rel=1e-12)


def test_no_block_length_for_constant_series():
    assert math.isnan(significance.politis_white(np.full(100, 1234.567))) and math.isnan(significance.politis_white(np.zeros(100)))
    assert not math.isnan(significance.politis_white(1e6 + np.sin(np.arange(100.0))))


def test_shrinkage_pinned():
    t, i = np.meshgrid(np.arange(60), np.arange(3), indexing="ij")
    x = 0.01 * np.sin(0.37 * t + 1.3 * i) + 0.004 * np.cos(1.7 * t * (i + 1)) + 0.001 * (i - 1)
    x = x - x.mean(axis=0)
    cov, delta = optimize.shrink(x.T @ x / 60, (x**2).T @ x**2 / 60, (x**3).T @ x / 60, 60)
    # fixed values of an independent implementation, a year of 252 days
    assert delta == pytest.approx(0.0502784214223415, abs=1e-10)
    want = {(0, 0): 0.0142072546450127, (1, 1): 0.0146442052815486, (2, 2): 0.0145457604820819, (0, 1): 0.00306145294513901, (0, 2): -0.0100980281934189, (1, 2): 0.00325975827912009}
    assert all(cov[k] * 252 == pytest.approx(v, abs=1e-10) for k, v in want.items())
