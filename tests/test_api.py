"""The notebook interface, reports and the command line."""

import numpy as np
import pytest

from tessera import api, cli
from tessera.sources import reports


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("bars")
    for k, name in enumerate(("AA", "BB", "CC")):
        rng = np.random.default_rng(k)
        x = 100 * np.exp(np.cumsum(rng.normal(0.0004, 0.01, 320)))
        day = np.datetime64("2020-01-01")
        lines = [f"{day + i},{v:.4f},{v * 1.01:.4f},{v * 0.99:.4f},{v:.4f},{v:.4f},1000000" for i, v in enumerate(x)]
        (d / f"{name}.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n" + "\n".join(lines) + "\n")
    return str(d)


def test_universe_and_backtest(spark, folder):
    u = api.load_universe(spark, folder)
    assert u.tickers() == ["AA", "BB", "CC"] and len(u) == 320 and u.closes().columns == ["date", "AA", "BB", "CC"] and u.slice(10, 20).count() == 30
    both = api.backtest(u, {"hold": api.buy_and_hold("AA"), "free": api.buy_and_hold("AA")}, costs=api.CostModel.free())
    rows = {r.run_id: r for r in both.summary().collect()}
    assert rows["hold"].total_return == rows["free"].total_return and rows["hold"].commissions == 0
    dear = api.backtest(u, api.buy_and_hold("AA"), costs=api.CostModel().scaled(20)).summary().first()
    assert dear.final_equity < rows["free"].final_equity
    assert "hold" in reports.report("runs", both.summary()) and "*" in reports.equity_chart(both.equity_curve().where("run_id = 'hold'"))


@pytest.mark.parametrize("make", [lambda: api.sma_crossover("A", 50, 20), lambda: api.buy_and_hold("A", 0), lambda: api.rsi_reversion("A", low=80), lambda: api.momentum(top=0), lambda: api.vol_target("A", 0)])
def test_arguments_are_checked(make):
    with pytest.raises(ValueError):
        make()


def test_command_line(spark, folder, tmp_path, capsys):
    with pytest.raises(SystemExit) as stop:
        cli.parse(["--data", folder, "--paths", "0"])
    assert stop.value.code == 2
    found = cli.study(spark, cli.parse(["--data", folder, "--ticker", "BB", "--paths", "200", "--resamples", "50", "--store", str(tmp_path / "s")]))
    assert found["strategy_summary"].count() == 5 and found["parameter_sweep"].count() > 30 and found["bootstrap"].count() == 1 and found["portfolio_weights"].count() == 3
    assert "o" in reports.frontier_chart(found["efficient_frontier"])
