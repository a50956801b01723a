"""python -m tessera.cli --data DIR [...]: the whole study of a folder of bar CSVs, as reports and CSV exports."""

from __future__ import annotations

import argparse
import sys


def parse(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--data", required=True, help="folder of bar CSVs")
    p.add_argument("--ticker", help="ticker of single-asset strategies; the first one if it isn't there")
    p.add_argument("--align", choices=("intersection", "union"), default="intersection")
    p.add_argument("--cash", type=float, default=100_000.0)
    p.add_argument("--paths", type=int, default=50_000)
    p.add_argument("--resamples", type=int, default=10_000)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--out", help="folder for CSV exports")
    p.add_argument("--store", help="folder of result tables to add the runs to")
    args = p.parse_args(argv)
    for name in ("cash", "paths", "resamples"):
        if getattr(args, name) <= 0:
            p.error(f"--{name} is above 0")
    return args


def study(spark, args: argparse.Namespace) -> dict:
    """The tables of a study, by name."""
    from . import api
    from .operators import optimize, panel, regimes, simulate
    from .plans import sweeps
    from .sources.store import Store

    universe = api.load_universe(spark, args.data, args.align)
    tickers = universe.tickers()
    ticker = args.ticker if args.ticker in tickers else tickers[0]
    runs = api.backtest(universe, {"buy_and_hold": api.buy_and_hold(ticker), "sma_crossover": api.sma_crossover(ticker), "rsi_reversion": api.rsi_reversion(ticker), "momentum": api.momentum(), "vol_target": api.vol_target(ticker)}, args.cash)
    plan = sweeps.tournament(ticker, cash=args.cash)
    own = universe.bars.where(universe.bars.ticker == ticker)
    out = {"strategy_summary": runs.summary(), "equity_curves": runs.equity_curve(), "trades": runs.fills(), "look_ahead": sweeps.look_ahead_cost(universe.bars, plan), "costs": sweeps.cost_sweep(universe.bars, plan), "capacity": sweeps.capacity_sweep(universe.bars, plan),
           "parameter_sweep": api.sma_sweep(universe, ticker, cash=args.cash), "regime_labels": regimes.classify(own), "regime_breakdown": regimes.breakdown(regimes.classify(own), panel.simple_returns(own))}
    if len(universe) >= 630:
        out["walk_forward"] = api.walk_forward(universe, ticker, cash=args.cash)[0]
    returns = panel.simple_returns(universe.bars)
    if len(tickers) > 1:
        _, mu, cov = optimize.inputs(returns)
        out |= {"portfolio_weights": optimize.weights_table(spark, returns), "efficient_frontier": optimize.frontier(spark, mu, cov, high=max(0.4, 1.0 / len(tickers)))}
    own_returns = panel.simple_returns(own)
    out["bootstrap"] = api.bootstrap_sharpe(spark, own_returns, resamples=args.resamples, seed=args.seed)
    out["monte_carlo"] = simulate.summarise(simulate.bootstrap_paths(spark, api.significance.series(own_returns), args.paths, seed=args.seed), args.cash)
    if args.store:
        Store(spark, args.store).persist(runs.runs, runs.summary())
    return out


def main(argv: list[str] | None = None) -> int:
    args = parse(sys.argv[1:] if argv is None else argv)
    from pyspark.sql import SparkSession

    from .sources.reports import report
    from .sources.store import export_csv

    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        for name, table in study(spark, args).items():
            if args.out:
                export_csv(table, f"{args.out.rstrip('/')}/{name}")
            if name not in ("equity_curves", "trades", "regime_labels"):
                print(report(name.replace("_", " "), table), end="\n\n")
    except (ValueError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
