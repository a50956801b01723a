"""Operators on small tables, sources, the store, and streams against batches."""

import datetime as dt
import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import backtest, membership, panel, regimes, risk, significance
from tessera.plans import sweeps
from tessera.sources import files, market
from tessera.sources.store import Store, export_csv
from tessera.streaming import bars as stream

SF = "/root/testdata/sf0.001"


def series(spark, values, ticker="A"):
    day = dt.date(2023, 1, 1)
    return spark.createDataFrame([(ticker, day + dt.timedelta(i), float(v), float(v) * 1.01, float(v) * 0.99, float(v), 1e6) for i, v in enumerate(values)], "ticker string, date date, open double, high double, low double, close double, volume double")


def test_value_at_risk_ladder(spark):
    rows = spark.createDataFrame([("A", -0.05 + 0.001 * i) for i in range(100)], "ticker string, ret double")
    r = risk.historical_var(rows).first()
    assert r["var"] == pytest.approx(0.045) and r["cvar"] == pytest.approx(0.0475)


def test_drawdown_details(spark):
    r = risk.drawdown_details(series(spark, [100, 120, 150, 120, 105, 130, 160])).first()
    assert r["max_drawdown"] == pytest.approx(0.3) and (r.peak_index, r.trough_index, r.recovery_index, r.longest_underwater) == (2, 4, 6, 3)


def test_hostile_csv(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2020-01-02,1,2,0.5,\"1,000.5\",1,1\n2020-01-03,1,2,0.5,inf,1,1\n2020-01-06,1,2,0.5,1.5,1.5,-5\n2020-02-30,1,2,0.5,1.5,1.5,5\n2020-01-07,1,2,0.5,1.5,1.5,5\n2020-01-07,1,3,0.5,1.6,1.5,5\n")
    (tmp_path / "close.csv").write_text("# a comment\r\nDate,Close\r\n2020/01/03,\"10.5\"\r\n\r\n2020-01-02 16:00,10\r\n")
    got = {(r.ticker, str(r.date)): r for r in files.read_bars(spark, str(tmp_path)).collect()}
    assert set(got) == {("bad", "2020-01-07"), ("close", "2020-01-03"), ("close", "2020-01-02")}
    assert got["bad", "2020-01-07"].close == 1.5 and got["close", "2020-01-02"].high == 10 and got["close", "2020-01-03"].volume == 0 and got["close", "2020-01-02"].ts == 1577923200


def test_spell_csv_and_members(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Symbol,added,removed\nleh,1994-09-08,2008-09-15\nAAPL,1982-11-30,\n")
    spells = files.read_spells(spark, str(tmp_path))
    assert [r.ticker for r in membership.members_on(spells, "2008-09-15").collect()] == ["AAPL", "LEH"]
    assert [r.ticker for r in membership.members_on(spells, "2008-09-16").collect()] == ["AAPL"]


def test_import_prices(spark, tmp_path):
    os.makedirs(tmp_path / "deep")
    (tmp_path / "deep" / "x.csv").write_text("date,open,high,low,close,volume,Name\n2020-01-02,$1,2,0.5,\"1.5\",100,aa\n2020-01-02,1,2,0.5,1.6,100,aa\n01/03/2020,1,2,0.5,1.5,null,aa\n2020-01-02,1,2,0.5,1.5,1,bb\n")
    got = files.import_prices(spark, str(tmp_path), least_rows=2).orderBy("date").collect()
    assert [(r.ticker, str(r.date), r.close) for r in got] == [("AA", "2020-01-02", 1.6), ("AA", "2020-01-03", 1.5)]


def test_store_upserts(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.upsert("market_data", series(spark, [1, 2, 3]).unionByName(series(spark, [5, 6], "B")))
    store.upsert("market_data", series(spark, [9]))
    assert [r.close for r in store.market_data("A").collect()] == [9, 2, 3] and [r.ticker for r in store.tickers().collect()] == ["A", "B"] and store.market_data("B").count() == 2
    runs = backtest.run_backtests(series(spark, np.linspace(100, 120, 30)), sweeps.configs(spark, [sweeps.config("r1", "buy_and_hold", ticker="A")]))
    store.persist(runs, backtest.summaries(runs))
    assert store.runs().count() == 1 and store.trades("r1").count() == 1 and store.equity_curve("r1").count() == 30
    export_csv(store.trades("r1"), str(tmp_path / "out"))
    assert "run_id" in open(glob.glob(str(tmp_path / "out/part*"))[0]).readline()


def test_backtest_paths_agree(spark):
    bars = series(spark, 100 + 10 * np.sin(np.arange(120) / 7)).unionByName(series(spark, 50 + 5 * np.cos(np.arange(120) / 9), "B"))
    configs = sweeps.configs(spark, sweeps.tournament("A", cash=1e6))
    a, b = (sorted(map(str, backtest.fills(backtest.run_backtests(bars, configs, n)).collect())) for n in (10**6, 10))
    assert a == b and a


def test_walk_forward_folds(spark):
    bars = series(spark, 100 + 10 * np.sin(np.arange(300) / 7) + np.arange(300) * 0.05)
    table, returns = sweeps.walk_forward(bars, "A", train=100, test=50, fast=(3, 5), slow=(10, 20))
    assert table.count() == 4 and returns.groupBy("fold").count().where("count <> 49").count() == 0


def test_regime_days_add_up(spark):
    x = 100 * np.exp(np.cumsum(0.001 + 0.01 * np.sin(np.arange(500) * 1.3) * (1 + np.arange(500) % 97 / 50)))
    bars = series(spark, x)
    rows = {r.regime: r for r in regimes.breakdown(regimes.classify(bars), panel.simple_returns(bars)).collect()}
    assert len(rows) == 8 and sum(rows[k].days for k in ("Bull", "Bear", "TrendUnknown")) == rows["All"].days == sum(rows[k].days for k in ("LowVol", "MidVol", "HighVol", "VolUnknown"))


def test_predictive_ability(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(0, 0.01, 200)
    good = np.stack([base + 0.01, base])
    r = significance.predictive_ability(spark, good, base + rng.normal(0, 1e-4, 200), resamples=200, block=4)
    r = r.first()
    assert r.p_rc < 0.05 and r.p_lower <= r.p_consistent <= r.p_upper < 0.05


def test_stream_equals_batch(spark, tmp_path):
    ticks = market.table(spark, SF, "events")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    ticks.orderBy("ts").coalesce(1).write.parquet(src)
    # two more ticks, far ahead: they move the watermark past all others
    late = spark.sql("select 999999991L as event_id, timestamp'2099-01-01' as ts, 1L as user_id, 'zz' as event_type, 1.0D as value, '' as props")
    q = stream.tick_bars(spark.readStream.schema(ticks.schema).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    q.start().awaitTermination()
    late.select(ticks.columns).write.mode("append").parquet(src)
    q.start().awaitTermination()
    late.select((F.col("event_id") + 1).alias("event_id"), (F.col("ts") + F.expr("interval 1 day")).alias("ts"), "user_id", "event_type", "value", "props").write.mode("append").parquet(src)
    q.start().awaitTermination()
    want = {tuple(r) for r in stream.tick_bars(ticks).collect()}
    assert want
    got = {tuple(r) for r in spark.read.parquet(out).where("ticker <> 'zz'").collect()}
    assert got == want


def test_streaming_ema(spark, tmp_path):
    bars = market.events(spark, SF).orderBy("date")
    bars.coalesce(1).write.parquet(str(tmp_path / "src"))
    q = stream.streaming_ema(spark.readStream.schema(bars.schema).parquet(str(tmp_path / "src")), 3).writeStream.format("memory").queryName("ema_out").trigger(availableNow=True).start()
    q.awaitTermination()
    from tessera.operators.indicators import recursive

    want = {(r.ticker, r.date): r.e for r in recursive(market.events(spark, SF), {"e": ("ema", 3)}).collect()}
    got = {(r.ticker, r.date): r.ema for r in spark.table("ema_out").collect()}
    assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (got[k] is None or got[k] == pytest.approx(want[k])) for k in got)


def test_pinned_significance(spark):
    """Fixed values of independent implementations."""
    import numpy as np

    from tessera.operators import risk, significance

    t = np.arange(750.0)
    x = 0.0004 + 0.01 * np.sin(0.7 * t) + 0.006 * np.sin(0.013 * t * t) + 0.003 * np.cos(1.9 * t)
    rows = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(x)], "ticker string, date int, ret double")
    moments = risk.moments(rows).cache()
    assert significance.probabilistic_sharpe(moments).first().psr == pytest.approx(0.8386085863389722, abs=1e-9)
    assert significance.probabilistic_sharpe(moments, 0.5).first().psr == pytest.approx(0.5511162883541261, abs=1e-9)
    told = significance.deflated_sharpe(moments, [0.9, 0.1, -0.3, 0.45, 0.2, -0.05, 0.6, 0.3, 0.0, -0.2]).first()
    assert told.trial_sharpe_std == pytest.approx(0.3719318934070233, abs=1e-12) and told.threshold == pytest.approx(0.5856433275750075, abs=1e-6) and told.dsr == pytest.approx(0.49247193587208515, abs=1e-6)
    assert moments.first().sharpe == pytest.approx(0.5746751972287912, abs=1e-12)

    t = np.arange(250.0)
    bench = 0.0003 + 0.009 * np.sin(0.31 * t) + 0.004 * np.cos(0.017 * t * t)
    some = np.stack([bench + 0.0002 + 0.006 * np.sin(0.9 * t + 1.0), bench - 0.0012 + 0.005 * np.cos(0.45 * t) + 0.003 * np.sin(0.07 * t * t), 0.5 * bench + 0.008 * np.sin(1.7 * t)])
    r = significance.predictive_ability(spark, some, bench, resamples=500, block=4.0, seed=11).first()
    want = {"rc_statistic": 0.0031854958690369925, "spa_statistic": 0.8975155143036216, "p_rc": 0.5848303393213573, "p_lower": 0.249500998003992, "p_consistent": 0.32934131736526945, "p_upper": 0.4411177644710579}
    assert all(r[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_momentum_days_are_those_of_the_timeline(spark):
    import datetime

    from tessera.operators import membership

    first = datetime.date(2023, 1, 1)
    rows = [("A", first + datetime.timedelta(i), 100.0 * 1.01**i) for i in range(12)] + [("B", first + datetime.timedelta(i), 100.0 * 1.02**i) for i in range(3, 12)]
    got = membership.momentum_ranking(spark.createDataFrame(rows, "ticker string, date date, close double"), lookback=4, every=4, top=2).orderBy("date", "rank").collect()
    assert [((r.date - first).days, r.ticker) for r in got] == [(4, "A"), (8, "B"), (8, "A")]


def test_store_keeps_one_row_a_key_and_repeats_writes(spark, tmp_path):
    from tessera.sources.store import Store

    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("A", "2023-01-01", 1.0), ("A", "2023-01-01", 9.0), ("A", "2023-01-02", 2.0)], "ticker string, date string, close double").coalesce(1)
    store.upsert("market_data", rows)
    store.upsert("market_data", rows.where("close = 2.0").withColumn("close", F.lit(3.0)))
    assert sorted((r.date, r.close) for r in store.table("market_data").collect()) == [("2023-01-01", 9.0), ("2023-01-02", 3.0)]
    for _ in range(2):
        store.append("trades", spark.createDataFrame([("r1", 1), ("r1", 2)], "run_id string, fill_id int"))
    assert store.table("trades").count() == 2 and not list(tmp_path.glob("_stage*"))


def test_headers_without_a_date_are_an_error(spark, tmp_path):
    from tessera.sources import files

    (tmp_path / "X.csv").write_text("Day,Open\n2023-01-01,5\n")
    with pytest.raises(Exception, match="header without date"):
        files.read_bars(spark, str(tmp_path)).collect()


def test_normalised_files_and_report(spark, tmp_path):
    from tessera.sources import files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.txt").write_text("symbol,date,open,high,low,close,volume\n" + "".join(f"aa,{d:02d}-Jan-2020,{d},{d + 1},{d},{d},9\n" for d in range(1, 6)) + "bb,05-Jan-2020,7,7,7,7,0\n")
    prices = files.import_prices(spark, str(tmp_path / "in"))
    report = {r.ticker: (r.rows, r.problem) for r in files.write_normalised(prices, str(tmp_path / "out"), 3, ["aa", "bb", "cc"]).collect()}
    assert report == {"AA": (5, None), "BB": (1, "fewer rows than 3"), "CC": (0, "no rows")}
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 5


def test_a_bad_price_pair_counts_as_no_return(spark):
    import statistics

    from tessera.operators import indicators

    rets = [None, 0.01, None, -0.02, 0.03]
    rows = spark.createDataFrame([("A", i, r) for i, r in enumerate(rets)], "ticker string, date int, ret double")
    got = rows.select("date", indicators.rolling_volatility(4).alias("v")).orderBy("date").collect()
    assert got[3].v is None and got[4].v == pytest.approx(statistics.stdev([0.01, 0.0, -0.02, 0.03]) * 252**0.5)


def test_a_benchmark_is_never_above_itself(spark):
    """Ratios that come out a little different each time they are computed, as sums over a shuffle do."""
    import random

    noise = F.udf(lambda: random.random() * 1e-12, "double").asNondeterministic()
    day = dt.date(2023, 1, 1)
    rows = [(t, day + dt.timedelta(i), 1.0 + i + shift) for i in range(200) for t, shift in (("A", 0.0), ("N", 0.5 if i % 4 == 0 else -0.5))]
    rows += [("N", day + dt.timedelta(500), 9.0), ("A", None, 1.0), ("R", None, 2.0), ("R", day, 3.0)]  # no benchmark on a day of its own or without a date
    rolling = spark.createDataFrame(rows, "ticker string, date date, sharpe double").withColumn("sharpe", F.col("sharpe") + noise())
    got = {r.ticker: (r.windows, r.above_benchmark) for r in regimes.rolling_summary(rolling, "A").collect()}
    assert got == {"A": (201, 0.0), "N": (201, 0.25), "R": (2, 1.0)}
