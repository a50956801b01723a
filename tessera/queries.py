"""Queries over the driver's tables, one or more for each operator, with DuckDB oracles.

A query is (columns, Spark function, SQL). The columns say how both sides show them: ``d`` a day as text, ``t`` a time as
text, ``i`` a whole number, a digit so many decimals (by plain arithmetic: the engines' own rounding differs), nothing as is.
"""

from __future__ import annotations

from math import e
from statistics import NormalDist, stdev

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import scalar
from .operators import backtest, indicators, membership, optimize, panel, regimes, risk, significance, simulate
from .plans import sweeps
from .sources import files, market
from .streaming import bars as stream

def _inverse(p: float) -> float:
    """The normal quantile for oracles, from Python's own library; clamped as the operator's."""
    return NormalDist().inv_cdf(p) if 0 < p < 1 else -10.0 if p <= 0 else 10.0


QUERIES: dict = {}
ORACLES: dict = {}


def _shown(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for item in spec.split():
        c, _, kind = item.partition(":")
        x = F.col(c)
        if kind == "d":
            x = x.cast("date").cast("string")
        elif kind == "t":
            x = F.date_format(x, "yyyy-MM-dd HH:mm:ss")
        elif kind == "i":
            x = x.cast("long")
        elif kind.isdigit():
            x = F.floor(x * float(10 ** int(kind)) + 0.5) / float(10 ** int(kind))
        cols.append(x.alias(c))
    return df.select(*cols)


def _wrapped(spec: str, sql: str) -> str:
    cols = []
    for item in spec.split():
        c, _, kind = item.partition(":")
        x = {"d": f"CAST(CAST({c} AS DATE) AS VARCHAR)", "t": f"strftime({c}, '%Y-%m-%d %H:%M:%S')", "i": f"CAST({c} AS BIGINT)", "": c}.get(kind)
        cols.append(f"{x or f'floor({c} * 1e{kind} + 0.5::DOUBLE) / 1e{kind}'} AS {c}")
    return f"SELECT {', '.join(cols)} FROM ({sql}) AS told"


def query(name: str, spec: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: _shown(f(spark, sf_dir), spec)
        if sql:
            ORACLES[name] = _wrapped(spec, sql)
        return f

    return register


def entry(spark, sf_dir):
    return QUERIES["crossover_signals"](spark, sf_dir)


LB = """lb0 AS (SELECT l_returnflag AS ticker, l_shipdate::DATE AS date, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2),
lb AS (SELECT ticker, date, CASE WHEN lag(close) OVER w IS NULL THEN close ELSE least(greatest(lag(close) OVER w, low), high) END AS open, high, low, close, volume,
  lag(close) OVER w AS prev, row_number() OVER w AS rn FROM lb0 WINDOW w AS (PARTITION BY ticker ORDER BY date)),
lr AS (SELECT ticker, date, close / prev - 1 AS ret FROM lb WHERE prev IS NOT NULL)"""
OB = """ob AS (SELECT o_orderpriority AS ticker, o_orderdate::DATE AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY 1, 2)"""
EB = """eb AS (SELECT event_type AS ticker, date_trunc('hour', ts) AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)"""
L, O, E = f"WITH {LB} ", f"WITH {OB} ", f"WITH {EB} "
W = "PARTITION BY ticker ORDER BY date"


def last(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


BARS = "open:4 high:4 low:4 close:4 volume:4"
VALID = "open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= greatest(open, low, close) AND low <= least(open, close) AND volume >= 0"

# sources

query("bars_daily", f"ticker date:d {BARS}", L + "SELECT * FROM lb")(market.lines)
query("bars_orders", f"ticker date:d {BARS}", O + "SELECT * FROM ob")(market.orders)
query("bars_hourly", f"ticker date:t {BARS}", E + "SELECT * FROM eb")(market.events)
_spoilt = lambda s, d: market.orders(s, d).withColumn("high", F.when(F.dayofmonth("date") == 13, F.col("close") * 0.99).otherwise(F.col("high")))
_SPOILT = O + ", sp AS (SELECT ticker, date, open, CASE WHEN day(date) = 13 THEN close * 0.99::DOUBLE ELSE high END AS high, low, close, volume FROM ob) "
query("bar_validity_filter", f"ticker date:d {BARS}", _SPOILT + f"SELECT * FROM sp WHERE {VALID}")(lambda s, d: _spoilt(s, d).where(market.is_valid()))
query("quarantine_invalid", f"ticker date:d {BARS}", _SPOILT + f"SELECT * FROM sp WHERE NOT ({VALID})")(lambda s, d: _spoilt(s, d).where(~market.is_valid()))
query("dedupe_keep_first", "ticker date:d price:4", "SELECT o_orderpriority AS ticker, o_orderdate::DATE AS date, arg_min(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1, 2")(
    lambda s, d: panel.dedupe_first(market.table(s, d, "orders").select(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("price"), "o_orderkey"), "o_orderkey"))
query("stored_tickers", "ticker", "SELECT DISTINCT l_returnflag AS ticker FROM lineitem")(lambda s, d: market.table(s, d, "lineitem").select(F.col("l_returnflag").alias("ticker")).distinct())
query("ticker_scan", f"ticker date:d {BARS}", L + "SELECT * FROM lb WHERE ticker = 'R'")(lambda s, d: market.lines(s, d).where("ticker = 'R'"))

_FIELDS = [("1,000.5", "2020-01-02"), ("12abc", "2020/01/02"), ("1e3", "2020-1-2"), (" 7.25 ", "2020-02-30"), ("-.5", "1962-01-02 16:00"), ("2d", "2020-01/02"), ("inf", "x")]


@query("strict_fields", "raw day_raw value:4 day:d ts:i", "SELECT * FROM (VALUES ('1,000.5', '2020-01-02', NULL::DOUBLE, DATE '2020-01-02', 1577923200), ('12abc', '2020/01/02', NULL, DATE '2020-01-02', 1577923200), ('1e3', '2020-1-2', 1000.0, NULL, NULL), (' 7.25 ', '2020-02-30', 7.25, NULL, NULL), ('-.5', '1962-01-02 16:00', -0.5, DATE '1962-01-02', -252374400), ('2d', '2020-01/02', NULL, NULL, NULL), ('inf', 'x', NULL, NULL, NULL)) t(raw, day_raw, value, day, ts)")
def _(s, d):
    rows = s.createDataFrame(_FIELDS, "raw string, day_raw string").withColumn("value", files.number(F.col("raw"))).withColumn("day", files.day(F.col("day_raw")))
    return rows.withColumn("ts", F.unix_date("day") * 86_400)


query("quoted_fields", "n:i second", "SELECT 3 AS n, 'b,c' AS second UNION ALL SELECT 2, 'x'")(
    lambda s, d: s.createDataFrame([('a," b,c ",d',), ("q, x ",)], "line string").select(files.fields(F.col("line")).alias("f")).select(F.size("f").alias("n"), F.col("f")[1].alias("second")))
query("symbol_list", "symbols", "SELECT 'AAPL MSFT BRK.B' AS symbols")(lambda s, d: s.createDataFrame([("aapl, 'MSFT'|brk.b; ",)], "x string").select(F.array_join(membership.symbols(F.col("x")), " ").alias("symbols")))


@query("chart_json", f"ticker date:d {BARS}", O + "SELECT * FROM ob")
def _(s, d):
    rows = market.orders(s, d).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("date", *market.BAR))).alias("b"))  # a ticker's bars, as the source has them
    pick = lambda c: F.transform("b", lambda x: x[c]).alias(c)
    doc = F.struct(F.struct(F.array(F.struct(
        F.struct(F.col("ticker").alias("symbol"), F.lit(0).alias("gmtoffset")).alias("meta"), F.transform("b", lambda x: F.unix_date(x["date"]).cast("long") * 86_400).alias("timestamp"),
        F.struct(F.array(F.struct(*[pick(c) for c in market.BAR])).alias("quote"), F.array(F.struct(pick("close").alias("adjclose"))).alias("adjclose")).alias("indicators"))).alias("result")).alias("chart"))
    return files.chart_json(rows.select(F.to_json(doc).alias("value")))


@query("list_json", f"ticker date:d {BARS}", O + "SELECT * FROM ob WHERE ticker = '1-URGENT'")
def _(s, d):
    rows = market.orders(s, d).where("ticker = '1-URGENT'").agg(F.collect_list(F.struct(F.concat(F.col("date").cast("string"), F.lit("T00:00:00Z")).alias("date"), *[F.col(c).alias("adj" + c.capitalize()) for c in market.BAR])).alias("b"))
    return files.list_json(rows.select(F.to_json("b").alias("value")), "1-URGENT")


query("adjustment_factor", "ticker date:d open:4 close:4", O + "SELECT ticker, date, open * ((close * 0.5::DOUBLE) / close) AS open, close * ((close * 0.5::DOUBLE) / close) AS close FROM ob")(
    lambda s, d: market.orders(s, d).withColumn("factor", F.col("close") * 0.5 / F.col("close")).select("ticker", "date", (F.col("open") * F.col("factor")).alias("open"), (F.col("close") * F.col("factor")).alias("close")))
query("import_filters", f"ticker date:d {BARS}", O + "SELECT * FROM ob WHERE date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND ticker IN ('1-URGENT', '5-LOW') QUALIFY count(*) OVER (PARTITION BY ticker) >= 10")(
    lambda s, d: market.orders(s, d).where("date between date'1995-01-01' and date'1996-12-31' and ticker in ('1-URGENT', '5-LOW')").withColumn("n", F.count("*").over(Window.partitionBy("ticker"))).where("n >= 10"))
query("business_days", "date:d", "SELECT date FROM (SELECT unnest(range(DATE '2024-01-01', DATE '2024-12-31' + 1, INTERVAL 1 DAY)) AS date) WHERE isodow(date) < 6")(lambda s, d: files.synthetic(s, ["A"], "2024-01-01", "2024-12-31").select("date"))
query("synthetic_universe", f"ticker date:d {BARS}")(lambda s, d: files.synthetic(s, ["A", "B", "C"], "2022-01-03", "2023-12-29"))

# alignment

_COMMON = O + ", ok AS (SELECT date FROM ob GROUP BY date HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM ob)) "
query("intersect_timeline", f"ticker date:d {BARS}", _COMMON + "SELECT * FROM ob SEMI JOIN ok USING (date)")(lambda s, d: panel.intersection(market.orders(s, d)))
query("union_timeline", "t:i date:d", O + "SELECT row_number() OVER (ORDER BY date) - 1 AS t, date FROM (SELECT DISTINCT date FROM ob)")(lambda s, d: panel.timeline(market.orders(s, d)))
_FILLED = O + """, grid AS (SELECT d.date, t.ticker FROM (SELECT DISTINCT date FROM ob) d JOIN (SELECT ticker, min(date) AS first FROM ob GROUP BY 1) t ON d.date >= t.first),
ff AS (SELECT g.ticker, g.date, b.open, b.high, b.low, b.close, CASE WHEN b.date = g.date THEN b.volume ELSE 0 END AS volume, b.date <> g.date AS is_filled FROM grid g ASOF JOIN ob b ON g.ticker = b.ticker AND g.date >= b.date) """
query("forward_fill", f"ticker date:d {BARS} is_filled", _FILLED + "SELECT * FROM ff")(lambda s, d: panel.forward_filled(market.orders(s, d)))
query("timeline_slice", "ticker t:i close:4", L + ", tl AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM lb)) SELECT ticker, t, close FROM lb JOIN tl USING (date) WHERE t >= 100 AND t < 350")(lambda s, d: panel.sliced(market.lines(s, d), 100, 350))
query("close_pivot", "date:d A:4 N:4 R:4", L + "SELECT date, max(close) FILTER (ticker = 'A') AS A, max(close) FILTER (ticker = 'N') AS N, max(close) FILTER (ticker = 'R') AS R FROM lb GROUP BY date")(lambda s, d: panel.closes_wide(market.lines(s, d), ["A", "N", "R"]))
query("simple_returns", "ticker date:d ret:8", L + "SELECT * FROM lr")(lambda s, d: panel.simple_returns(market.lines(s, d)))
query("log_returns", "ticker date:d ret:8", L + "SELECT ticker, date, ln(close / prev) AS ret FROM lb WHERE prev IS NOT NULL")(lambda s, d: panel.log_returns(market.lines(s, d)))
query("aligned_returns", "ticker date:d ret:8", _FILLED + f", x AS (SELECT *, lag(close) OVER ({W}) AS p, row_number() OVER ({W}) AS n FROM ff) SELECT ticker, date, CASE WHEN p > 0 THEN (close - p) / p ELSE 0 END AS ret FROM x WHERE n > 1")(lambda s, d: panel.aligned_returns(panel.forward_filled(market.orders(s, d))))
query("aligned_log_returns", "ticker date:d ret:8", _FILLED + f", x AS (SELECT *, lag(close) OVER ({W}) AS p, row_number() OVER ({W}) AS n FROM ff) SELECT ticker, date, CASE WHEN p > 0 AND close > 0 THEN ln(close / p) ELSE 0 END AS ret FROM x WHERE n > 1")(lambda s, d: panel.aligned_returns(panel.forward_filled(market.orders(s, d)), log=True))
query("latest_bar_wins", "ticker date:d close:4", L + "SELECT ticker, max(date) AS date, arg_max(close, date) AS close FROM lb GROUP BY 1")(lambda s, d: market.lines(s, d).groupBy("ticker").agg(F.max_by("close", "date").alias("close"), F.max("date").alias("date")))

# indicators

query("sma", "ticker date:d sma:4", L + f"SELECT ticker, date, CASE WHEN rn >= 20 THEN avg(close) OVER {last(20)} END AS sma FROM lb")(lambda s, d: market.lines(s, d).select("ticker", "date", indicators.sma(20).alias("sma")))


def _recursion(column: str, period: int, rate: str, start: int = 1, source: str = "lb") -> str:
    """A recursive CTE ``rec(ticker, rn, e)``: the mean of ``period`` numbers, then moves by ``rate``."""
    at = start + period - 1
    return f"""seed AS (SELECT ticker, {at} AS rn, avg({column}) AS e FROM {source} WHERE rn BETWEEN {start} AND {at} GROUP BY ticker HAVING count(*) = {period}),
rec AS (SELECT ticker, rn::BIGINT AS rn, e::DOUBLE AS e FROM seed UNION ALL SELECT r.ticker, b.rn, r.e + (b.{column} - r.e) * ({rate}) FROM rec r JOIN {source} b ON b.ticker = r.ticker AND b.rn = r.rn + 1)"""


LREC = f"WITH RECURSIVE {LB}, "
query("ema", "ticker date:d ema:4", LREC + _recursion("close", 12, "2.0::DOUBLE / 13") + " SELECT b.ticker, b.date, r.e AS ema FROM lb b LEFT JOIN rec r USING (ticker, rn)")(lambda s, d: indicators.recursive(market.lines(s, d), {"ema": ("ema", 12)}))
_CHG = "ch AS (SELECT *, greatest(coalesce(close - prev, 0), 0) AS up, greatest(coalesce(prev - close, 0), 0) AS down FROM lb), "
_RSI = LREC + _CHG + _recursion("up", 14, "1.0::DOUBLE / 14", 2, "ch") + ", " + _recursion("down", 14, "1.0::DOUBLE / 14", 2, "ch").replace("seed", "seed2").replace("rec ", "rec2 ").replace("rec r", "rec2 r") + \
    ", rsi AS (SELECT b.ticker, b.date, b.rn, CASE WHEN d.e = 0 THEN CASE WHEN u.e = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + u.e / d.e) END AS rsi FROM lb b LEFT JOIN rec u USING (ticker, rn) LEFT JOIN rec2 d USING (ticker, rn)) "
query("rsi", "ticker date:d rsi:4", _RSI + "SELECT * FROM rsi")(lambda s, d: indicators.recursive(market.lines(s, d), {"rsi": ("rsi", 14)}))
query("rsi_signals", "ticker date:d signal:i", _RSI + "SELECT ticker, date, CASE WHEN rsi < 30 THEN 1 ELSE -1 END AS signal FROM rsi WHERE rsi < 30 OR rsi > 70")(
    lambda s, d: indicators.recursive(market.lines(s, d), {"rsi": ("rsi", 14)}).where("rsi < 30 or rsi > 70").withColumn("signal", F.when(F.col("rsi") < 30, 1).otherwise(-1)))
_EMA2 = _recursion("close", 12, "2.0::DOUBLE / 13") + ", " + _recursion("close", 26, "2.0::DOUBLE / 27").replace("seed", "seed2").replace("rec ", "rec2 ").replace("rec r", "rec2 r") + \
    ", line AS (SELECT ticker, rn, a.e - b.e AS x FROM rec a JOIN rec2 b USING (ticker, rn)), " + _recursion("x", 9, "2.0::DOUBLE / 10", 26, "line").replace("seed", "seed3").replace("rec ", "rec3 ").replace("rec r", "rec3 r")
query("macd", "ticker date:d macd:4 signal:4 hist:4", LREC + _EMA2 + " SELECT b.ticker, b.date, l.x AS macd, s.e AS signal, l.x - s.e AS hist FROM lb b LEFT JOIN line l USING (ticker, rn) LEFT JOIN rec3 s USING (ticker, rn)")(
    lambda s, d: indicators.recursive(market.lines(s, d), {"macd": ("macd",), "signal": ("macd_signal",), "hist": ("macd_hist",)}))
_TR = "tr AS (SELECT *, CASE WHEN prev IS NULL THEN high - low ELSE greatest(high - low, abs(high - prev), abs(low - prev)) END AS x FROM lb)"
query("true_range", "ticker date:d tr:4", L + f", {_TR} SELECT ticker, date, x AS tr FROM tr")(lambda s, d: market.lines(s, d).select("ticker", "date", indicators.true_range().alias("tr")))
query("atr", "ticker date:d atr:4", LREC + _TR + ", " + _recursion("x", 14, "1.0::DOUBLE / 14", 1, "tr") + " SELECT b.ticker, b.date, r.e AS atr FROM lb b LEFT JOIN rec r USING (ticker, rn)")(lambda s, d: indicators.recursive(market.lines(s, d), {"atr": ("atr", 14)}))
query("bollinger", "ticker date:d middle:4 upper:4 lower:4 percent_b:6 bandwidth:6", L + f", x AS (SELECT ticker, date, close, CASE WHEN rn >= 20 THEN avg(close) OVER {last(20)} END AS m, CASE WHEN rn >= 20 THEN stddev_samp(close) OVER {last(20)} END AS s FROM lb) SELECT ticker, date, m AS middle, m + 2 * s AS upper, m - 2 * s AS lower, CASE WHEN 4 * s <= abs(m) * 1e-12 THEN 0.5::DOUBLE ELSE (close - (m - 2 * s)) / ((m + 2 * s) - (m - 2 * s)) END AS percent_b, ((m + 2 * s) - (m - 2 * s)) / m AS bandwidth FROM x")(
    lambda s, d: market.lines(s, d).select("ticker", "date", *[v.alias(k) for k, v in indicators.bollinger().items()]))
_LV = L + f", lg AS (SELECT ticker, date, rn, close, ln(close / prev) AS ret FROM lb), vol AS (SELECT ticker, date, close, CASE WHEN rn > 20 THEN stddev_samp(ret) OVER {last(20)} * sqrt(252) END AS vol FROM lg) "
_vol = lambda s, d: market.lines(s, d).withColumn("ret", F.ln(F.col("close") / panel.previous())).withColumn("vol", indicators.rolling_volatility(20))
query("rolling_volatility", "ticker date:d vol:6", _LV + "SELECT * FROM vol")(_vol)
query("vol_target_weight", "ticker date:d weight:6", _LV + "SELECT ticker, date, least(1.0::DOUBLE, 0.1::DOUBLE / vol) AS weight FROM vol WHERE vol > 1e-9")(lambda s, d: _vol(s, d).where("vol > 1e-9").withColumn("weight", F.least(F.lit(1.0), 0.1 / F.col("vol"))))
query("trailing_return", "ticker date:d r:8", L + f"SELECT ticker, date, close / lag(close, 60) OVER ({W}) - 1 AS r FROM lb")(lambda s, d: market.lines(s, d).select("ticker", "date", indicators.trailing_return(60).alias("r")))
query("running_drawdown", "ticker date:d peak:4 drawdown:8", L + f", p AS (SELECT *, max(close) OVER ({W}) AS peak FROM lb) SELECT ticker, date, peak, (peak - close) / peak AS drawdown FROM p")(lambda s, d: indicators.drawdowns(market.lines(s, d)))
query("cumulative_wealth", "ticker date:d wealth:6", L + f"SELECT ticker, date, product(1 + ret) OVER ({W}) AS wealth FROM lr")(lambda s, d: panel.simple_returns(market.lines(s, d)).select("ticker", "date", F.product(1 + F.col("ret")).over(panel.by_ticker().rowsBetween(Window.unboundedPreceding, 0)).alias("wealth")))
query("crossover_signals", "ticker date:d fast:4 slow:4 signal:i", L + f", m AS (SELECT ticker, date, CASE WHEN rn >= 20 THEN avg(close) OVER {last(20)} END AS fast, CASE WHEN rn >= 50 THEN avg(close) OVER {last(50)} END AS slow FROM lb), p AS (SELECT *, lag(fast) OVER ({W}) AS f0, lag(slow) OVER ({W}) AS s0 FROM m) SELECT ticker, date, fast, slow, CASE WHEN f0 <= s0 AND fast > slow THEN 1 ELSE -1 END AS signal FROM p WHERE (f0 <= s0 AND fast > slow) OR (f0 >= s0 AND fast < slow)")(lambda s, d: indicators.crossovers(market.lines(s, d)))

# membership

_SPELLS = [("A", None, "1994-06-30"), ("A", "1996-01-01", None), ("N", "1993-03-15", "1997-12-31")]
SP = "sp(ticker, start_date, end_date) AS (VALUES ('A', NULL::DATE, DATE '1994-06-30'), ('A', DATE '1996-01-01', NULL::DATE), ('N', DATE '1993-03-15', DATE '1997-12-31'))"
_IN = "s.ticker = b.ticker AND (s.start_date IS NULL OR b.date >= s.start_date) AND (s.end_date IS NULL OR b.date <= s.end_date)"


def _spells(spark):
    return spark.createDataFrame(_SPELLS, "ticker string, start_date string, end_date string").select("ticker", F.to_date("start_date").alias("start_date"), F.to_date("end_date").alias("end_date"))


query("membership_range_join", "ticker date:d close:4", L + f", {SP} SELECT b.* FROM lb b WHERE EXISTS (SELECT 1 FROM sp s WHERE {_IN})")(lambda s, d: membership.members(market.lines(s, d), _spells(s)))
query("not_member_anti", "ticker date:d close:4", L + f", {SP} SELECT b.* FROM lb b WHERE NOT EXISTS (SELECT 1 FROM sp s WHERE {_IN})")(lambda s, d: membership.not_members(market.lines(s, d), _spells(s)))
query("members_on", "ticker", f"WITH {SP} SELECT DISTINCT ticker FROM sp WHERE (start_date IS NULL OR start_date <= DATE '1995-05-05') AND (end_date IS NULL OR end_date >= DATE '1995-05-05')")(lambda s, d: membership.members_on(_spells(s), "1995-05-05"))
_RANK = L + f""", tl AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM lb)), ap AS (SELECT ticker, date, close, t FROM lb JOIN tl USING (date)),
t AS (SELECT a.*, b.close AS past FROM ap a JOIN ap b ON a.ticker = b.ticker AND a.t = b.t + 60),
rb AS (SELECT date, ticker, close / past - 1 AS ret FROM t b WHERE t >= 60 AND (t - 60) % 20 = 0 AND past > 0 {{more}}) SELECT date, ticker, ret, row_number() OVER (PARTITION BY date ORDER BY ret DESC, ticker) AS rank FROM rb {{where}} QUALIFY rank <= 2"""
query("momentum_rank_topk", "date:d ticker ret:8 rank:i", _RANK.format(more="", where=""))(lambda s, d: membership.momentum_ranking(market.lines(s, d)))
query("dual_momentum", "date:d ticker ret:8 rank:i", _RANK.format(more="", where="WHERE ret > 0"))(lambda s, d: membership.momentum_ranking(market.lines(s, d), absolute=True))
query("member_momentum", "date:d ticker ret:8 rank:i", (_RANK.format(more="AND EXISTS (SELECT 1 FROM sp s WHERE " + _IN + ")", where="")).replace(", tl AS", f", {SP}, tl AS", 1))(lambda s, d: membership.momentum_ranking(market.lines(s, d), spells=_spells(s)))
query("rebalance_days", "ticker date:d t:i", L + ", tl AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM lb)) SELECT ticker, date, t FROM lb JOIN tl USING (date) WHERE t >= 60 AND (t - 60) % 20 = 0")(
    lambda s, d: (lambda x: x.join(panel.timeline(x), "date").where("t >= 60 and (t - 60) % 20 = 0"))(market.lines(s, d)))
query("spells_from_snapshots", "ticker start_date:d end_date:d", O + ", ds AS (SELECT date, row_number() OVER (ORDER BY date) AS i, lead(date) OVER (ORDER BY date) AS next FROM (SELECT DISTINCT date FROM ob)), m AS (SELECT ticker, date, next, i - row_number() OVER (PARTITION BY ticker ORDER BY i) AS g FROM (SELECT DISTINCT ticker, date FROM ob) JOIN ds USING (date)) SELECT ticker, min(date) AS start_date, arg_max_null(next, date) - 1 AS end_date FROM m GROUP BY ticker, g")(
    lambda s, d: membership.spells_from_snapshots(market.orders(s, d).select("date", "ticker")))
_CHANGES = [("2020-01-05", "X", True), ("2020-02-01", "X", True), ("2020-03-01", "X", False), ("2020-05-01", "X", True), ("2020-01-10", "Y", False), ("2020-04-01", "Y", True)]
query("spells_from_changes", "ticker start_date:d end_date:d", "SELECT * FROM (VALUES ('X', DATE '2020-01-05', DATE '2020-02-29'), ('X', DATE '2020-05-01', NULL::DATE), ('Y', NULL::DATE, DATE '2020-01-09'), ('Y', DATE '2020-04-01', NULL::DATE)) t(ticker, start_date, end_date)")(
    lambda s, d: membership.spells_from_changes(s.createDataFrame(_CHANGES, "date string, ticker string, added boolean").withColumn("date", F.to_date("date"))))
query("membership_counts", "tickers:i spells:i", f"WITH {SP} SELECT count(DISTINCT ticker) AS tickers, count(*) AS spells FROM sp")(lambda s, d: _spells(s).agg(F.count_distinct("ticker").alias("tickers"), F.count("*").alias("spells")))

# risk

_ret = lambda s, d: panel.simple_returns(market.lines(s, d))
_VOL = "coalesce(stddev_samp(ret), 0) * sqrt(252)"
_SHARPE = f"CASE WHEN count(ret) < 2 OR {_VOL} <= 1e-9 THEN 0 ELSE (avg(ret) * 252 - 0.02::DOUBLE) / ({_VOL}) END"
query("mean_vol_sharpe", "ticker n:i mean:8 std:8 volatility:6 sharpe:6", L + f"SELECT ticker, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS std, {_VOL} AS volatility, {_SHARPE} AS sharpe FROM lr GROUP BY 1")(lambda s, d: risk.moments(_ret(s, d)))
query("sortino", "ticker sortino:6", L + "SELECT ticker, avg(ret) * 252 / (sqrt(avg(least(0, ret) * least(0, ret))) * sqrt(252)) AS sortino FROM lr GROUP BY 1")(lambda s, d: risk.moments(_ret(s, d)))
query("skew_kurt", "ticker skew:6 kurtosis:6", L + "SELECT ticker, skewness(ret) AS skew, kurtosis(ret) AS kurtosis FROM lr GROUP BY 1")(lambda s, d: risk.moments(_ret(s, d)))
query("var_hist", "ticker var:8 cvar:8", L + ", x AS (SELECT ticker, ret, row_number() OVER (PARTITION BY ticker ORDER BY ret) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM lr) SELECT ticker, -max(ret) AS var, -avg(ret) AS cvar FROM x WHERE k <= floor(0.05::DOUBLE * n + 1e-9) + 1 GROUP BY 1")(lambda s, d: risk.historical_var(_ret(s, d)))
_Z = "1.6448536258543646"
_PHI = "(exp(-{z} * {z} / 2) / sqrt(2 * pi()))"


def _acklam(p: float) -> str:
    return f"{simulate.quantile_of(p)!r}::DOUBLE"  # the operator's approximation is part of its definition, here to 8 decimals


_PV = L + f", m AS (SELECT ticker, avg(ret) AS mu, stddev_samp(ret) AS sd, skewness(ret) AS s, kurtosis(ret) AS k, {_acklam(0.95)} AS z FROM lr GROUP BY 1), c AS (SELECT *, -(-z + s / 6 * (z * z - 1) + k / 24 * (-z * z * z + 3 * z) - s * s / 36 * (-2 * z * z * z + 5 * z)) AS zc FROM m) "
query("var_gaussian", "ticker var_gauss:8 cvar_gauss:8", _PV + f"SELECT ticker, -mu + z * sd AS var_gauss, -mu + sd * {_PHI.format(z='z')} / (1 - 0.95::DOUBLE) AS cvar_gauss FROM c")(lambda s, d: risk.parametric_var(_ret(s, d)))
query("var_cornish_fisher", "ticker var_cf:8 cvar_cf:8", _PV + f"SELECT ticker, -mu + zc * sd AS var_cf, -mu + sd * {_PHI.format(z='zc')} / (1 - 0.95::DOUBLE) AS cvar_cf FROM c")(lambda s, d: risk.parametric_var(_ret(s, d)))
_DD = L + f""", p AS (SELECT ticker, date, close, rn - 1 AS i, max(close) OVER ({W}) AS peak FROM lb),
q AS (SELECT *, (peak - close) / peak AS dd, close >= peak AS np FROM p), g AS (SELECT *, sum(np::INT) OVER ({W}) AS isl, max(CASE WHEN np THEN i END) OVER ({W}) AS pi FROM q),
w AS (SELECT ticker, max(dd) AS max_drawdown, arg_max(i, dd) AS tr, arg_max(pi, dd) AS pk, arg_max(peak, dd) AS pv FROM (SELECT * FROM g ORDER BY i) GROUP BY 1),
u AS (SELECT ticker, max(n) AS longest FROM (SELECT ticker, isl, count(*) AS n FROM g WHERE NOT np GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT w.ticker, min(g.i) AS back FROM w JOIN g ON g.ticker = w.ticker AND g.i > w.tr AND g.close >= w.pv GROUP BY 1) """
query("drawdown_details", "ticker max_drawdown:8 peak_index:i trough_index:i recovery_index:i longest_underwater:i", _DD + "SELECT w.ticker, max_drawdown, pk AS peak_index, tr AS trough_index, coalesce(back, tr) AS recovery_index, coalesce(longest, 0) AS longest_underwater FROM w LEFT JOIN u USING (ticker) LEFT JOIN b USING (ticker)")(lambda s, d: risk.drawdown_details(market.lines(s, d)))
query("underwater_runs", "ticker longest:i", _DD + "SELECT * FROM u")(lambda s, d: risk.drawdown_details(market.lines(s, d)).withColumnRenamed("longest_underwater", "longest"))
_PERF = L + f""", c AS (SELECT ticker, date, ret, product(1 + ret) OVER ({W}) AS wealth FROM lr), k AS (SELECT *, greatest(1.0::DOUBLE, max(wealth) OVER ({W})) AS peak FROM c),
pf AS (SELECT ticker, arg_max(wealth, date) - 1 AS total_return, max((peak - wealth) / peak) AS max_drawdown, {_SHARPE} AS sharpe, count(*) AS days FROM k GROUP BY 1),
pg AS (SELECT *, CASE WHEN total_return <= -1 THEN -1 ELSE pow(1 + total_return, 252.0::DOUBLE / days) - 1 END AS cagr FROM pf) """
query("performance_summary", "ticker total_return:6 max_drawdown:8 sharpe:6 days:i", _PERF + "SELECT * FROM pg")(lambda s, d: risk.performance(_ret(s, d)))
query("calmar_cagr", "ticker cagr:6 calmar:6", _PERF + "SELECT ticker, cagr, CASE WHEN max_drawdown <= 1e-9 THEN 0 ELSE cagr / max_drawdown END AS calmar FROM pg")(lambda s, d: risk.performance(_ret(s, d)))
query("percentile_linear", "event_type p05:4 p25:4 p50:4 p75:4 p95:4", "SELECT event_type, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1")(lambda s, d: risk.percentiles(market.table(s, d, "events"), "value", [0.05, 0.25, 0.5, 0.75, 0.95], "event_type"))
query("median_and_upper_median", "event_type median:4 upper:4", "SELECT event_type, median(value) AS median, list_sort(list(value))[count(*) // 2 + 1] AS upper FROM events GROUP BY 1")(
    lambda s, d: market.table(s, d, "events").withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy("value"))).withColumn("n", F.count("*").over(Window.partitionBy("event_type"))).groupBy("event_type").agg(F.median("value").alias("median"), F.max(F.when(F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("value"))).alias("upper")))
query("autocovariance", "ticker lag:i autocovariance:8", L + f", c AS (SELECT ticker, date, ret - avg(ret) OVER (PARTITION BY ticker) AS c, count(*) OVER (PARTITION BY ticker) AS n FROM lr), x AS (SELECT ticker, n, l.lag, c * CASE WHEN l.lag = 0 THEN c ELSE NULL END AS z, c FROM c, range(0, 1) l(lag)) " + "SELECT ticker, lag, s / n AS autocovariance FROM (" + " UNION ALL ".join(f"SELECT ticker, {k} AS lag, sum(c * p) AS s, count(*) AS n FROM (SELECT ticker, c, lag(c, {k}) OVER ({W}) AS p FROM c) GROUP BY ticker" for k in range(6)) + ")")(lambda s, d: risk.autocovariances(_ret(s, d), 5))
_PAIRS = L + ", pc AS (SELECT a.ticker AS a, b.ticker AS b, count(*) AS n, corr(a.ret, b.ret) AS correlation FROM lr a JOIN lr b ON a.date = b.date AND a.ticker < b.ticker GROUP BY 1, 2) "
query("pairwise_corr", "a b n:i correlation:6", _PAIRS + "SELECT * FROM pc")(lambda s, d: significance.pair_correlations(_ret(s, d)))
query("effective_trials", "trials:i mean_correlation:6 effective:6", _PAIRS + "SELECT 3 AS trials, m AS mean_correlation, 1 + 2 * (1 - m) AS effective FROM (SELECT greatest(0, least(1, avg(correlation))) AS m FROM pc)")(lambda s, d: significance.effective_trials(_ret(s, d)))
query("expected_max_sharpe", "n:i value:8", "SELECT * FROM (VALUES " + ", ".join(f"({n}, {0.1 * ((1 - significance.EULER) * _inverse(1 - 1 / n) + significance.EULER * _inverse(1 - 1 / (n * 2.718281828459045))) if n > 1 else 0.0!r}::DOUBLE)" for n in (1, 2, 10, 41)) + ") t(n, value)")(
    lambda s, d: s.createDataFrame([(n,) for n in (1, 2, 10, 41)], "n int").withColumn("value", significance.expected_max_sharpe("n", 0.1)))
_TRIALS = [0.9, 0.1, -0.3, 0.45, 0.2, -0.05, 0.6, 0.3, 0.0, -0.2]
_TOP = stdev(_TRIALS) * ((1 - significance.EULER) * _inverse(1 - 1 / 10) + significance.EULER * _inverse(1 - 1 / (10 * e)))
# the normal distribution by its series z (z^2)^k / (1 3 5 ... (2 k + 1)); beyond 9 it is 0 or 1 to far more digits than are shown
_CDF = "0.5::DOUBLE + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda k: z * pow(z * z, k) * exp((k + 1) * ln(2::DOUBLE) + lgamma(k + 2) - lgamma(2 * k + 3))))"
query("psr_dsr", "ticker psr:6 dsr:5", L + f""", m AS (SELECT ticker, count(*) AS n, (avg(ret) - 0.02::DOUBLE / 252) / stddev_samp(ret) AS sr, skewness(ret) AS g3, kurtosis(ret) AS g4 FROM lr GROUP BY 1),
zs AS (SELECT ticker, h, greatest(-9::DOUBLE, least(9::DOUBLE, (sr - h / sqrt(252)) * sqrt(n - 1) / sqrt(1 - g3 * sr + (g4 + 2) / 4 * sr * sr))) AS z FROM m, (VALUES (0.0::DOUBLE), ({_TOP!r}::DOUBLE)) t(h)),
ps AS (SELECT ticker, h, {_CDF} AS p FROM zs) SELECT ticker, max(p) FILTER (h = 0) AS psr, max(p) FILTER (h > 0) AS dsr FROM ps GROUP BY 1""")(
    lambda s, d: significance.probabilistic_sharpe(risk.moments(_ret(s, d))).join(significance.deflated_sharpe(risk.moments(_ret(s, d)), _TRIALS).select("ticker", "dsr"), "ticker"))
query("normal_functions", "x:4 pdf:8 cdf:6 quantile:6", "SELECT * FROM (VALUES " + ", ".join(f"(({x})::DOUBLE, exp(-(({x})::DOUBLE * ({x})::DOUBLE) / 2) / sqrt(2 * pi()), {__import__('math').erfc(-x / 2**0.5) / 2!r}::DOUBLE, {_inverse(min(max((x + 4) / 8, 0.0), 1.0))!r}::DOUBLE)" for x in (-3.9, -2.5, -1.0, 0.0, 0.3, 1.9, 3.7)) + ") t(x, pdf, cdf, quantile)")(
    lambda s, d: s.createDataFrame([(x,) for x in (-3.9, -2.5, -1.0, 0.0, 0.3, 1.9, 3.7)], "x double").select("x", scalar.normal_pdf("x").alias("pdf"), scalar.normal_cdf("x").alias("cdf"), scalar.normal_quantile((F.col("x") + 4) / 8).alias("quantile")))

# costs

_COST = """SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS price, l_quantity AS q, (l_orderkey % 1000)::DOUBLE AS v, l_linestatus = 'O' AS buy FROM lineitem WHERE l_quantity > 0"""
_EXEC = f"WITH c AS ({_COST}), x AS (SELECT *, price * 0.00015::DOUBLE AS half, price * (0.0002::DOUBLE + CASE WHEN v > 0 THEN 0.1::DOUBLE * sqrt(q / v) ELSE 0 END) AS slip FROM c), y AS (SELECT *, CASE WHEN buy THEN price + (half + slip) ELSE greatest(0.0001::DOUBLE, price - (half + slip)) END AS ex FROM x) "


def _trades(s, d):
    t = market.table(s, d, "lineitem").where("l_quantity > 0").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("q"), (F.col("l_orderkey") % 1000).cast("double").alias("v"), (F.col("l_linestatus") == "O").alias("buy"))
    return t.withColumn("slip", scalar.slippage("price", "q", "v")).withColumn("half", scalar.half_spread("price")).withColumn("ex", scalar.execution_price("price", "q", "v", F.col("buy"))).withColumn("comm", scalar.commission("q", "ex"))


_COMM = "greatest(1.0::DOUBLE, q * 0.005::DOUBLE + q * ex * 0.0001::DOUBLE)"
query("execution_cost_model", "l_orderkey:i l_linenumber:i ex:4", _EXEC + "SELECT * FROM y")(_trades)
query("commission_min", "l_orderkey:i l_linenumber:i comm:4", _EXEC + f"SELECT *, {_COMM} AS comm FROM y")(_trades)
query("total_transaction_cost", "buy total:2", _EXEC + f"SELECT buy, sum({_COMM} + slip * q + half * q) AS total FROM y GROUP BY 1")(lambda s, d: _trades(s, d).groupBy("buy").agg(F.sum(scalar.transaction_cost("comm", "slip", "q", F.col("half") * F.col("q"))).alias("total")))
query("participation_cap", "l_orderkey:i l_linenumber:i fill:4 part:6", f"WITH c AS ({_COST}) SELECT *, CASE WHEN v > 0 THEN least(q, floor(0.05::DOUBLE * v)) ELSE q END AS fill, CASE WHEN v > 0 THEN q / v ELSE 0 END AS part FROM c")(lambda s, d: _trades(s, d).withColumn("fill", scalar.fillable("q", "v", 0.05)).withColumn("part", scalar.participation("q", "v")))
query("scale_costs", "k:4 slip_bps:4 participation:4 borrow:4", "SELECT k::DOUBLE AS k, 2.0::DOUBLE * k AS slip_bps, 0.1::DOUBLE AS participation, 0.05::DOUBLE * k AS borrow FROM (VALUES (0), (0.5), (1), (2), (5), (10)) t(k)")(
    lambda s, d: s.createDataFrame([(k, c["slip_bps"], c["participation"], c["borrow"]) for k in sweeps.LEVELS for c in [scalar.scale_costs(scalar.COSTS | {"participation": 0.1, "borrow": 0.05}, k)]], "k double, slip_bps double, participation double, borrow double"))
query("compact_dollars", "x:2 shown", "SELECT * FROM (VALUES (2.5e6, '$2.50M'), (1e5, '$100k'), (4.45e7, '$44.5M'), (1e9, '$1B'), (1.23e11, '$123B'), (999.0, '$999')) t(x, shown)")(lambda s, d: s.createDataFrame([(x,) for x in (2.5e6, 1e5, 4.45e7, 1e9, 1.23e11, 999.0)], "x double").withColumn("shown", scalar.compact_dollars("x")))
_POINTS = [("a", 0.0, 0.4), ("a", 1.0, 0.1), ("a", 2.0, -0.2), ("b", 0.0, -0.1), ("b", 1.0, -0.3), ("c", 0.0, 0.3), ("c", 5.0, 0.2), ("d", 1.0, 0.2), ("d", 2.0, -0.2), ("d", 5.0, 0.3), ("d", 10.0, -0.1)]
query("breakeven_interpolation", "strategy breakeven:6", "WITH p(strategy, x, y) AS (VALUES " + ", ".join(f"('{a}', {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in _POINTS) + "), l AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM p WINDOW w AS (PARTITION BY strategy ORDER BY x)) SELECT strategy, arg_min(x0 + y0 / (y0 - y) * (x - x0), x) FILTER (y0 > 0 AND y <= 0) AS breakeven FROM l GROUP BY 1")(
    lambda s, d: sweeps.first_crossing(s.createDataFrame(_POINTS, "strategy string, x double, y double"), "strategy", "x", "y", 0.0))
query("sma_grid_theta_join", "fast:i slow:i place:i", "SELECT f.v AS fast, s.v AS slow, f.i * 6 + s.i AS place FROM (VALUES (5, 0), (10, 1), (15, 2), (20, 3), (30, 4), (40, 5), (50, 6)) f(v, i) JOIN (VALUES (50, 0), (75, 1), (100, 2), (125, 3), (150, 4), (200, 5)) s(v, i) ON f.v < s.v")(lambda s, d: sweeps.grid(s))
query("walk_forward_folds", "fold:i train_begin:i train_end:i test_begin:i test_end:i", L + ", n AS (SELECT count(DISTINCT date) AS n FROM lb) SELECT k AS fold, k * 126 AS train_begin, k * 126 + 504 AS train_end, k * 126 + 504 AS test_begin, k * 126 + 630 AS test_end FROM n, range(0, 1000) r(k) WHERE k * 126 + 630 <= n")(lambda s, d: sweeps.folds(s, market.lines(s, d).select("date").distinct().count()))

# regimes

_RSH = L + f", x AS (SELECT ticker, date, count(*) OVER {last(252)} AS n, avg(ret) OVER {last(252)} AS m, stddev_samp(ret) OVER {last(252)} * sqrt(252) AS v FROM lr), rs AS (SELECT ticker, date, CASE WHEN v <= 1e-9 THEN 0 ELSE (m * 252 - 0.02::DOUBLE) / v END AS sharpe FROM x WHERE n = 252) "
query("rolling_sharpe", "ticker date:d sharpe:6", _RSH + "SELECT * FROM rs")(lambda s, d: regimes.rolling_sharpe(_ret(s, d)))
query("rolling_sharpe_summary", "ticker windows:i least:6 median:6 most:6 last:6 above_zero:6 above_benchmark:6", _RSH + "SELECT r.ticker, count(*) AS windows, min(r.sharpe) AS least, median(r.sharpe) AS median, max(r.sharpe) AS most, arg_max(r.sharpe, r.date) AS last, avg((r.sharpe > 0)::INT::DOUBLE) AS above_zero, avg((r.sharpe > b.sharpe)::INT::DOUBLE) AS above_benchmark FROM rs r LEFT JOIN rs b ON b.ticker = 'A' AND b.date = r.date GROUP BY 1")(lambda s, d: regimes.rolling_summary(regimes.rolling_sharpe(_ret(s, d)), "A"))
_REG = L + f""", rv AS (SELECT ticker, date, close, prev, close / lag(close, 200) OVER ({W}) - 1 AS tret, close / prev - 1 AS ret FROM lb),
rw AS (SELECT *, CASE WHEN count(ret) OVER {last(21)} = 21 THEN stddev_samp(ret) OVER {last(21)} * sqrt(252) END AS rvol FROM rv),
rx AS (SELECT *, count(rvol) OVER ({W}) AS seen, quantile_cont(rvol, 1 / 3::DOUBLE) OVER ({W}) AS lo, quantile_cont(rvol, 2 / 3::DOUBLE) OVER ({W}) AS hi FROM rw),
reg AS (SELECT ticker, date, CASE WHEN tret IS NULL THEN 'TrendUnknown' WHEN tret > 0 THEN 'Bull' ELSE 'Bear' END AS trend,
  CASE WHEN seen < 252 OR rvol IS NULL THEN 'VolUnknown' WHEN rvol <= lo THEN 'LowVol' WHEN rvol >= hi THEN 'HighVol' ELSE 'MidVol' END AS volatility, tret AS trailing_return, rvol AS realized_vol,
  CASE WHEN seen >= 252 AND rvol IS NOT NULL THEN lo END AS low_cut, CASE WHEN seen >= 252 AND rvol IS NOT NULL THEN hi END AS high_cut FROM rx) """
_labels = lambda s, d: regimes.classify(market.lines(s, d))
query("regime_labels", "ticker date:d trend volatility", _REG + "SELECT * FROM reg")(_labels)
query("regime_expanding_terciles", "ticker date:d realized_vol:6 low_cut:6 high_cut:6", _REG + "SELECT * FROM reg")(_labels)
query("regime_counts", "ticker trend volatility days:i", _REG + "SELECT ticker, trend, volatility, count(*) AS days FROM reg GROUP BY GROUPING SETS ((ticker), (ticker, trend), (ticker, volatility))")(lambda s, d: regimes.counts(_labels(s, d)))
_BRK = _REG + f""", tg AS (SELECT ticker, lead(date) OVER ({W}) AS date, trend, volatility FROM reg), j AS (SELECT l.ticker, l.date, l.ret * 0.002::DOUBLE AS ret, unnest(['All', trend, volatility]) AS regime FROM lr l JOIN tg USING (ticker, date)),
bw AS (SELECT *, product(1 + ret) OVER (PARTITION BY ticker, regime ORDER BY date) AS wealth FROM j), bp AS (SELECT *, greatest(1.0::DOUBLE, max(wealth) OVER (PARTITION BY ticker, regime ORDER BY date)) AS peak FROM bw),
bt AS (SELECT ticker, regime, count(*) AS days, arg_max(wealth, date) - 1 AS total_return, {_SHARPE} AS sharpe, max((peak - wealth) / peak) AS max_drawdown FROM bp GROUP BY 1, 2),
dim AS (SELECT DISTINCT ticker, unnest(['All', 'Bull', 'Bear', 'TrendUnknown', 'LowVol', 'MidVol', 'HighVol', 'VolUnknown']) AS regime FROM lr) """
query("regime_breakdown_grouping_sets", "ticker regime days:i total_return:4 sharpe:4 max_drawdown:6", _BRK + "SELECT ticker, regime, coalesce(days, 0) AS days, coalesce(total_return, 0) AS total_return, coalesce(sharpe, 0) AS sharpe, coalesce(max_drawdown, 0) AS max_drawdown FROM dim LEFT JOIN bt USING (ticker, regime)")(lambda s, d: regimes.breakdown(_labels(s, d), _ret(s, d).withColumn("ret", F.col("ret") * 0.002)))

# portfolios

query("expected_returns", "ticker expected_return:6", L + "SELECT ticker, avg(ret) * 252 AS expected_return FROM lr GROUP BY 1")(lambda s, d: optimize.expected_returns(_ret(s, d)))
query("covariance", "a b cov:6", L + "SELECT a.ticker AS a, b.ticker AS b, covar_samp(a.ret, b.ret) * 252 AS cov FROM lr a JOIN lr b ON a.date = b.date AND a.ticker <= b.ticker GROUP BY 1, 2")(lambda s, d: optimize.covariances(_ret(s, d)))
query("moment_sums", "a b n:i s11:8 s22:6 s31:6", L + ", c AS (SELECT ticker, date, ret - avg(ret) OVER (PARTITION BY ticker) AS x FROM lr) SELECT a.ticker AS a, b.ticker AS b, count(*) AS n, avg(a.x * b.x) AS s11, avg(a.x * a.x * b.x * b.x) AS s22, avg(a.x * a.x * a.x * b.x) AS s31 FROM c a JOIN c b USING (date) GROUP BY 1, 2")(lambda s, d: optimize.moment_sums(_ret(s, d)))
# dates that all have, so that every sum is over the same days
_common = lambda s, d: panel.simple_returns(panel.intersection(market.lines(s, d)))
_CRET = L + ", cd AS (SELECT date FROM lb GROUP BY date HAVING count(*) = (SELECT count(DISTINCT ticker) FROM lb)), cb AS (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM lb SEMI JOIN cd USING (date)), cr AS (SELECT * FROM cb WHERE ret IS NOT NULL)"
_LW = _CRET + """, c AS (SELECT ticker, date, ret - avg(ret) OVER (PARTITION BY ticker) AS x FROM cr),
m AS (SELECT a.ticker AS a, b.ticker AS b, count(*) AS n, avg(a.x * b.x) AS s, avg(a.x * a.x * b.x * b.x) AS s22, avg(a.x * a.x * a.x * b.x) AS s31 FROM c a JOIN c b USING (date) GROUP BY 1, 2),
v AS (SELECT a AS k, s AS v FROM m WHERE a = b), e AS (SELECT m.*, va.v AS va, vb.v AS vb FROM m JOIN v va ON va.k = m.a JOIN v vb ON vb.k = m.b),
r AS (SELECT avg(s / sqrt(va * vb)) AS r FROM e WHERE a <> b), f AS (SELECT e.*, CASE WHEN a = b THEN s ELSE r.r * sqrt(va * vb) END AS f, r.r AS r FROM e, r),
d AS (SELECT greatest(0, least(1, (sum(s22 - s * s) - (sum(CASE WHEN a = b THEN s22 - s * s ELSE 0 END) + max(r) * sum(CASE WHEN a <> b THEN sqrt(vb / va) * (s31 - va * s) ELSE 0 END))) / (sum((f - s) * (f - s)) * max(n)))) AS delta FROM f) """
query("ledoit_wolf", "a b cov:6 shrinkage:6", _LW + "SELECT a, b, (delta * f + (1 - delta) * s) * 252 AS cov, delta AS shrinkage FROM f, d")(lambda s, d: optimize.ledoit_wolf(_common(s, d)))
query("portfolio_stats", "expected_return:6 volatility:6 sharpe:6", _CRET + ", w AS (SELECT date, avg(ret) AS r FROM cr GROUP BY 1), p AS (SELECT avg(r) * 252 AS mu, stddev_samp(r) * sqrt(252) AS sd FROM w) SELECT mu AS expected_return, sd AS volatility, (mu - 0.02::DOUBLE) / sd AS sharpe FROM p")(
    lambda s, d: s.createDataFrame([(lambda t, mu, cov: optimize.portfolio_stats(mu * 0 + 1 / len(t), mu, cov))(*optimize.inputs(_common(s, d)))], "expected_return double, volatility double, sharpe double"))
query("gmv_two_assets", "ticker weight:6", _CRET + ", p AS (SELECT var_samp(a.ret) AS va, var_samp(b.ret) AS vb, covar_samp(a.ret, b.ret) AS c FROM cr a JOIN cr b USING (date) WHERE a.ticker = 'A' AND b.ticker = 'N') SELECT 'A' AS ticker, (vb - c) / (va + vb - 2 * c) AS weight FROM p UNION ALL SELECT 'N', (va - c) / (va + vb - 2 * c) FROM p")(
    lambda s, d: (lambda t, mu, cov: s.createDataFrame([(x, float(w)) for x, w in zip(t, optimize.minimum_variance(cov))], "ticker string, weight double"))(*optimize.inputs(_common(s, d).where("ticker <> 'R'"))))
query("portfolio_weights", "ticker gmv_unconstrained:6 tangency_unconstrained:6 gmv_constrained:6 max_sharpe_constrained:4 risk_parity:6")(lambda s, d: optimize.weights_table(s, _common(s, d)))
query("efficient_frontier", "expected_return:6 volatility:6 sharpe:6")(lambda s, d: (lambda t, mu, cov: optimize.frontier(s, mu, cov, 35, 0.0, 0.6))(*optimize.inputs(_common(s, d))))
_V = (0.5, 0.2, -0.1, 0.9)
query("simplex_projection", "i:i w:6", "SELECT * FROM (VALUES (0, 0.3::DOUBLE), (1, 0.0), (2, 0.0), (3, 0.7)) t(i, w)")(lambda s, d: s.createDataFrame([(i, float(w)) for i, w in enumerate(optimize.project(__import__("numpy").array(_V), 0.0, 1.0))], "i int, w double"))

# backtests and plans; results of folds are rows only, tests hold them against worked examples

_sim = lambda s, d: panel.intersection(market.lines(s, d))
_names = dict(ticker="A", cash=1e7)


def _results(s, d, rows):
    return backtest.summaries(backtest.run_backtests(_sim(s, d), sweeps.configs(s, rows)))


_SUM = "run_id total_return:6 max_drawdown:6 sharpe:4 fills:i closed_trades:i win_rate:6 commissions:2"
for _i, _name in enumerate(("buy_hold", "sma", "rsi", "momentum", "voltarget")):
    query(f"backtest_{_name}", _SUM)(lambda s, d, i=_i: _results(s, d, [sweeps.tournament(**_names)[i]]))
query("backtest_tournament", _SUM)(lambda s, d: _results(s, d, sweeps.tournament(**_names)))
query("backtest_fills", "run_id fill_id:i date:d ticker side quantity:2 execution_price:4 realized_pnl:2 closes_position")(lambda s, d: backtest.fills(backtest.run_backtests(_sim(s, d), sweeps.configs(s, sweeps.tournament(**_names)))))
query("backtest_equity_curves", "run_id t:i date:d equity:2 cash:2 positions_value:2 drawdown:8")(lambda s, d: backtest.curves(backtest.run_backtests(_sim(s, d), sweeps.configs(s, sweeps.tournament(**_names)))))
query("exposure", "run_id exposure:6")(lambda s, d: risk.exposure(backtest.curves(backtest.run_backtests(_sim(s, d), sweeps.configs(s, sweeps.tournament(**_names))))))
query("sma_sweep", "fast:i slow:i sharpe:4 total_return:6 max_drawdown:6 fills:i")(lambda s, d: sweeps.sma_sweep(_sim(s, d), "A", cash=1e7))
query("sweep_statistics", "pairs:i best:4 median:4 worst:4 beat_benchmark:i")(lambda s, d: sweeps.sweep_statistics(sweeps.sma_sweep(_sim(s, d), "A", cash=1e7), sweeps.buy_and_hold_sharpe(_sim(s, d), "A", cash=1e7)))
query("sweep_top_pairs", "fast:i slow:i sharpe:4 total_return:6")(lambda s, d: sweeps.top_pairs(sweeps.sma_sweep(_sim(s, d), "A", cash=1e7)))
query("best_active_strategy", "run_id sharpe:4")(lambda s, d: sweeps.best_active(_results(s, d, sweeps.tournament(**_names))))
query("walk_forward", "fold:i fast:i slow:i is_sharpe:4 oos_sharpe:4 oos_return:6 benchmark_return:6")(lambda s, d: sweeps.walk_forward(_sim(s, d), "A", cash=1e7)[0])
query("walk_forward_summary", "folds:i mean_is_sharpe:4 mean_oos_sharpe:4 mean_oos_return:6 beat_benchmark:i")(lambda s, d: sweeps.fold_summary(sweeps.walk_forward(_sim(s, d), "A", cash=1e7)[0]))
query("walk_forward_sweep", "train:i test:i carried folds:i mean_is_sharpe:4 mean_oos_sharpe:4 mean_oos_return:6 beat_benchmark:i")(lambda s, d: sweeps.walk_forward_sweep(_sim(s, d), "A", cash=1e7))
query("cost_breakeven", "strategy breakeven:6")(lambda s, d: sweeps.cost_breakeven(sweeps.cost_sweep(_sim(s, d), sweeps.tournament(**_names))))
query("capacity_breakeven", "strategy breakeven:6")(lambda s, d: sweeps.capacity_breakeven(sweeps.capacity_sweep(_sim(s, d), sweeps.tournament(**_names))))
query("cost_sweep", "strategy multiplier:2 sharpe:4 total_return:6 costs:2")(lambda s, d: sweeps.cost_sweep(_sim(s, d), sweeps.tournament(**_names)))
query("capacity_sweep", "strategy capital:0 total_return:6 fills:i peak_participation:6 capped_fills:i")(lambda s, d: sweeps.capacity_sweep(_sim(s, d), sweeps.tournament(**_names)))
query("look_ahead_cost", "strategy next_open:6 same_close:6 difference:6")(lambda s, d: sweeps.look_ahead_cost(_sim(s, d), sweeps.tournament(**_names)))


def _history(s, d):
    return significance.series(_ret(s, d).where("ticker = 'A'")) * 0.02  # tamed: prices here are not a walk


query("politis_white", "block:6")(lambda s, d: s.createDataFrame([(float(significance.block_length(_history(s, d))),)], "block double"))
query("bootstrap_sharpe", "estimate:6 low:6 high:6 error:6 p_one_sided:6 p_two_sided:6")(lambda s, d: (lambda x: significance.bootstrap_summary(significance.bootstrap_sharpe(s, x), "sharpe", float(significance.sharpe_of(x))))(_history(s, d)))


@query("spa_test", "rc_statistic:6 spa_statistic:6 block:4 p_rc:6 p_lower:6 p_consistent:6 p_upper:6")
def _(s, d):
    x = [significance.series(_common(s, d).where(f"ticker = '{t}'")) * 0.02 for t in "ANR"]
    return significance.predictive_ability(s, __import__("numpy").stack(x[:2]), x[2])


query("mc_bootstrap", "paths:i mean:6 std:6 p05:6 p50:6 p95:6 dd95:6 p_loss:6 var_95:6 cvar_95:6")(lambda s, d: simulate.summarise(simulate.bootstrap_paths(s, _history(s, d))))
query("mc_gbm_fitted", "paths:i mean:6 std:6 p05:6 p50:6 p95:6 dd95:6 p_loss:6 var_95:6 cvar_95:6")(lambda s, d: simulate.summarise(simulate.fitted_gbm_paths(s, _history(s, d))))


@query("mc_gbm_portfolio", "paths:i mean:6 std:6 p05:6 p50:6 p95:6 dd95:6 p_loss:6 var_95:6 cvar_95:6")
def _(s, d):
    _t, mu, cov = optimize.inputs(_common(s, d).withColumn("ret", F.col("ret") * 0.02))
    return simulate.summarise(simulate.gbm_portfolio_paths(s, mu, cov / 252, mu * 0 + 1 / len(mu)))


query("gbm_price_paths", "path:i day:i price:4")(lambda s, d: simulate.gbm_price_paths(s, 100.0, 0.08, 0.2, 20, 50))
query("correlated_price_paths", "path:i day:i ticker price:4")(lambda s, d: (lambda t, mu, cov: simulate.correlated_price_paths(s, t, mu * 0 + 100, mu * 0 + 0.05, cov / 252 * 0.0004, 10, 20))(*optimize.inputs(_common(s, d))))
query("resampled_days", "path:i day:i ticker ret:8")(lambda s, d: simulate.resampled_days(s, _common(s, d), 20, 20, 5.0))
query("unconstrained_frontier", "expected_return:6 volatility:6 sharpe:6")(lambda s, d: (lambda t, mu, cov: s.createDataFrame(optimize.unconstrained_frontier(mu, cov), "expected_return double, volatility double, sharpe double"))(*optimize.inputs(_common(s, d))))


# streams, as batches here; tests replay them as streams

query("tick_bars", f"ticker date:t {BARS}", E + "SELECT * FROM eb")(lambda s, d: stream.tick_bars(market.table(s, d, "events")))
query("sliding_bars", "ticker date:t volume:i", "SELECT event_type AS ticker, w AS date, count(*) AS volume FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1, 2")(lambda s, d: stream.tick_bars(market.table(s, d, "events"), slide="30 minutes"))
query("user_sessions", "user_id:i start:t ticks:i total:2", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events), h AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS ticks, sum(value) AS total FROM h GROUP BY user_id, k")(lambda s, d: stream.sessions(market.table(s, d, "events")))
