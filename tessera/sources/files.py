"""Text sources: bar CSVs with any headers, membership CSVs, long price lists, provider JSON.

Files are read as text by Spark, so that every place that Spark can read will do; a file's header, one short line, decides
where its columns are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .market import BAR, is_valid

#: Names that headers use, in lower case.
ALIASES = {"date": ("date", "timestamp", "datetime"), "open": ("open",), "high": ("high",), "low": ("low",), "close": ("close",), "adj_close": ("adj close", "adjclose", "adjusted_close"), "volume": ("volume", "vol")}
SPELL_ALIASES = {"ticker": ("ticker", "symbol", "name"), "start_date": ("start_date", "start", "from", "added"), "end_date": ("end_date", "end", "to", "removed")}
BARS_SCHEMA = "ticker string, date date, ts long, open double, high double, low double, close double, adj_close double, volume double"


def number(x: Column) -> Column:
    """A double if the whole field is one: no thousands separators, no type suffixes."""
    return F.when(F.trim(x).rlike(r"(?i)^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), F.trim(x).try_cast("double"))


def day(x: Column) -> Column:
    """A real calendar day from the first ten characters, with dashes or slashes; a time after it is ignored."""
    head = F.substring(F.trim(x), 1, 10)
    return F.when(head.rlike(r"^[0-9]{4}(-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}$"), F.try_to_date(F.translate(head, "/", "-"), "yyyy-MM-dd"))


def fields(line: Column) -> Column:
    """Comma-separated fields; commas between quotes belong to a field; blanks and quotes around one go."""
    parts = F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(parts, lambda x: F.regexp_replace(x, '^[ \\t\\r\\n"]+|[ \\t\\r\\n"]+$', ""))


def _lines(spark: SparkSession, path: str, pattern: str, recursive: bool = False) -> DataFrame:
    """(path, file, nth, line) without blank lines and comments; nth orders a file's lines, however it is split."""
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    nth = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), nth.alias("nth"), F.rtrim("value").alias("line"))
    return rows.where("trim(line) <> '' and not startswith(trim(line), '#')")


def _places(header: Column, aliases: dict) -> dict[str, Column]:
    """Where each column stands in a header: the last field with one of its names; -1 if none."""
    lowered = F.transform(header, F.lower)
    return {c: F.greatest(*[F.when(F.array_contains(lowered, n), F.size(lowered) - F.array_position(F.reverse(lowered), n)).otherwise(-1) for n in (*names, names[0])]).cast("int") for c, names in aliases.items()}


def _table(rows: DataFrame, aliases: dict) -> DataFrame:
    """(file, nth, has_<column>, <column> as text): rows with their file's header applied."""
    heads = rows.groupBy("path").agg(F.min_by("line", "nth").alias("first"), F.min("nth").alias("at")).select("path", "at", fields(F.col("first")).alias("head"))
    rows = rows.join(heads, "path").where(F.col("nth") > F.col("at"))
    rows = rows.withColumn("f", fields(F.col("line")))
    at = _places(F.col("head"), aliases)
    return rows.select("path", "file", "nth", *[(p >= 0).alias(f"has_{c}") for c, p in at.items()], *[F.get("f", p).alias(c) for c, p in at.items()])


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Every *.csv of a folder (or one file): strict numbers and dates, defaults for columns that aren't there, valid rows only,
    in order, the first of a day. The ticker is the file's stem."""
    rows = _table(_lines(spark, path, "*.csv"), ALIASES)
    rows = rows.where(F.when(F.col("has_date") & F.col("has_close"), True).otherwise(F.raise_error(F.concat(F.lit("a header without date and close: "), "path"))))
    close = number(F.col("close"))
    either = lambda c, other: F.when(F.col(f"has_{c}"), number(F.col(c))).otherwise(other)
    rows = rows.select(F.regexp_extract("file", r"(.*)\.csv$", 1).alias("ticker"), "nth", day(F.col("date")).alias("date"), close.alias("close"), either("open", close).alias("open"), F.col("has_high"), F.col("has_low"), number(F.col("high")).alias("h"), number(F.col("low")).alias("l"), either("adj_close", close).alias("adj_close"), either("volume", F.lit(0.0)).alias("volume"))
    rows = rows.withColumn("high", F.when(F.col("has_high"), F.col("h")).otherwise(F.greatest("open", "close"))).withColumn("low", F.when(F.col("has_low"), F.col("l")).otherwise(F.least("open", "close")))
    good = rows.where(F.col("date").isNotNull() & F.col("adj_close").isNotNull() & is_valid())
    first = good.withColumn("k", F.row_number().over(Window.partitionBy("ticker", "date").orderBy("nth"))).where("k = 1")
    return first.select("ticker", "date", (F.unix_date("date").cast("long") * 86_400).alias("ts"), *BAR[:4], "adj_close", "volume")


def read_spells(spark: SparkSession, path: str) -> DataFrame:
    rows = _table(_lines(spark, path, "*.csv"), SPELL_ALIASES)
    out = rows.where("has_ticker").select(F.upper(F.trim("ticker")).alias("ticker"), day(F.col("start_date")).alias("start_date"), day(F.col("end_date")).alias("end_date")).where("ticker <> ''")
    if not out.limit(1).count():
        raise ValueError("no usable membership rows")
    return out


#: Date forms that price lists use, and what stands for a missing number.
DATE_FORMS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MMM-yyyy", "yyyyMMdd", "dd MMM yyyy", "MMM dd, yyyy")
MISSING = ("", "null", "none", "nan", "na", "n/a", "-")


def lenient_number(x: Column) -> Column:
    bare = F.regexp_replace(F.trim(x), "[$,]", "")
    return F.when(~F.lower(bare).isin(*MISSING), bare.try_cast("double"))


def lenient_day(x: Column) -> Column:
    x = F.trim(x)
    digits = x.rlike("^[0-9]{9,13}$")
    epoch = F.when(F.length(x) < 12, x.try_cast("long"))
    at = F.coalesce(epoch, (x.try_cast("long") / 1000).cast("long"))
    return F.when(digits, F.to_date(F.timestamp_seconds(at))).otherwise(F.coalesce(*[F.try_to_date(x, f) for f in DATE_FORMS], F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd")))


def import_report(prices: DataFrame, least_rows: int, asked: list[str] | None = None) -> DataFrame:
    """(ticker, rows, first, last, problem): what was read of each ticker; problem says why one isn't used."""
    told = prices.groupBy("ticker").agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"))
    if asked:
        every = prices.sparkSession.createDataFrame([(t.upper(),) for t in asked], "ticker string")
        told = every.join(told, "ticker", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return told.withColumn("problem", F.when(F.col("rows") == 0, "no rows").when(F.col("rows") < least_rows, F.concat(F.lit("fewer rows than "), F.lit(str(least_rows)))))


def write_normalised(prices: DataFrame, path: str, least_rows: int = 60, asked: list[str] | None = None) -> DataFrame:
    """One folder of CSV for each ticker with rows enough, in order, six decimals; returns ``import_report``."""
    report = import_report(prices, least_rows, asked)
    used = prices.join(report.where("problem is null").select("ticker"), "ticker", "left_semi")
    shown = used.select("ticker", "date", *[F.format_string("%.6f", c).alias(c) for c in BAR[:4]], F.format_string("%.0f", "volume").alias("volume"))
    shown.repartition("ticker").sortWithinPartitions("ticker", "date").write.mode("overwrite").partitionBy("ticker").option("header", True).csv(path)
    return report


def import_prices(spark: SparkSession, path: str, least_rows: int = 1, start: str | None = None, end: str | None = None, tickers: list[str] | None = None) -> DataFrame:
    """Long price lists (*.csv and *.txt, folders within folders): a symbol column or the file's stem; prices scaled by adjusted over raw close;
    the last of a day; tickers with fewer rows than ``least_rows`` go."""
    aliases = ALIASES | {"symbol": ("symbol", "ticker", "name")}
    rows = _table(_lines(spark, path, "*.{csv,txt}", recursive=True), aliases)
    raw = lambda c: lenient_number(F.col(c))
    factor = F.when(F.col("has_adj_close") & (raw("close") > 0) & (raw("adj_close") > 0), raw("adj_close") / raw("close")).otherwise(1.0)
    out = rows.select(F.upper(F.when(F.col("has_symbol"), F.trim("symbol")).otherwise(F.regexp_extract("file", r"(.*)\.(?:csv|txt)$", 1))).alias("ticker"), "path", "nth", lenient_day(F.col("date")).alias("date"), *[(raw(c) * factor).alias(c) for c in BAR[:4]], F.coalesce(raw("volume"), F.lit(0.0)).alias("volume"))
    out = out.where(F.col("date").isNotNull() & is_valid())
    if start:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("date") <= F.lit(end).cast("date"))
    if tickers:
        out = out.where(F.col("ticker").isin([t.upper() for t in tickers]))
    last = out.withColumn("k", F.row_number().over(Window.partitionBy("ticker", "date").orderBy(F.desc("path"), F.desc("nth")))).where("k = 1")
    counted = last.withColumn("rows", F.count("*").over(Window.partitionBy("ticker")))
    return counted.where(F.col("rows") >= least_rows).select("ticker", "date", *BAR)


_CHART = "struct<chart:struct<result:array<struct<meta:struct<symbol:string,gmtoffset:bigint>,timestamp:array<bigint>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>,adjclose:array<struct<adjclose:array<double>>>>>>>>"
_LIST = "array<struct<date:string,adjOpen:double,adjHigh:double,adjLow:double,adjClose:double,adjVolume:double>>"


def chart_json(texts: DataFrame, text: str = "value") -> DataFrame:
    """Bars from chart documents: parallel arrays by timestamp, prices scaled by the adjusted close."""
    r = texts.select(F.from_json(text, _CHART)["chart"]["result"][0].alias("r")).where("r is not null")
    q = r.select(F.col("r.meta.symbol").alias("ticker"), F.coalesce("r.meta.gmtoffset", F.lit(0)).alias("off"), F.col("r.timestamp").alias("ts"), F.col("r.indicators.quote")[0].alias("q"), F.get("r.indicators.adjclose", F.lit(0))["adjclose"].alias("adj"))
    rows = q.select("ticker", "off", F.explode(F.arrays_zip("ts", F.col("q.open").alias("open"), F.col("q.high").alias("high"), F.col("q.low").alias("low"), F.col("q.close").alias("close"), F.col("q.volume").alias("volume"), F.coalesce("adj", F.col("q.close")).alias("adj"))).alias("x")).select("ticker", "off", "x.*")
    factor = F.coalesce(F.try_divide("adj", "close"), F.lit(1.0))
    return rows.select("ticker", F.to_date(F.timestamp_seconds(F.col("ts") + F.col("off"))).alias("date"), *[(F.col(c) * factor).alias(c) for c in BAR[:4]], F.coalesce("volume", F.lit(0.0)).alias("volume")).where(is_valid())


def list_json(texts: DataFrame, ticker: str, text: str = "value") -> DataFrame:
    """Bars from a list of objects with adjusted prices."""
    rows = texts.select(F.inline(F.from_json(text, _LIST)))
    return rows.select(F.lit(ticker).alias("ticker"), F.to_date(F.substring("date", 1, 10)).alias("date"), F.col("adjOpen").alias("open"), F.col("adjHigh").alias("high"), F.col("adjLow").alias("low"), F.col("adjClose").alias("close"), F.coalesce("adjVolume", F.lit(0.0)).alias("volume")).where(is_valid())


def synthetic(spark: SparkSession, tickers: list[str], start: str, end: str, seed: int = 42, drift: float = 0.08, vol: float = 0.2, market: float = 0.6) -> DataFrame:
    """Correlated geometric Brownian motion on business days: a market factor of the day, and a part of each ticker's own."""
    days = spark.sql(f"select explode(sequence(date'{start}', date'{end}')) as date").where("weekday(date) < 5")
    names = spark.createDataFrame([(t, i) for i, t in enumerate(tickers)], "ticker string, i int")
    unit = lambda *cols: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / float(1 << 53)
    normal = lambda tag, *cols: F.sqrt(-2 * F.ln(unit(F.lit(tag), *cols))) * F.cos(2 * F.pi() * unit(F.lit(tag + 1), *cols))
    rows = days.join(F.broadcast(names))  # the names given
    own = vol * (0.7 + 0.8 * unit(F.lit(90), "ticker"))
    step = (drift - 0.04 + 0.1 * unit(F.lit(91), "ticker") - own * own / 2) / 252 + own / (252**0.5) * (market**0.5 * normal(1, "date") + (1 - market) ** 0.5 * normal(3, "date", "ticker"))
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("close", 100 * (0.3 + 2.7 * unit(F.lit(92), "ticker")) * F.exp(F.sum(step).over(w)))
    rows = rows.withColumn("open", F.coalesce(F.lag("close").over(Window.partitionBy("ticker").orderBy("date")), "close") * (1 + 0.002 * normal(5, "date", "ticker")))
    spread = 1 + 0.005 * unit(F.lit(7), "date", "ticker")
    return rows.select("ticker", "date", "open", (F.greatest("open", "close") * spread).alias("high"), (F.least("open", "close") / spread).alias("low"), "close", F.floor(1e6 * (0.5 + unit(F.lit(8), "date", "ticker"))).cast("double").alias("volume"))
