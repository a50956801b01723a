"""Tables of results on Parquet, with upserts; CSV exports.

Bars are partitioned by ticker and results by run: an upsert rewrites the partitions of its own tickers or runs alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = {"market_data": ("ticker", ["ticker", "date"]), "backtest_runs": ("run_id", ["run_id"]), "trades": ("run_id", None), "equity_curve": ("run_id", None)}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self._path(name))
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Of ``rows`` with the same key the last one; they replace stored ones. Other rows of the same partitions stay as they are."""
        part, key = KEYS[name]
        rows = latest(rows.withColumn("_nth", F.monotonically_increasing_id()), key, "_nth").drop("_nth")
        stage = None
        if self._exists(name):
            old = self.table(name)
            touched = rows.select(part).distinct()
            stays = old.join(touched, part, "left_semi").join(rows.select(*key), key, "left_anti")
            rows = rows.unionByName(stays, allowMissingColumns=True)
            # what is read from the partitions that are replaced has to stand elsewhere first
            stage = f"{self.root}/_stage_{name}_{uuid.uuid4().hex}"
            rows.write.mode("overwrite").parquet(stage)
            rows = self.spark.read.parquet(stage)
        self._replace(name, rows)
        if stage:
            self._remove(stage)

    def _replace(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(KEYS[name][0]).parquet(self._path(name))

    def _remove(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows of whole runs: a run that is there already is replaced, so that a repeated write doesn't count twice."""
        self._replace(name, rows)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name))

    def market_data(self, ticker: str) -> DataFrame:
        return self.table("market_data").where(F.col("ticker") == ticker).orderBy("date")

    def tickers(self) -> DataFrame:
        return self.table("market_data").select("ticker").distinct().orderBy("ticker")

    def runs(self) -> DataFrame:
        return self.table("backtest_runs").orderBy(F.desc("created_at"))

    def run(self, run_id: str) -> DataFrame:
        return self.table("backtest_runs").where(F.col("run_id") == run_id)

    def trades(self, run_id: str) -> DataFrame:
        return self.table("trades").where(F.col("run_id") == run_id).orderBy("date", "fill_id")

    def equity_curve(self, run_id: str) -> DataFrame:
        return self.table("equity_curve").where(F.col("run_id") == run_id).orderBy("t")

    def persist(self, runs: DataFrame, summaries: DataFrame, rf: float = 0.02) -> None:
        """Summaries (an infinite profit factor as 0), fills at their execution prices, and equity curves."""
        from ..operators.backtest import curves, fills

        now = summaries.withColumn("profit_factor", F.when(F.col("profit_factor") == float("inf"), 0.0).otherwise(F.col("profit_factor"))).withColumn("created_at", F.current_timestamp())
        self.upsert("backtest_runs", now)
        self.append("trades", fills(runs).withColumn("price", F.col("execution_price")))
        self.append("equity_curve", curves(runs))


def export_csv(rows: DataFrame, path: str, decimals: int = 6) -> None:
    """One file with a header; doubles with so many decimals; fields with commas or quotes quoted, quotes doubled."""
    cols = [F.format_string(f"%.{decimals}f", c).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes]
    rows.select(*cols).coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def equity_wide(curves: DataFrame, run_ids: list[str]) -> DataFrame:
    return curves.groupBy("date").pivot("run_id", run_ids).agg(F.first("equity")).orderBy("date")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("k = 1").drop("k")
