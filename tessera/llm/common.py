"""What the operators share: the input table, durable tables between jobs, Arrow helpers."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a folder of our own only where that is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone when Python exits
        pass


class Table:
    """A DataFrame written to the shared folder and read again: its lineage ends there."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tessera-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        self.own(self.spark, self.path)

    @staticmethod
    def own(spark: SparkSession, path: str) -> None:
        """``path`` goes when Python exits."""
        atexit.register(_remove, spark, path)

    def drop(self) -> None:
        """For tables that no later job reads."""
        _remove(self.spark, self.path)


def saved(df: DataFrame) -> DataFrame:
    return Table(df).df


def tidy(spark: SparkSession, *tables: Table) -> None:
    """Drops tables, and lets Spark's cleaner remove the shuffle files of jobs that are over: it waits for a collection."""
    for t in tables:
        t.drop()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def with_text(docs: DataFrame, *more, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, more): null texts are empty ones; other columns go, whatever their names."""
    conf = docs.sparkSession.conf
    if conf.get(_BATCH) == "10000":  # Spark's own: whole texts make batches of tens of megabytes, several times in memory
        conf.set(_BATCH, "1000")
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def blocks(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each hold about ``limit`` bytes, one row at least."""
    for batch in batches:
        at = batch.schema.get_field_index(name)
        start, held = 0, 0
        sizes = [len(x) if x is not None else 0 for x in batch.column(at).cast(pa.binary()).to_pylist()] if batch.num_rows else []
        for i, n in enumerate(sizes):
            held += n
            if held >= limit:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of the plain types in a DDL string, for workers without a session."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32(), "array<float>": pa.list_(pa.float32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def rows_to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(zip(*rows), schema)] if rows else [pa.array([], type=f.type) for f in schema], schema=schema)


def per_document(ddl: str, one: Callable[[int | None, bytes], tuple], name: str = "text") -> Callable:
    """A mapInArrow function that makes one row of ``ddl`` from each (doc_id, text as UTF-8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for batch in blocks(batches, name=name):
            yield rows_to_batch([one(i, t) for i, t in zip(column(batch, "doc_id"), text_bytes(batch, name))], schema)

    return run
