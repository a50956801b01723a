"""A corpus from raw documents: reject, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
``documents``. ``run`` writes each stage's rows to the shared folder and reads them again as the next one's input.

Rows are joined with decisions by identifier and text, so that rows that share an identifier, or have none, are decided by their own
texts; a stage's columns travel as one struct, so that no name of a column can clash.

Defined cases: rows with a null text are documents without words: they pass the classifier, are copies of each other, and
one of them becomes a sequence's end token; rows that are repeated as a whole are copies; of equal texts the smallest identifier
stays, of rows that share it and the text any one; a null identifier is a value of its own; very long texts are read whole; an
empty table gives an empty result; further columns are passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, mixing, near_dedup, packing, quality
from tessera.llm.common import documents, saved

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rows(docs: DataFrame, mark: Column) -> DataFrame:
    """(row, row_id, row_mark): each row as a struct, with its identifier and a mark made of its text."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("row_id"), mark.alias("row_mark"))


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _only(rows: DataFrame, decided: DataFrame, mark: str) -> DataFrame:
    """``rows`` whose identifier and mark were kept."""
    kept = decided.where("kept").select(F.col("doc_id").alias("kept_id"), F.col(mark).alias("kept_mark")).distinct()
    return rows.join(kept, rows["row_id"].eqNullSafe(kept["kept_id"]) & (rows["row_mark"] == kept["kept_mark"]), "left_semi")


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("quality") == 1).alias("good"))
    return _only(_rows(docs, F.xxhash64(_text())), quality.resample(docs, labels), "mark").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    decided = saved(exact_dedup.exact_dedup(docs))
    kept = _only(_rows(docs, F.sha2(F.translate(_text(), _UPPER, _LOWER), 256)), decided, "text_sha256")
    if not decided.groupBy("doc_id").count().where("count > 1").isEmpty():  # equal texts may share the identifier that stays
        kept = kept.dropDuplicates(["row_id", "row_mark"])
    return kept.select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(_rows(docs, F.xxhash64(_text())), near_dedup.near_duplicates(docs), "mark").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(_rows(docs, F.xxhash64(_text())), mixing.mix(docs), "mark").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", reject_poor),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Raking, dart signatures and best-fit packing are iterations that SQL doesn't express; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: pieces of documents in their sequences."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
