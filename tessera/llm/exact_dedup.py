"""Exact deduplication by a content sort.

Sampled splitters range-partition the texts by their first characters, a content hash and the identifier;
Spark's external sort puts equal texts side by side; neighbours are compared as whole byte strings. The identifier
in the sort key lets a group of copies span any number of range partitions, so that no group has to fit into
one task. Only the first and last run of a partition can go on in another; those few runs (two for each
partition) are joined by their whole texts afterwards.

Defined cases: a null text is an empty one; rows repeated with the same identifier count as rows, and exactly one
of them is kept; a null identifier sorts before all others; an empty table gives an empty result; other columns are ignored, whatever
their names; very long texts are compared whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, column, documents, rows_to_batch, saved, text_bytes, with_text

#: Of 40 bytes or so: a broadcast of 4 MB at most.
MOST_RUNS = 100_000
_RUNS = "doc_id long, text_sha256 string, part int, grp long, group_size long, best long, stands boolean, edge_text binary"


def _runs(largest: bool):
    """Sorted rows to rows with their group inside this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, part = arrow_schema(_RUNS), TaskContext.get().partitionId()
        key: tuple | None = None
        groups: dict[bytes, list] = {}  # of the present run: text to identifiers, in order
        made, first, out = 0, True, []

        def close(edge: bool) -> None:
            nonlocal made
            for text, ids in groups.items():
                at = len(ids) - 1 if largest else 0
                sha = hashlib.sha256(text).hexdigest()
                out.extend((i, sha, part, made, len(ids), ids[at], k == at, text if edge and k == at else None) for k, i in enumerate(ids))
                made += 1
            groups.clear()

        for batch in batches:
            last, ids = None, None
            for head, mark, i, text in zip(column(batch, "head"), column(batch, "mark"), column(batch, "doc_id"), text_bytes(batch)):
                if (head, mark) != key:
                    if key is not None:
                        close(first)
                        first = False
                    key, last = (head, mark), None
                text = text.lower()  # on bytes: A-Z only
                if text != last:  # the neighbour differs: another text with the same mark, or a new run
                    last, ids = text, groups.setdefault(text, [])
                ids.append(i)
            if len(out) > 20_000:
                yield rows_to_batch(out, schema)
                out = []
        if key is not None:
            close(True)
        yield rows_to_batch(out, schema)

    return run


def exact_dedup(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``.

    keep: "min" or "max", the identifier that stays of equal texts (identical after lower-casing A-Z).
    """
    best, order = (F.max, F.asc) if keep == "max" else (F.min, F.asc)
    folded = F.lower(F.col("text"))  # equal wherever texts are equal after lower-casing A-Z; only orders rows
    keyed = with_text(docs, id_col=id_col, text_col=text_col).select("doc_id", "text", F.substring(folded, 1, 16).alias("head"), F.xxhash64(folded).alias("mark"))
    dealt = keyed.repartitionByRange("head", "mark", "doc_id").sortWithinPartitions("head", "mark", order("doc_id"))
    rows = saved(dealt.mapInArrow(_runs(keep == "max"), _RUNS))
    edges = rows.where("edge_text is not null").select("part", "grp", "group_size", "best", "edge_text")
    whole = edges.groupBy("edge_text").agg(F.sum("group_size").alias("all_size"), best(F.struct("best", "part", "grp")).alias("w"))
    # two runs for each range partition, a few bytes each: broadcast while there are no more than ``MOST_RUNS``
    fixed = saved(edges.join(whole, "edge_text").select("part", "grp", "all_size", F.col("w.best").alias("all_best"), (F.col("w.part") == F.col("part")).alias("wins")))
    out = rows.drop("edge_text").join(F.broadcast(fixed) if fixed.count() <= MOST_RUNS else fixed, ["part", "grp"], "left")
    return out.select(
        "doc_id", F.when(F.col("wins").isNull(), F.col("best")).otherwise(F.col("all_best")).alias("keep_id"), F.coalesce("all_size", "group_size").alias("group_size"),
        (F.col("stands") & F.coalesce("wins", F.lit(True))).alias("kept"), "text_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="max")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""
