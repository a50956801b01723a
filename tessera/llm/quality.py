"""Quality classifier by importance resampling.

Two generative models of hashed word n-grams, one of target texts and one of raw texts, give each document the log of
their ratio, p_target / p_raw. Adding Gumbel noise to it and taking the k largest draws k documents without
replacement in proportion to the ratio. The target model is fitted on documents that are labelled good, but for one in ``HELD``:
how many to draw is where the ratio separates good from bad among those labels, which the model hasn't seen, best.

Target counts come from at most ``most_labels`` labelled documents (their identifiers are collected, taken by a
hash); raw counts cover every document. Both are vectors of ``buckets`` numbers, whatever the input. The k-th
largest key is found exactly, in four rounds that count keys by 16 of their bits; no sort, no single task.

The log ratio is the plain sum over all unigrams and bigrams of a whole text, whatever its length.

Defined cases: a null text is empty, has no n-grams and a ratio of 0 (kept as any other with that key); rows whose keys tie with
the k-th are kept together; repeated rows have the same key; without labels of both kinds all is kept; an
empty table gives no rows; other columns are ignored, whatever their names; very long texts are read whole; an identifier of several
labels counts as bad if one of them is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, blocks, column, documents, saved, text_bytes, with_text
from .words import PUNCTUATION, hash_words

BUCKETS = 1 << 15
MOST_LABELS = 20_000
#: One labelled document in so many is kept from the target model, for the threshold.
HELD = 3
SEED = 20_261

def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)


def ngram_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams of ``texts``, and where each text's begin (with the end)."""
    h, starts = hash_words(texts, PUNCTUATION)
    sizes = np.diff(starts)
    ends = np.cumsum(sizes)
    both = np.zeros(2 * len(h), np.int64)
    both[0::2] = _bucket(h)
    both[1:-1:2] = _bucket(h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:] * np.uint64(0x165667B19E3779F9))
    real = np.ones(2 * len(h), bool)
    real[2 * ends[sizes > 0] - 1] = False  # no bigram goes from one text into the next
    return both[real], np.concatenate([[0], np.cumsum(np.maximum(2 * sizes - 1, 0))])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's documents, raw and target, as one row of (bucket, raw, target) for each bucket that occurs."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in blocks(batches, 1 << 20):
        grams, at = ngram_buckets(text_bytes(batch))
        raw += np.bincount(grams, minlength=BUCKETS)
        good = np.repeat(np.array(column(batch, "good"), bool), np.diff(at))
        target += np.bincount(grams[good], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(raw[at]), pa.array(target[at])], schema=arrow_schema("bucket long, raw long, target long"))


_RATIOS = "doc_id long, n_grams long, log_ratio double, mark long"


def _ratios(log_ratio):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, table = arrow_schema(_RATIOS), log_ratio.value
        for batch in blocks(batches, 1 << 20):
            grams, at = ngram_buckets(text_bytes(batch))
            n = np.diff(at)
            total = np.zeros(len(n))
            if len(grams):
                total[n > 0] = np.add.reduceat(table[grams], at[:-1][n > 0])
            kept = [batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(n), pa.array(total), batch.column(batch.schema.get_field_index("mark"))]
            yield pa.RecordBatch.from_arrays(kept, schema=schema)

    return run


def kth_largest(df: DataFrame, k: int, col: str) -> int:
    """The k-th largest of a column of longs from 0 up, counting 16 bits of them at a time."""
    known, left = 0, k
    for shift in (48, 32, 16, 0):
        rows = df if shift == 48 else df.where(F.shiftright(col, shift + 16) == F.lit(known))
        counts = rows.groupBy(F.shiftright(col, shift).bitwiseAND(F.lit(0xFFFF)).alias("digit")).count().collect()  # 65,536 rows at most
        for digit, many in sorted(map(tuple, counts), reverse=True):
            if left <= many:
                known = known << 16 | digit
                break
            left -= many
    return known


def best_share(scored: list[tuple[float, bool]]) -> float:
    """The threshold that separates (score, good) best by balanced accuracy; the lowest such."""
    scored = sorted(scored)
    good, bad = sum(g for _, g in scored), sum(not g for _, g in scored)
    if not good or not bad:
        return -np.inf
    best, at, below_good, below_bad, k = -1.0, -np.inf, 0, 0, 0
    while k <= len(scored):
        value = (good - below_good) / good + below_bad / bad
        if value > best and (k == 0 or k == len(scored) or scored[k][0] != scored[k - 1][0]):
            best, at = value, (-np.inf if k == 0 else np.inf if k == len(scored) else (scored[k - 1][0] + scored[k][0]) / 2)
        if k < len(scored):
            below_good, below_bad = below_good + scored[k][1], below_bad + (not scored[k][1])
        k += 1
    return at


def resample(docs: DataFrame, labels: DataFrame, noise: float = 1.0, most_labels: int = MOST_LABELS, seed: int = SEED, **cols) -> DataFrame:
    """(doc_id, n_grams, log_ratio, mark, key, kept), a row for each row of ``docs``; mark: xxhash64 of the text.

    labels: (doc_id, good). noise: the scale of the Gumbel noise; 0 makes the draw a ranking.
    """
    spark = docs.sparkSession
    some = {r.doc_id: (bool(r.good), r.held) for r in labels.where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min(F.col("good").cast("int")).alias("good")).withColumn("held", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(HELD)) == 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels).collect()}
    held = spark.sparkContext.broadcast(frozenset(i for i, (good, out) in some.items() if good and not out))
    texts = with_text(docs, **cols)

    def count(batches):
        schema = arrow_schema("doc_id long, text string, good boolean")

        def marked():
            for b in batches:
                ids = column(b, "doc_id")
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), b.column(b.schema.get_field_index("text")).cast(pa.string()), pa.array([i in held.value for i in ids], pa.bool_())], schema=schema)

        return _count(marked())

    totals = texts.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # `buckets` rows
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in totals:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    table = spark.sparkContext.broadcast(np.log(target / target.sum()) - np.log(raw / raw.sum()))
    ratios = saved(texts.withColumn("mark", F.xxhash64("text")).mapInArrow(_ratios(table), _RATIOS))
    # noise from the identifier: the same wherever and whenever the row is read
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = ratios.withColumn("key", F.col("log_ratio") - F.lit(float(noise)) * F.log(-F.log(u)))
    known = spark.createDataFrame([(i, g) for i, (g, out) in some.items() if out], "doc_id long, good boolean")
    marked = ratios.join(F.broadcast(known), "doc_id").groupBy("doc_id", "good").agg(F.max("log_ratio").alias("log_ratio")).collect()  # `most_labels` rows
    cut = best_share([(r.log_ratio, r.good) for r in marked])
    n, many = ratios.agg(F.count("*"), F.count(F.when(F.col("log_ratio") >= F.lit(float(cut)), 1))).first()
    if many in (0, n):
        return keyed.withColumn("kept", F.lit(many == n))
    ranked = keyed.withColumn("rank_key", F.floor(F.col("key") * float(1 << 32)) + F.lit(1 << 62))  # a non-negative long in the same order
    return ranked.withColumn("kept", F.col("rank_key") >= F.lit(kth_largest(ranked, many, "rank_key"))).drop("rank_key")


def query(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("quality") == 1).alias("good"))
    return resample(documents(spark, sf_dir), labels)
