"""Importance resampling against a brute-force version: counts, ratios, keys and the drawn set."""

import collections
import math

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality
from tessera.llm.words import PUNCTUATION, hash_words

SF = "/root/testdata/sf0.001"


def grams(text):
    h = hash_words([(text or "").encode()], PUNCTUATION)[0].tolist()
    pairs = [(a * 0xC2B2AE3D27D4EB4F + b * 0x165667B19E3779F9) % (1 << 64) for a, b in zip(h, h[1:])]
    return [(x * 0x9E3779B97F4A7C15 % (1 << 64)) >> 49 for x in h + pairs]


def test_resampling_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held = {r.doc_id for r in spark.range(len(rows) + 1).select(F.col("id").alias("doc_id")).where(F.pmod(F.xxhash64(F.lit(quality.SEED + 1), "doc_id"), F.lit(quality.HELD)) == 0).collect()}
    labels = {r.doc_id: r.quality == 1 for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    raw, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        raw.update(grams(t))
        if labels.get(i) and i not in held:
            target.update(grams(t))
    size = quality.BUCKETS
    all_raw, all_target = sum(raw.values()) + size, sum(target.values()) + size
    want = {i: sum(math.log((target[g] + 1) / all_target) - math.log((raw[g] + 1) / all_raw) for g in grams(t)) for i, t in rows}
    got = {r.doc_id: r for r in quality.query(spark, SF).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i].log_ratio, want[i], rel_tol=1e-6, abs_tol=1e-6) for i in want)
    assert all(got[i].n_grams == len(grams(t)) for i, t in rows)
    # the threshold: every cut between scores of held labels is tried
    scored = sorted((want[i], g) for i, g in labels.items() if i in held and i in want)
    good, bad = sum(g for _, g in scored), sum(not g for _, g in scored)
    cuts = [-np.inf, *((a[0] + b[0]) / 2 for a, b in zip(scored, scored[1:])), np.inf]
    value = [sum(g and s >= c for s, g in scored) / good + sum(not g and s < c for s, g in scored) / bad for c in cuts]
    cut = quality.best_share(scored)
    assert math.isclose(value[cuts.index(cut)], max(value))
    many = sum(s >= cut for s in want.values())
    keys = sorted((r.key for r in got.values()), reverse=True)
    assert sum(r.kept for r in got.values()) == many and all(r.kept == (r.key >= keys[many - 1]) for r in got.values())


def test_identifiers_that_repeat_or_miss(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "y"), (None, "a b", "z"), (2, None, "t"), (3, "w " * 50_000, "u")], "doc_id long, text string, good string")
    labels = spark.createDataFrame([(1, True), (1, False), (None, True), (3, True), (9, False)], "doc_id long, good boolean")
    got = quality.resample(docs, labels).collect()
    assert len(got) == 5 and len({r.key for r in got if r.doc_id == 1}) == 1
