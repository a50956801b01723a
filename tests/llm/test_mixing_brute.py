"""Raking and sampling against a brute-force version."""

import collections

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing

SF = "/root/testdata/sf0.001"


def test_query_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "source", "lang", "text", ((F.shiftrightunsigned(F.xxhash64(F.lit(mixing.SEED), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)).alias("u"), mixing.topic_of(F.col("text")).alias("topic")).collect()
    cells = collections.Counter()
    for r in rows:
        cells[r.source, r.lang, r.topic] += len(r.text.encode().split())
    total = sum(cells.values())
    wants = []
    for a, name in enumerate(("source", "lang", "topic")):
        have = collections.Counter()
        for k, n in cells.items():
            have[k[a]] += n
        share = {v: mixing.TARGETS[name].get(v, n / total) if name in mixing.TARGETS else (n / total) ** 0.5 for v, n in have.items()}
        wants.append({v: x / sum(share.values()) * total for v, x in share.items()})
    weight = {k: float(n) for k, n in cells.items()}
    for _ in range(mixing.ROUNDS):
        for a, want in enumerate(wants):
            have = collections.Counter()
            for k, w in weight.items():
                have[k[a]] += w
            weight = {k: w * want[k[a]] / have[k[a]] for k, w in weight.items()}
    factor = {k: weight[k] / n for k, n in cells.items()}
    low, high = 0.0, 1e9  # the scale whose expected sample has the budget
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * min(1, mid * factor[k]) for k, n in cells.items()) < 0.6 * total else (low, mid)
    got = {r.doc_id: r for r in mixing.query(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        p = min(1, low * factor[r.source, r.lang, r.topic])
        assert got[r.doc_id].probability == pytest.approx(p, rel=1e-4) and got[r.doc_id].kept == (r.u < got[r.doc_id].probability)


def test_clashing_names_and_long_texts(spark):
    rows = [(1, "a " * 60_000, "s", "en", 1, 2.0, 3), (1, "b", "s", "en", 1, 2.0, 3), (None, None, None, None, 1, 2.0, 3)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, mark int, probability double, topic int"), mixing.TARGETS).collect()
    assert sorted(r.n_tokens for r in got) == [0, 1, 60_000]
