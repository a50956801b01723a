"""The pipeline's stages against what each alone decides, and the registry."""

import hashlib

import corpus_pipeline
from tessera.llm import exact_dedup, mixing, near_dedup, registry
from tessera.llm.common import documents, saved

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, SF)
    columns = docs.columns
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = saved(stage(spark, before, SF))
        assert docs.columns == columns and docs.join(before, "doc_id", "left_anti").count() == 0
        seen.append(docs.count())
        if name == "exact dedup":
            texts = [t.encode().lower() for (t,) in docs.select("text").collect()]
            assert len(set(texts)) == len(texts) == len({hashlib.sha256((t or "").encode().lower()).digest() for (t,) in before.select("text").collect()})
        if name == "near dedup":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in near_dedup.near_duplicates(before).where("kept").collect()}
        if name == "mixing":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in mixing.mix(before).where("kept").collect()}
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


def test_repeated_identifiers(spark):
    rows = [(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (1, "c d", "en", "s", 3), (2, "A B", "en", "s", 3), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.text) == [(1, "a b"), (1, "c d")] and sum(not r.text for r in got) == 1


def test_exact_dedup_against_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(tuple(r[n] for n in names) for r in exact_dedup.query(spark, SF).collect()) == sorted(c.sql(f"select {', '.join(names)} from ({registry.ORACLES['op10_exact_dedup']})").fetchall())
    assert len(registry.QUERIES) == 10 and all(k in registry.QUERIES for k in registry.ORACLES)
