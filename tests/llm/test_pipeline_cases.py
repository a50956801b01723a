"""Cases of the pipeline's stages: null and repeated identifiers, clashing names, empty and long texts; its result by brute force."""

import collections

import pytest

import corpus_pipeline
from tessera.llm.common import saved

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_sha256 string, row_sha string, kept_id int, mark int, row string, doc string, head int, bucket int"
EXTRA = ("t", "r", 1, 2, "w", "d", 3, 4)
ROWS = [(1, "a b c d e f", "en", "s", 3), (1, "A B c d e f", "en", "s", 3), (1, "other words in this one", "en", "s", 3), (2, "a b c d e f", None, None, 3), (None, None, "en", "s", 0), (None, "", "en", "s", 0),
        (None, "no identifier but a text", "en", "s", 3), (5, " ".join(f"w{i % 997}" for i in range(30_000)), "de", "s", 3), (6, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in ROWS], SCHEMA).repartition(3)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stage_on_tricky_rows(spark, docs, name, stage):
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns
    rows = got.collect()
    assert not collections.Counter(rows) - collections.Counter(docs.collect())  # each a row of the input, no more often
    if name == "exact dedup":
        assert sorted((r.text or "").lower() for r in rows) == sorted({(r[1] or "").lower() for r in ROWS})
    if name == "near dedup":
        assert sorted({" ".join((r.text or "").lower().split()) for r in rows}) == sorted({" ".join((r[1] or "").lower().split()) for r in ROWS})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_an_empty_table(spark, docs, name, stage):
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_packing_on_tricky_rows(spark, docs):
    got = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    assert collections.Counter(r.doc_id for r in got if r.piece == 0) == collections.Counter(r[0] for r in ROWS)


def test_run_by_brute_force(spark):
    """run() gives what the stages give one after the other, and what that leaves of equal and similar texts."""
    pieces = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, SF))
    left = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in pieces} == set(left)
    sets = {}
    for i, t in left.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            assert not both or both < 0.8 * (len(sets[a]) + len(sets[b]) - both)
    held = collections.defaultdict(int)
    for r in pieces:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 4096 and len(held) == -(-sum(held.values()) // 4096)
