"""Defined cases of near-duplicate classes, and their recall."""

import collections

import pytest

from tessera.llm import near_dedup

SF = "/root/testdata/sf0.01"


def classes(spark, rows):
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, mark int, row string, id int").repartition(3)).collect()
    assert len(got) == len(rows)
    return got


def test_rows_without_or_with_the_same_identifier(spark):
    near = [f"word{i}" for i in range(60)]
    rows = [(None, "alpha beta gamma delta epsilon zeta"), (None, "one two three four five six"), (None, " ".join(near)), (5, " ".join([*near, "more"])), (5, "x y"), (5, "x y"), (7, "a b c d e f g"), (7, "h i j k l m n")]
    got = classes(spark, [(*r, 1, "r", 2) for r in rows])
    sizes = collections.Counter(r.class_key for r in got)
    assert sum(r.kept for r in got) == len(sizes) == 6
    assert all(r.class_size == sizes[r.class_key] and r.class_id is not None for r in got)
    alone = [r for r in got if r.doc_id is None and r.class_id < 0]
    assert len({r.class_id for r in alone}) == 2 and all(r.kept for r in alone)
    assert sum(r.kept for r in got if r.doc_id == 7) == 2  # two texts of one identifier stay apart


def test_repeated_rows_keep_one(spark):
    got = classes(spark, [(5, "x y", 1, "r", 2)] * 40 + [(3, "X  Y", 1, "r", 2)] * 2)
    assert sum(r.kept for r in got) == 1 and {r.class_id for r in got} == {3} and [r.doc_id for r in got if r.kept] == [3]


def test_weights_count_repeats(spark):
    line, other = "a b c d e f g h", "i j k l m n o p q r"
    rows = [(1, f"{line} " * 9 + other), (2, f"{line} " * 4 + other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({r.class_id for r in near_dedup.near_duplicates(df).collect()}) == 2
    assert len({r.class_id for r in near_dedup.near_duplicates(df, weight="set").collect()}) == 1


def test_shape_follows_similarity():
    for similarity in (0.5, 0.6, 0.7, 0.8, 0.9):
        bands, prefilter = near_dedup.shape_for(similarity)
        assert 1 - (1 - similarity ** (64 // bands)) ** bands > 0.999 and prefilter < 64 * similarity
    assert near_dedup.shape_for(0.8)[0] == 16


def test_a_family_that_drifts_apart(spark):
    """Each version is like its neighbours only: no leader meets them all."""
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 100])) for i in range(60)] + [(900 + i, " ".join(words[:50] + [f"x{i}y{j}" for j in range(60)])) for i in range(30)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.class_id for r in got if r.doc_id < 100} == {0} and sum(r.kept for r in got) == 31


def test_recall_of_all_pairs_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    counts = [collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter() for w in ((t or "").encode().lower().split() for _, t in rows)]
    holders = collections.defaultdict(list)
    for k, c in enumerate(counts):
        for s in c:
            holders[s].append(k)
    pairs = {(x, y) for held in holders.values() for n, y in enumerate(held) for x in held[:n]}
    total = [sum(c.values()) for c in counts]
    near = [(x, y) for x, y in pairs if (both := sum(min(n, counts[y][s]) for s, n in counts[x].items())) >= 0.8 * (total[x] + total[y] - both)]
    found = {r.doc_id: r.class_id for r in near_dedup.query(spark, SF).collect()}
    assert len(near) > 50 and sum(found[rows[x][0]] == found[rows[y][0]] for x, y in near) == len(near)


@pytest.mark.parametrize("weight", ["set", "count"])
def test_empty(empty, weight):
    assert near_dedup.near_duplicates(empty, weight=weight).count() == 0
