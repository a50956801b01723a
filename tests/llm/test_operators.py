"""Operators against brute force on tricky rows, and their kernels against worked examples."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import debruijn, exact_dedup, jpeg, lbl, licenses, mixing, near_dedup, packing, pii, quality, words


def lowered(t):
    return (t or "").encode().lower().decode()


def test_words_are_blank_separated():
    texts = [b"", b" a  b\n", b"\x0b", "ü x y z".encode()]
    h, at = words.hash_words(texts)
    assert list(np.diff(at)) == [len(t.split()) for t in texts]
    assert words.hash_words([b"b"])[0][0] == h[1] and len(set(h.tolist())) == len(h)
    assert (words.window_hashes(h, 2)[1] == words.window_hashes(words.hash_words([b"b \xc3\xbc"])[0], 2)[0])


# 10


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(docs, tricky, keep):
    groups = collections.defaultdict(list)
    for i, t in tricky:
        groups[lowered(t)].append(i)
    got = exact_dedup.exact_dedup(docs, keep).collect()
    assert len(got) == len(tricky)
    for r in got:
        mine = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and r.doc_id in g)
        real = [x for x in mine if x is not None]
        assert r.group_size == len(mine) and r.keep_id == ((min if keep == "min" else max)(real) if real else None)
    assert collections.Counter(r.text_sha256 for r in got if r.kept) == collections.Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)


def test_exact_dedup_of_a_group_over_many_tasks(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Same Text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_dedup.exact_dedup(rows, "max").where("group_size > 1").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 1000 and {r.keep_id for r in got} == {2997} and sum(r.kept for r in got) == 1


# 2


def windows_removed(rows, w=35):
    split = [(t or "").encode().split() for _, t in rows]
    seen = collections.Counter(tuple(x[k : k + w]) for x in split for k in range(len(x) - w + 1))
    out = []
    for (i, _), x in zip(rows, split):
        gone = [False] * len(x)
        for k in range(len(x) - w + 1):
            if seen[tuple(x[k : k + w])] > 1:
                gone[k : k + w] = [True] * w
        out.append((i, len(x), sum(gone), hashlib.sha256(b" ".join(y for y, g in zip(x, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_debruijn_on_tricky_rows(docs, tricky):
    assert sorted((tuple(r)[:4] for r in debruijn.remove_repeats(docs).collect()), key=str) == windows_removed(tricky)


def test_debruijn_on_overlapping_passages(spark):
    rng = random.Random(5)
    passages = [[f"v{rng.randrange(300)}" for _ in range(rng.randint(30, 150))] for _ in range(5)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            text += rng.choice([p, p[a:], p[: a + 40], [f"u{rng.randrange(10**6)}" for _ in range(50)]])
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r)[:4] for r in debruijn.remove_repeats(df).collect()), key=str) == windows_removed(rows)
    spans = debruijn.repeated_spans(df).collect()
    by = dict(rows)
    assert spans and all(s.n_words >= 35 for s in spans)
    # places of a unitig that begin alike hold the same words, as far as both go
    for head in {s.unitig for s in spans}:
        held = [by[s.doc_id].split()[s.first_word : s.first_word + s.n_words] for s in spans if s.unitig == head]
        whole = " ".join(max(held, key=len))
        assert sum(" ".join(x) in whole for x in held) >= 1


# 3


def test_language_model_counts_and_base(docs, tricky):
    counts, texts = collections.Counter(), []
    for i, t in tricky:
        tokens = lowered(t).encode().split() + [b"\n"]
        held = zlib.crc32(str("null" if i is None else i).encode()) % 7 == 2
        texts.append((i, held, tokens))
        if not held:
            counts.update(tokens)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, held, len(x), sum(counts[w] > 0 for w in x), n, round(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in x), 6)) for i, held, x in texts), key=str)
    got = lbl.score(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    assert all(r.score < 0 and np.isfinite(r.score) for r in got)


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    for own in (0, 3, 150):
        leaves = lbl.Leaves(list(range(10, 10 + own)))
        seen = np.where(rng.random(20_000) < 0.9, np.arange(20_000) % 2, rng.integers(0, leaves.n, 20_000))
        frequency = np.bincount(seen, minlength=leaves.n) + 1.0
        frequency /= frequency.sum()
        before = lbl._before(seen, np.array([0, len(seen)]), leaves.n - 1)
        gram, n = np.unique((before[:, 0] * leaves.n + before[:, 1]) * leaves.n + seen, return_counts=True)
        grams = np.stack([gram // leaves.n**2, gram // leaves.n % leaves.n, gram % leaves.n], axis=1)
        start = lbl.initial(leaves, frequency)
        times = 200_000 // len(grams)
        model = lbl.train(start, leaves, np.tile(grams, (times, 1)), np.tile(n, times), frequency, 1)
        assert lbl.log_probabilities(model, leaves, before, seen).mean() > lbl.log_probabilities(start, leaves, before, seen).mean() + 0.2
        every = np.arange(leaves.n)
        for context in ((1, 0), (0, 1), (leaves.n - 1, 2)):
            each = lbl.log_probabilities(model, leaves, np.tile(context, (leaves.n, 1)), every)
            assert np.exp(each.astype(float)).sum() == pytest.approx(1, abs=1e-4)
            # brute force: both softmaxes spelled out
            h = model["c"][0] * model["r"][context[1]] + model["c"][1] * model["r"][context[0]]
            top, low = np.exp(model["q1"] @ h + model["b1"]), np.exp(model["q2"] @ h + model["b2"])
            want = [top[x // leaves.size] / top.sum() * low[x] / low[x // leaves.size * leaves.size : (x // leaves.size + 1) * leaves.size].sum() for x in every]
            assert np.allclose(np.exp(each), want, rtol=1e-3)
        assert np.allclose(lbl.pack(lbl.unpack(lbl.pack(model, leaves), leaves), leaves), lbl.pack(model, leaves))


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = ({r.doc_id: r.score for r in lbl.score(docs.repartition(n)).collect()} for n in (2, 7))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], rel=1e-6) for k in one)


def test_model_beats_unigrams_on_held_out_text(spark):
    d = "/root/testdata/sf0.01"
    r = lbl.query(spark, d).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


# 4


def test_quality_on_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    r = {(x.quality, x.kept): x["count"] for x in quality.query(spark, d).join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert r.get((1, True), 0) >= 0.98 * (r.get((1, True), 0) + r.get((1, False), 0)) and r.get((0, False), 0) >= 0.9 * (r.get((0, True), 0) + r.get((0, False), 0))


def test_quality_without_labels_keeps_all(spark, docs, tricky):
    none = spark.createDataFrame([], "doc_id long, good boolean")
    assert quality.resample(docs, none).where("kept").count() == len(tricky)


def test_kth_largest(spark):
    values = [random.Random(1).randrange(1 << 62) for _ in range(300)] + [7] * 5
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for k in (1, 17, 301, 305):
        assert quality.kth_largest(df, k, "x") == sorted(values, reverse=True)[k - 1]


def test_ngrams_do_not_cross_texts():
    a, at = quality.ngram_buckets([b"a b", b"", b"c"])
    one, _ = quality.ngram_buckets([b"a b"])
    two, _ = quality.ngram_buckets([b"c"])
    assert list(at) == [0, 3, 3, 4] and list(a) == list(one) + list(two)


# 5


def test_media_round_trip(docs, tricky):
    got = jpeg.media_columns(docs).collect()
    texts = collections.defaultdict(set)
    for i, t in tricky:
        texts[i].add((t or "").encode())
    for r in got:
        raw = next(t for t in texts[r.doc_id] if len(t) == r.n_bytes)
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert bytes(r.thumbnail) == full and r.payload_sha256 == hashlib.sha256(full).hexdigest() and r.tail_crc32 == zlib.crc32(full[-64:]) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()


def test_jpeg_with_ac_coefficients_and_no_restarts():
    # one 16 x 8 grey picture written by hand: DC 2 then DC -1, an AC run, an end of block
    dc, ac = ([0, 2, 3] + [0] * 13, [0, 1, 2, 3, 4]), ([0, 2, 1] + [0] * 13, [0x00, 0x11, 0xF0])
    code = {t: {s: f"{c:0{n}b}" for c, n, s in jpeg._canonical(*x)} for t, x in (("dc", dc), ("ac", ac))}
    bits = code["dc"][2] + "10" + code["ac"][0xF0] + code["ac"][0x11] + "1" + code["ac"][0] + code["dc"][2] + "00" + code["ac"][0]
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    seg = jpeg._segment
    data = (b"\xff\xd8" + seg(0xDB, bytes([0, 16] + [1] * 63)) + seg(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0])) + seg(0xC4, bytes([0, *dc[0], *dc[1]])) + seg(0xC4, bytes([0x10, *ac[0], *ac[1]]))
            + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9")
    (picture, thumb), = jpeg.decode([data])[0]
    assert (picture.width, picture.height) == (16, 8) and thumb.tolist() == [[132, 126]]


def test_jpeg_of_several_pictures():
    payload = random.Random(0).randbytes(64 * (jpeg.MOST_ROWS + 3))
    stored = jpeg.encode([payload, payload[:64]])
    back = jpeg.decode(stored)
    assert len(back[0]) == 2 and b"".join(t.tobytes() for _, t in back[0]) == payload and back[1][0][1].tobytes() == payload[:64]
    with pytest.raises(ValueError):
        jpeg.decode([b"no picture"])


# 6


def test_packing(docs, tricky):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = collections.Counter()
    for i, t in tricky:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want[i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    rows = packing.pack(docs).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for x in held.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) == -(-sum(r.length for r in rows) // 4096)


def fewest(sizes, capacity):
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= sizes[k]}.values():
            place(k + 1, rooms[:i] + [rooms[i] - sizes[k]] + rooms[i + 1 :])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


def test_dominance_keeps_an_optimum():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        bins = packing._Bins(collections.Counter(sizes))
        fixed = packing.reduce_by_dominance(bins, capacity)
        rest = sorted((s for s, n in bins.n.items() for _ in range(n)), reverse=True)
        assert all(sum(x) <= capacity for x, _ in fixed)
        assert sum(n for _, n in fixed) + fewest(rest, capacity) == fewest(sizes, capacity), sizes


# 7


def test_personal_data(docs, tricky):
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    text = next(t for i, t in tricky if i == 14)
    want = [("email", "a@b.co"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")]
    assert [(pii.KINDS[x.k], x.s, x.e) for x in rows[14].base] == [(k, text.index(m), text.index(m) + len(m)) for k, m in want]
    assert all(not r.base and not r.spans for i, r in rows.items() if i != 14)


def test_personal_data_on_long_runs(spark):
    texts = ["1 " * 20_000, "a." * 20_000 + "@" + "b." * 20_000 + "c", "9" * 50_000, "+" * 20_000, "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 1.2.3.256", "4111-1111-1111-1111-"]
    rows = {r.doc_id: [(x.k, x.s, x.e) for x in r.base] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[0] == rows[2] == rows[3] == [] and rows[1] == [(0, 0, 80_002)] and rows[4] == [(0, 0, 5), (0, 5, 11)] and rows[5] == [(1, 0, 7), (1, 8, 15)] and rows[6] == [(2, 0, 19)]


def test_native_plan(docs):
    plan = pii.candidates(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# 8


def test_license_scan(docs, spark):
    assert license_rows(spark, ["CC-BY cc by; all rights\nreserved."])[0][1:] == (7, 3, 0, 4, "cc-by,reserved", "cc-by,reserved", 1.0)
    fuzzy = license_rows(spark, ["x Relesed under the MIT lisence y", "released under the terms of some other agreement", "Licensed under the Apache Licence, Version 2.0"])
    assert [r[6] for r in fuzzy] == ["mit", "", "apache-2.0"] and 0.8 < fuzzy[0][7] < 1 and fuzzy[1][7] == 0
    rows = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert rows[1].n_words == rows[3].n_words == 0 and rows[1].first_word is None and rows[1].labels == "" and rows[9].n_words == len("àéî çñ ß 漢字 i ſ   x y".split(" "))


def license_rows(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    return [tuple(r) for r in licenses.license_scan(df).orderBy("doc_id").collect()]


def test_seeds_find_whatever_the_pattern_finds():
    import regex

    rng = random.Random(2)
    _, checks = licenses._searcher()
    notices = list(licenses.NOTICES)
    for _ in range(150):
        number = rng.randrange(len(notices))
        text = list(notices[number])
        for _ in range(rng.randint(0, checks[number][2] + 2)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], ["q"], [text[at], "z"]])
        line = " ".join(("lorem ipsum " + "".join(text) + " dolor").split())
        label, length, edits, pattern, _ = checks[number]
        found = pattern.search(line)
        assert bool(found) == any(x[0] == label for x in licenses.fuzzy_notices(line) if licenses.NOTICES[notices[number]] == x[0]) or any(checks[k][0] == label and checks[k][3].search(line) for k in range(len(checks)) if k != number)
    assert regex


# 9


def near_classes(rows, similarity=0.8):
    sets = []
    for _, t in rows:
        w = lowered(t).encode().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both and both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    return [find(k) for k in range(len(rows))]


def same_partition(rows, found, got):
    mine = collections.defaultdict(set)
    for (i, _), c in zip(rows, found):
        mine[c].add(i)
    theirs = collections.defaultdict(set)
    for r in got:
        theirs[r.class_id].add(r.doc_id)
    return sorted(map(str, map(sorted_ids, mine.values()))) == sorted(map(str, map(sorted_ids, theirs.values())))


def sorted_ids(x):
    return sorted(x, key=str)


def test_near_duplicates_on_tricky_rows(docs, tricky):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(tricky) and same_partition(tricky, near_classes(tricky), got)


def test_near_duplicates_in_a_large_group(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"o{rng.randrange(10**9)}" for _ in range(80))) for i in range(50)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert same_partition(rows, near_classes(rows), got) and sum(r.kept for r in got) == len({r.class_id for r in got})


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    gaps = []
    for _ in range(20):
        u = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        a, b = rng.uniform(0.1, 4, 200), rng.uniform(0.1, 4, 200)
        s = near_dedup.dart_minhash(np.repeat([0, 1], 200), np.concatenate([u, u]), np.concatenate([a, b]), 2)
        gaps.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(gaps)) < 0.04


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (105, 101)], "a long, b long")
    assert {r.id: r.label for r in near_dedup.components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 105: 100}


# 1


def test_mixing(docs, tricky):
    rows = mixing.mix(docs, budget=0.5).collect()
    assert len(rows) == len(tricky) and all(0 <= r.probability <= 1 for r in rows)
    assert sum(r.n_tokens for r in rows) == sum(len((t or "").encode().split()) for _, t in tricky)


def test_rake_meets_margins_and_budget():
    rng = random.Random(1)
    cells = {(s, la, t): rng.randint(1, 1000) for s in "abc" for la in "xy" for t in "pqr"}
    total = sum(cells.values())
    targets = [{"a": total * 0.5, "b": total * 0.3, "c": total * 0.2}, {"x": total * 0.6, "y": total * 0.4}, {"p": total / 3, "q": total / 3, "r": total / 3}]
    f = mixing.rake(cells, targets, 200)
    for a, want in enumerate(targets):
        for v, w in want.items():
            assert sum(n * f[k] for k, n in cells.items() if k[a] == v) == pytest.approx(w, rel=1e-6)
    p = mixing.probabilities(cells, f, 0.4)
    assert sum(n * p[k] for k, n in cells.items()) == pytest.approx(0.4 * total) and max(p.values()) <= 1


def test_many_cells_are_raked_apart(docs):
    a = {r.doc_id: r.probability for r in mixing.mix(docs, rounds=6).collect()}
    b = {r.doc_id: r.probability for r in mixing.mix(docs, rounds=6, most_cells=1).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)


# all


@pytest.mark.parametrize("apply", [exact_dedup.exact_dedup, debruijn.remove_repeats, lbl.score, jpeg.media_columns, packing.pack, pii.find, licenses.license_scan, near_dedup.near_duplicates, mixing.mix,
                                   lambda d: quality.resample(d, d.select("doc_id", F.lit(True).alias("good")))])
def test_empty_table(empty, apply):
    assert apply(empty).count() == 0
