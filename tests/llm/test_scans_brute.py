"""Licence and personal-data scans against brute force in plain Python."""

import hashlib
import random
import re
import time

from tessera.llm import licenses, pii

SF = "/root/testdata/sf0.001"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_every_notice_of_a_list_is_found():
    line = "released undr the mit license x y released under the mit license and released under the mt lisense"
    got = [(line[a:b], wrong) for label, a, b, wrong, _ in licenses.fuzzy_notices(line) if label == "mit"]
    assert got == [("released undr the mit license", 1), ("released under the mit license", 0), ("released under the mt lisense", 2)]
    assert len(licenses.fuzzy_notices("released under the mit licence released under the mit license")) == 2


def test_spans_and_edits_by_brute_force():
    """Notices with a few edits between other words: found where they were put, or nearer, with as few edits."""
    rng, notices = random.Random(4), list(licenses.NOTICES)
    for _ in range(120):
        parts, put = [], []
        for _ in range(rng.randint(1, 4)):
            notice = rng.choice(notices)
            text = list(notice)
            for _ in range(rng.randint(0, len(notice) // licenses.CHARS_PER_EDIT)):
                at = rng.randrange(len(text))
                if text[at] != " ":
                    text[at : at + 1] = rng.choice([["q"], [text[at], "z"]])
            at = sum(len(x) + 1 for x in parts)
            put.append((licenses.NOTICES[notice], notice, at, at + len(text)))
            parts += ["".join(text), "lorem ipsum dolor sit"]
        line = " ".join(parts)
        got = licenses.fuzzy_notices(line)
        for label, a, b, wrong, _ in got:
            assert wrong == min(edit_distance(line[a:b], n) for n, x in licenses.NOTICES.items() if x == label)
        for label, notice, a, b in put:
            assert any(x[0] == label and x[1] < b and a < x[2] and x[3] <= edit_distance(line[a:b], notice) for x in got), (line, notice)


def test_base_places_by_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(["Cc-BY cc by CC. BY", "cc by cc by", "x", "general Public\nlicense all rights reserved", "all rights-reserved. All, rights; reserved"] * 2)] + [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted = []
    for i, t in rows:
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            parts = phrase.encode().split()
            for k in range(len(words)):
                if words[k : k + len(parts)] == parts:
                    places.append(k)
                    labels.add(label)
        wanted.append((i, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, wanted))


def test_many_phrases_take_time_in_proportion():
    def took(n):
        began = time.perf_counter()
        assert len(licenses.scan(b"cc by " * n)["places"]) == n
        return time.perf_counter() - began

    took(1000)
    assert took(80_000) < 12 * max(took(20_000), 0.01)


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data_by_brute_force(spark):
    rng = random.Random(8)
    bits = ["a@b.co", "@", ".", "-", "1.2.3.4", "+1 (555) 123-4567", "4111 1111 1111 1111", "5500-0000-0000-0004", "x", " ", "  ", "é", "7", "12", "+", "%", "\U0001f600", "999.1.1.1", "a.b@c-d.e.f"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(1500)] + [(5000 + r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        want = base_spans(text or "")
        assert [(pii.KINDS[x.k], x.s, x.e) for x in found[i].base] == want, text
        assert {(x.k, x.s, x.e) for x in found[i].base} <= {(x.k, x.s, x.e) for x in found[i].spans}
        for x in found[i].spans:  # added ones touch no base span
            mine = (pii.KINDS[x.k], x.s, x.e)
            assert mine in want or all(x.e <= s or e <= x.s for _, s, e in want)
    line = ",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id = 3").first().text or ""))
    assert pii.query(spark, SF).where("doc_id = 3").first().base_sha256 == hashlib.sha256(line.encode()).hexdigest()


def test_expectation_maximisation_by_brute_force(spark):
    spans = pii.candidates(spark.read.parquet(f"{SF}/documents.parquet"))
    models = {r.k: r for r in pii.train(spans).copy()}
    votes = {}
    for r in spans.where("spans is not null").collect():
        for x in r.spans:
            votes.setdefault(x.k, []).append(x.v)
    for k, seen in votes.items():
        pi, a, b = 0.7, [0.95, 0.8, 0.4, 0.9], [0.05, 0.4, 0.1, 0.5]
        for _ in range(25):
            post = []
            for v in seen:
                one, none = pi, 1 - pi
                for j in range(4):
                    one, none = one * (a[j] if v[j] else 1 - a[j]), none * (b[j] if v[j] else 1 - b[j])
                post.append(one / (one + none))
            n = sum(post)
            pi = (n + 1) / (len(seen) + 2)
            a = [(sum(p for p, v in zip(post, seen) if v[j]) + 1.2) / (n + 2) for j in range(4)]
            b = [(sum(1 - p for p, v in zip(post, seen) if v[j]) + 0.5) / (len(seen) - n + 2) for j in range(4)]
        assert abs(models[k].pi - pi) < 1e-9 and all(abs(x - y) < 1e-9 for x, y in zip([*models[k].a, *models[k].b], [*a, *b]))


def test_many_spans_in_one_text(spark):
    text = " ".join(f"mail a{i}@b.co at {i % 256}.1.2.{i % 300}" for i in range(4000))
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(pii.KINDS[x.k], x.s, x.e) for x in row.base] == base_spans(text)
