"""License scans: exact phrases, and short notices with a bounded number of edits.

A notice that may have k edits is split into k + 1 pieces; one of them must occur unchanged (pigeonhole). One
Aho-Corasick pass finds those seeds. An edit changes three trigrams at most, so a window that lacks more of the notice's
trigrams than 3 k can't hold it; the regex library's bounded-error matching checks the other windows and reports spans and errors. Each
place of a seed is a window of its own, too short for two matches that don't overlap, so its best match is all it can
add; of matches of one notice that overlap, the one with the fewest edits, then the first, stays. A text is read whole, as its words
joined by one space, so that punctuation and line breaks inside a notice don't matter. Time is in proportion to text and seeds.

Defined cases: a null text is empty: no words, null first_word and last_word, empty labels and spans, score 0; notices that overlap are
reported each, a phrase inside a notice too; repeated rows give repeated results; an empty table gives no rows; a null
identifier is passed on; other columns are ignored, whatever their names; very long texts are read whole.
"""

from __future__ import annotations

from bisect import bisect
from functools import cache

from pyspark.sql import DataFrame

from .common import documents, per_document, with_text

#: Phrases that count wherever their words stand consecutively.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices that are also found with a few edits, as lower-case words.
NOTICES = {
    "gnu affero general public license": "agpl-3.0",
    "licensed under the apache license version 2 0": "apache-2.0",
    "distributed under the boost software license version 1 0": "bsl-1.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "creative commons attribution sharealike": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "released under the cc0 1 0 universal public domain dedication": "cc0-1.0",
    "made available under the terms of the eclipse public license": "epl",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "gnu lesser general public license": "lgpl",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this software is provided as is without any express or implied warranty": "zlib",
}
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 9

#: A-Z lowered, other ASCII that is no letter or digit to blanks; bytes from 0x80 belong to words.
_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
FIELDS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
SPANS = ", n_fuzzy long, edits long, spans string"


@cache
def _searcher():
    import ahocorasick
    import regex

    seeds = ahocorasick.Automaton()
    held: dict[str, list] = {}
    for number, notice in enumerate(NOTICES):
        edits = len(notice) // CHARS_PER_EDIT
        cuts = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
        for a, b in zip(cuts, cuts[1:]):
            held.setdefault(notice[a:b], []).append((number, a))
    for seed, places in held.items():
        seeds.add_word(seed, (len(seed), places))
    seeds.make_automaton()
    # (?b): the best match in the window, not the first within the bound
    checks = [(label, len(notice), len(notice) // CHARS_PER_EDIT, regex.compile(f"(?b)(?<![^ ])(?:{regex.escape(notice, special_only=True, literal_spaces=True)}){{e<={len(notice) // CHARS_PER_EDIT}}}(?![^ ])"), [notice[i : i + 3] for i in range(len(notice) - 2)]) for notice, label in NOTICES.items()]
    return seeds, checks


def fuzzy_notices(words: str) -> list[tuple[str, int, int, int, float]]:
    """(label, start, end, edits, similarity) in a text of words joined by one space; of overlapping finds of a notice the best."""
    seeds, checks = _searcher()
    windows = set()
    for end, (size, places) in seeds.iter(words):
        for number, offset in places:
            _, length, edits, _, _ = checks[number]
            at = end + 1 - size - offset
            a, b = words.rfind(" ", 0, max(0, at - edits)) + 1, words.find(" ", at + length + edits)
            windows.add((number, a, b if b >= 0 else len(words)))
    found: dict[int, set] = {}
    for number, a, b in windows:
        label, length, edits, pattern, grams = checks[number]
        window = words[a:b]
        if sum(g not in window for g in grams) <= 3 * edits and (m := pattern.search(words, a, b)):
            found.setdefault(number, set()).add((sum(m.fuzzy_counts), m.start(), m.end()))
    out = []
    for number, matches in found.items():
        label, length = checks[number][:2]
        starts, ends = [], []
        for wrong, a, b in sorted(matches):
            k = bisect(starts, a)
            if (k == 0 or ends[k - 1] <= a) and (k == len(starts) or starts[k] >= b):
                starts.insert(k, a)
                ends.insert(k, b)
                out.append((label, a, b, wrong, 1 - wrong / length))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan(text: bytes) -> dict:
    """What one whole text holds: base places, spans of notices, labels."""
    words = text.translate(_TABLE).split()
    line = b" " + b" ".join(words) + b" "
    starts, base = [], set()
    for phrase, label in PHRASES.items():
        find, at, before, word = b" " + phrase.encode() + b" ", -1, 0, 0
        while (at := line.find(find, at + 1)) >= 0:
            word, before = word + line.count(b" ", before, at), at
            starts.append(word)
            base.add(label)
    spans = fuzzy_notices(line[1:-1].decode("utf-8", "replace"))
    return {"n_words": len(words), "places": sorted(starts), "base": sorted(base), "spans": spans,
            "labels": sorted(base | {x[0] for x in spans}), "score": 1.0 if base else max((x[4] for x in spans), default=0.0)}


def _digest(doc_id, text: bytes) -> tuple:
    x = scan(text)
    base = (doc_id, x["n_words"], len(x["places"]), x["places"][0] if x["places"] else None, x["places"][-1] if x["places"] else None, ",".join(x["base"]), ",".join(x["labels"]), x["score"])
    return *base, len(x["spans"]), sum(y[3] for y in x["spans"]), ",".join(f"{label}:{a}:{b}:{wrong}" for label, a, b, wrong, _ in x["spans"])


def license_spans(docs: DataFrame, **cols) -> DataFrame:
    """(doc_id, label, start, end, edits, similarity): one row for each notice found; offsets into the words joined by one space."""

    def run(batches):
        from .common import arrow_schema, blocks, column, rows_to_batch, text_bytes

        schema = arrow_schema("doc_id long, label string, start long, end long, edits long, similarity double")
        for batch in blocks(batches):
            yield rows_to_batch([(i, *x) for i, t in zip(column(batch, "doc_id"), text_bytes(batch)) for x in scan(t)["spans"]], schema)

    return with_text(docs, **cols).mapInArrow(run, "doc_id long, label string, start long, end long, edits long, similarity double")


def license_scan(docs: DataFrame, with_spans: bool = False, **cols) -> DataFrame:
    """One row of ``FIELDS`` for each document; with ``SPANS`` too: label:start:end:edits of each notice found, offsets into the words joined by one space."""
    told = with_text(docs, **cols).mapInArrow(per_document(FIELDS + SPANS, _digest), FIELDS + SPANS)
    return told if with_spans else told.drop("n_fuzzy", "edits", "spans")


def query(spark, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir), with_spans=True)
