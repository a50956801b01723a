"""Operators read whole texts."""

import zlib
from collections import Counter

from tessera.llm import mixing


def test_topic_reads_the_whole_text(spark):
    bodies = [" ".join(f"w{(i * 37 + j * j) % 501}" for j in range(40 + i)) for i in range(40)]
    texts = ["The " + "same opening of a template " * 4 + b for b in bodies] + ["", "  \n\t ", "one", "One  ONE two"]

    def wanted(text):
        n = Counter(zlib.crc32(w.encode()) % mixing.TOPICS for w in set(text.lower().split()))
        return str(max(range(mixing.TOPICS), key=lambda k: (n[k], -k)))

    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.topic for r in rows.select("doc_id", mixing.topic_of(rows["text"]).alias("topic")).collect()}
    assert got == {i: wanted(t) for i, t in enumerate(texts)}
    assert len({got[i] for i in range(40)}) > 1  # all open alike
