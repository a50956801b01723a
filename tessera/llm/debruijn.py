"""Substring dedup: repeated passages by compaction of a de Bruijn graph of token k-mers.

The k-mers are windows of ``window`` consecutive words; they are the edges of the graph, and an edge that starts at two or
more places is repeated. Not every edge is sent around. Each run of windows that have the same minimizer (the least
hash of the ``ANCHOR``-word sequences in a window) is a *block*, a path of the graph known by its anchor and a hash of all
of its words; one block stands for a dozen windows. Then, by joins:

1. Anchors that occur once have no repeated windows. Anchors whose blocks are all the same have only repeated ones,
   and their path doesn't branch.
2. Where blocks of an anchor differ, occurrences diverge inside: their windows are counted one by one, by 128-bit keys. Of
   equal blocks one sends its windows, with the number of blocks it stands for.
3. Repeated edges that follow each other in a document form chains; a chain ends where an edge has several successors
   or its successor several predecessors (a branching node). Chains are compacted to unitigs: a chain that starts inside a
   longer one is given that one's head, until no head changes.
4. The source coordinates (document, first window, number of windows) of every chain are the repeated spans. The last pass
   over the texts recomputes, at those coordinates, the hashes of each chain's first edge, and fails if they aren't
   the chain's; then it removes the words that the windows cover.

Defined cases: words are those between ASCII blanks, unchanged; a null text has none, and kept_sha256 of no words is
that of the empty string; a text shorter than the window loses nothing; overlapping repeats inside one document count; repeated
rows are repeats of each other, as two documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Table, arrow_schema, blocks, column, documents, rows_to_batch, saved, text_bytes, tidy, with_text
from .words import hash_words, span_hashes, window_hashes

WINDOW = 35
ANCHOR = 10


def minimizer_blocks(h: np.ndarray, at: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Of words ``h`` of texts that begin at ``at``: (text, first window, number of windows, anchor's hash, hash of all its words).

    First windows count from each text's first word. A block's anchor stands at the same place in equal blocks, as the
    hash of its words says all of them.
    """
    n = np.diff(at)
    many = np.maximum(n - window + 1, 0)
    if not many.sum():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    grams = window_hashes(h, anchor, 7)
    span = window - anchor + 1  # anchors in a window
    pos = _sliding_argmin(grams, span)  # for each window start in the whole array
    text = np.repeat(np.arange(len(n)), many)
    first = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    start = at[:-1][text] + first
    where = pos[start]
    new = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (np.diff(where) != 0)))
    size = np.diff(np.append(new, len(text)))
    a = start[new]
    content = span_hashes(h, a, a + size + window - 1, 11)
    return text[new], first[new], size, grams[where[new]], content


def _sliding_argmin(x: np.ndarray, span: int) -> np.ndarray:
    """The place of the least of each ``span`` consecutive numbers, the first of equal ones."""
    if len(x) < span:
        return np.zeros(0, np.int64)
    best = np.arange(len(x))
    done = 1
    while done * 2 <= span:  # the least of 2, 4, 8, ... numbers
        a, b = best[:-done], best[done:]
        best = np.where(x[b] < x[a], b, a)
        done *= 2
    gap = span - done
    if gap:
        a, b = best[:-gap], best[gap:]
        best = np.where(x[b] < x[a], b, a)
    return best


_BLOCKS = "doc long, mark int, first int, size int, anchor long, content long"


def _block_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_BLOCKS)
        for batch in blocks(batches, 1 << 20):
            h, at = hash_words(text_bytes(batch))
            text, first, size, anchor, content = minimizer_blocks(h, at, window)
            keys = [batch.column(batch.schema.get_field_index(c)).take(pa.array(text)) for c in ("doc", "mark")]
            rows = [*keys, pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))]
            yield pa.RecordBatch.from_arrays(rows, schema=schema)

    return run


_WINDOWS = "doc long, mark int, first int, many boolean, k1 long, k2 long"


def _window_rows(window: int):
    """The windows of the blocks asked for, each with two hashes of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_WINDOWS)
        for batch in blocks(batches, 1 << 20):
            h, at = hash_words(text_bytes(batch))
            asked = batch.column(batch.schema.get_field_index("asked"))
            text = np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            first, size, many = (asked.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("first", "size", "many"))
            row = np.repeat(np.arange(len(first)), size)
            start = first[row] + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            keys = [window_hashes(h, window, salt)[at[:-1][text[row]] + start].view(np.int64) for salt in (3, 5)]
            ids = [batch.column(batch.schema.get_field_index(c)).take(pa.array(text[row])) for c in ("doc", "mark")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(start.astype(np.int32)), pa.array(many[row].astype(bool)), *map(pa.array, keys)], schema=schema)

    return run


_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long"


def _removed(window: int, with_text_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_OUT + ", kept string" * with_text_kept)
        for batch in blocks(batches):
            out = []
            for doc_id, text, spans in zip(column(batch, "doc_id"), text_bytes(batch), column(batch, "spans")):
                words = text.split()
                if spans:
                    _verify(text, spans, window)
                kept, end, gone, runs = [], 0, 0, 0
                for a, size in sorted({(x["first"], x["size"]) for x in spans or ()}):
                    b = a + size + window - 1
                    if a > end or not runs:
                        kept += words[end:a]
                        runs += 1
                    gone += max(0, b - max(a, end))
                    end = max(end, b)
                kept += words[end:]
                line = b" ".join(kept)
                out.append((doc_id, len(words), gone, hashlib.sha256(line).hexdigest(), runs, *((line.decode("utf-8", "replace"),) if with_text_kept else ())))
            yield rows_to_batch(out, schema)

    return run


def _verify(text: bytes, spans: list[dict], window: int) -> None:
    """The first edge of each span must be, at its coordinates, the one that the graph knows."""
    h, _ = hash_words([text])
    first = np.array([x["first"] for x in spans])
    size = np.array([x["edge"] for x in spans])
    known = np.array([x["g2"] for x in spans])
    single = size == 0  # a window of its own
    found = np.empty(len(spans), np.int64)
    found[single] = window_hashes(h, window, 5)[first[single]].view(np.int64)
    found[~single] = span_hashes(h, first[~single], first[~single] + size[~single] + window - 1, 11).view(np.int64)
    if (found != known).any():
        raise ValueError("a span's words are not those of its unitig")


def _keyed(docs: DataFrame, **cols) -> DataFrame:
    """(doc, mark, doc_id, text): rows with the same doc and mark have the same text, for all that matters."""
    return with_text(docs, **cols).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.hash("text").alias("mark"), "doc_id", "text")


def repeated_edges(base: DataFrame, window: int = WINDOW) -> Table:
    """(doc, mark, first, size, edge, g1, g2, junction): the repeated windows of each document, as blocks where possible.

    edge: the block's number of windows, 0 for a single window; (g1, g2): what it is; junction: occurrences diverge in it.
    """
    spark = base.sparkSession
    every = Table(base.select("doc", "mark", "text").mapInArrow(_block_rows(window), _BLOCKS))
    # written first: a join with a table, not with an aggregate, can split the rows of a very frequent anchor
    anchors = Table(every.df.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi")).where("n > 1").select("anchor", F.expr("lo <> hi").alias("junction")))
    tidy(spark)
    held = Table(every.df.join(anchors.df, "anchor"))
    rows = held.df
    tidy(spark, every, anchors)
    kinds = Table(rows.where("junction").groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("doc", "mark", "first", "size")).alias("at")))
    alike = kinds.df
    one = rows.select("doc", "mark", "first", "size", F.col("size").alias("edge"), F.col("anchor").alias("g1"), F.col("content").alias("g2"), "junction")
    plain = one.where("not junction")
    met = one.where("junction").join(alike.where("n > 1").select(F.col("anchor").alias("g1"), F.col("content").alias("g2")), ["g1", "g2"]).select(*one.columns)
    asked = alike.select("at.doc", "at.mark", F.struct(F.col("at.first").alias("first"), F.col("at.size").alias("size"), (F.col("n") > 1).alias("many")).alias("x")).groupBy("doc", "mark").agg(F.collect_list("x").alias("asked"))
    windows = Table(base.select("doc", "mark", "text").join(asked, ["doc", "mark"]).mapInArrow(_window_rows(window), _WINDOWS))
    tidy(spark)
    counts = Table(windows.df.groupBy("k1", "k2").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("c")).where("c > 1").select("k1", "k2"))
    tidy(spark)
    single = windows.df.where("not many").join(counts.df, ["k1", "k2"]).select("doc", "mark", "first", F.lit(1).alias("size"), F.lit(0).alias("edge"), F.col("k1").alias("g1"), F.col("k2").alias("g2"), F.lit(True).alias("junction"))
    # rows that are the same document give the same edges
    out = Table(plain.unionByName(met).unionByName(single).dropDuplicates(["doc", "mark", "first"]))
    tidy(spark, held, kinds, windows, counts)
    return out


def unitigs(found: Table) -> DataFrame:
    """(doc, mark, first, size, edge, g2, u1, u2): chains of edges that don't branch, with their unitig's head (u1, u2)."""
    spark, order = found.spark, Window.partitionBy("doc", "mark").orderBy("first")
    before = F.lag(F.struct("g1", "g2", (F.col("first") + F.col("size")).alias("next"), "junction")).over(order)
    linked = Table(found.df.withColumn("p", before).withColumn("linked", F.coalesce((F.col("p.next") == F.col("first")) & ~F.col("p.junction") & ~F.col("junction"), F.lit(False)))
                   .select("doc", "mark", "first", "size", "edge", "g1", "g2", "linked", F.col("p.g1").alias("p1"), F.col("p.g2").alias("p2")))
    tidy(spark, found)
    pairs = linked.df.where("linked").select("p1", "p2", "g1", "g2")
    ahead, back = F.struct("g1", "g2"), F.struct("p1", "p2")
    # nodes with one way out, and with one way in
    out = pairs.groupBy("p1", "p2").agg(F.min(ahead).alias("a"), F.max(ahead).alias("b")).where("a = b").select("p1", "p2", F.col("a.g1").alias("g1"), F.col("a.g2").alias("g2"))
    into = pairs.groupBy("g1", "g2").agg(F.min(back).alias("a"), F.max(back).alias("b")).where("a = b").select("g1", "g2")
    straight = saved(out.join(into, ["g1", "g2"]).select("g1", "g2", F.lit(True).alias("straight")))
    marked = linked.df.join(straight, ["g1", "g2"], "left").withColumn("starts", F.when(F.col("linked") & F.col("straight"), 0).otherwise(1))
    chained = Table(marked.withColumn("chain", F.sum("starts").over(order)).select("doc", "mark", "chain", "first", "size", "edge", "g1", "g2"))
    tidy(spark, linked)
    chains = saved(chained.df.groupBy("doc", "mark", "chain").agg(F.min(F.struct("first", "edge", "g1", "g2")).alias("s"), F.sum("size").alias("size")))
    # a chain's head may be inside another document's chain: the unitig goes on to the left
    heads = saved(chains.select(F.col("s.g1").alias("g1"), F.col("s.g2").alias("g2")).distinct().join(straight.select("g1", "g2"), ["g1", "g2"]))
    within = chained.df.join(heads, ["g1", "g2"]).join(chains.select("doc", "mark", "chain", "s"), ["doc", "mark", "chain"]).where("first > s.first")
    jump = saved(within.groupBy("g1", "g2").agg(F.max(F.struct(F.expr("first - s.first").alias("back"), F.col("s.g1").alias("h1"), F.col("s.g2").alias("h2"))).alias("j")).select("g1", "g2", "j.h1", "j.h2"))
    tidy(spark, chained)
    for _ in range(40):  # doubles each time; a closed ring of edges never settles, and any of its edges may stand for it
        further = jump.select(F.col("g1").alias("h1"), F.col("g2").alias("h2"), F.col("h1").alias("f1"), F.col("h2").alias("f2"))
        step = saved(jump.join(further, ["h1", "h2"], "left").select("g1", "g2", F.coalesce("f1", "h1").alias("h1"), F.coalesce("f2", "h2").alias("h2"), F.expr("f1 is not null and not (f1 = g1 and f2 = g2)").alias("moved")))
        jump = step.select("g1", "g2", "h1", "h2")
        if not step.where("moved").limit(1).count():
            break
    named = chains.select("doc", "mark", "s.first", "size", "s.edge", "s.g1", "s.g2").join(jump, ["g1", "g2"], "left")
    return named.select("doc", "mark", "first", "size", "edge", "g2", F.coalesce("h1", "g1").alias("u1"), F.coalesce("h2", "g2").alias("u2"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, **cols) -> DataFrame:
    """(doc_id, first_word, n_words, unitig): where long repeats stand; spans of a unitig hold the same passage or a part of it."""
    found = unitigs(repeated_edges(_keyed(docs, **cols), window))
    return found.select(F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias("doc_id"), F.col("first").alias("first_word"), (F.col("size") + window - 1).alias("n_words"), F.concat_ws(":", "u1", "u2").alias("unitig"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_kept: bool = False, **cols) -> DataFrame:
    """``_OUT`` for each document: its words without those in repeated windows; with the kept text if asked for."""
    base = _keyed(docs, **cols)
    spans = saved(unitigs(repeated_edges(base, window)))
    tidy(docs.sparkSession)
    listed = spans.groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "size", "edge", "g2")).alias("spans"))  # of one document
    ddl = _OUT + ", kept string" * with_kept
    return base.join(listed, ["doc", "mark"], "left").select("doc_id", "text", "spans").mapInArrow(_removed(window, with_kept), ddl)


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


#: Of a unitig's spans only their number in a document is told: runs of removed words that don't touch.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT rid, k, array_to_string(w[k:k + {WINDOW - 1}], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS k FROM d)),
repeated AS (SELECT rid, k FROM (SELECT rid, k, count(*) OVER (PARTITION BY s) AS c FROM windows) WHERE c > 1),
gone AS (SELECT DISTINCT rid, unnest(range(k, k + {WINDOW})) AS i FROM repeated),
runs AS (SELECT rid, count(*) AS n_spans FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM gone) WHERE before IS NULL OR before < i - 1 GROUP BY rid),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid),
counts AS (SELECT rid, count(*) AS n_removed FROM gone GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN counts USING (rid) LEFT JOIN kept USING (rid) LEFT JOIN runs USING (rid)
"""
