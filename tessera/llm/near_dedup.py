"""Near-duplicates by DartMinHash signatures, banded joining and exact checks.

Each unit of an element's weight is a region at which a hashed Poisson process throws darts; a dart's arrival
is its rank, its identity a hash. A document looks at darts up to a rank that lets about k ln k + 2 k of them hit its
regions, assigns them to the k coordinates by their hash, and keeps the earliest of each. Two documents agree in a
coordinate with the probability of their weighted Jaccard similarity. Coordinates are joined to bands; documents that
agree in a whole band are candidates. Elements are shingles of five words, of weight 1 or their count.

Rows whose words are the same are one text. In a band's bucket each text meets one leader, the text that stands in the
fullest buckets; signatures must agree in enough coordinates, then the shingle multisets are compared as a whole. Checked links make
classes. Only texts that share a bucket with a text of another class, neither being its leader, go on: they meet where they share
one of the rare shingles that similar texts must share (``_residual``), and are checked alike. So of any two texts in a bucket
either a pair was ruled out or checked, or they are in one class: no link is lost, and a large group of copies costs a star.

Defined cases: words are those between ASCII blanks, with A-Z lowered; a text of fewer than five words has all of them as
its one shingle; texts without words (null among them) are one class; repeated rows and equal texts are one class, and one row
of a class is kept: the one with the smallest identifier, then text hash, then any one of rows that repeat as a whole. Rows
without identifier are compared as all others; a class without any identifier is known by a negative number, texts of it have a null
text_id. Rows that share an identifier but not their words are
texts apart: their classes may have the same class_id, never the same class_key. An empty table gives no rows; other columns are
ignored, whatever their names; very long texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, arrow_schema, blocks, documents, saved, text_bytes, tidy, with_text
from .words import hash_words, mixed, span_hashes, window_hashes

#: SQL for the class of a text in a table of 2^24 bits.
_PLACE = f"(mark & {(1 << 24) - 1}L)"
SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 64


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of every shingle, in order, repeats included."""
    return _shingled(*hash_words([t.lower() for t in texts]), size)


def _shingled(h: np.ndarray, starts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(starts)
    every = window_hashes(h, size)
    many = np.maximum(n - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), many)
    offset = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    wide = every[np.repeat(starts[:-1], many) + offset] if len(doc) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < size))
    return np.concatenate([doc, short]), np.concatenate([wide, span_hashes(h, starts[:-1][short], starts[1:][short])])


def weights(doc: np.ndarray, element: np.ndarray, counted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, element) with their weights."""
    if not len(doc):
        return doc, element, np.zeros(0)
    order = np.lexsort((element, doc))
    doc, element = doc[order], element[order]
    new = np.append(True, (np.diff(doc) != 0) | (element[1:] != element[:-1]))
    at = np.flatnonzero(new)
    return doc[at], element[at], np.diff(np.append(at, len(doc))).astype(float) if counted else np.ones(len(at))


_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def dart_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int = COORDINATES) -> np.ndarray:
    """(n_docs, k) identities of the earliest darts; weights may be any positive numbers. Rows without elements are 0."""
    out = np.zeros((n_docs, k), np.uint64)
    if not len(doc):
        return out
    # unit regions: an element of weight 2.5 has three, darts in the last count below 0.5
    units = np.ceil(weight).astype(np.int64)
    part = np.repeat(np.arange(len(doc)), units)
    nth = np.arange(int(units.sum())) - np.repeat(np.cumsum(units) - units, units)
    cell = mixed(element[part] + _GOLD * (nth.astype(np.uint64) + np.uint64(1)))
    owner, room = doc[part], np.minimum(weight[part] - nth, 1.0)
    total = np.bincount(owner, room, n_docs)
    reach = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    todo = total > 0
    while todo.any():
        live = np.flatnonzero(todo[owner])
        o, c, r = owner[live], cell[live], room[live]
        rank, step = np.zeros(len(live)), 0
        keys, ranks, ids = [], [], []
        while len(o):
            step += 1
            dart = mixed(c + np.uint64(int(_GOLD) * step % (1 << 64)))
            rank = rank - np.log(_uniform(dart))  # the next arrival
            hit = rank < reach[o]
            o, c, r, rank, dart = o[hit], c[hit], r[hit], rank[hit], dart[hit]
            name = mixed(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            inside = _uniform(mixed(name)) < r
            keys.append((o * k + (name % np.uint64(k)).astype(np.int64))[inside])
            ranks.append(rank[inside])
            ids.append(name[inside])
        key, rank, name = map(np.concatenate, (keys, ranks, ids))
        order = np.lexsort((name, rank, key))
        key, name = key[order], name[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        full = np.bincount(key[first] // k, minlength=n_docs) == k
        keep = first[full[key[first] // k]]
        out[key[keep] // k, key[keep] % k] = name[keep]
        todo &= ~full
        reach[todo] *= 2  # an empty coordinate: look further
    return out


def band_hashes(signature: np.ndarray, bands: int = 16) -> np.ndarray:
    rows = signature.reshape(len(signature), bands, -1)
    h = np.zeros(rows.shape[:2], np.uint64)
    for r in range(rows.shape[2]):
        h = mixed(h * _GOLD + rows[:, :, r])
    return mixed(h + _GOLD * np.arange(1, bands + 1, dtype=np.uint64))


_KEYED = "doc_id long, row long, mark long, t1 long, t2 long, signature binary, bands array<long>"


def _keyed(counted: bool, bands: int):
    """Of each row: a number of its own in random order, a 128-bit hash of its words, its signature and bands (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_KEYED)
        for batch in blocks(batches, 1 << 20):
            texts, of = text_bytes(batch), batch.schema.get_field_index
            h, at = hash_words([t.lower() for t in texts])
            doc, element, weight = weights(*_shingled(h, at), counted)
            signature = dart_minhash(doc, element, weight, len(texts))
            real = np.diff(at) > 0
            named = [pa.array(list(band_hashes(signature, bands).view(np.int64)), pa.list_(pa.int64())), pa.array([x.tobytes() for x in signature.astype("<u2")], pa.binary())]  # 16 bits of a coordinate tell if it agrees
            named = [pa.compute.if_else(pa.array(real), x, pa.scalar(None, x.type)) for x in named]
            row = mixed(batch.column(of("row")).to_numpy(zero_copy_only=False).astype(np.uint64)).view(np.int64)
            words = [pa.array(span_hashes(h, at[:-1], at[1:], salt).view(np.int64)) for salt in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(of("doc_id")).cast(pa.int64()), pa.array(row), batch.column(of("mark")), *words, named[1], named[0]], schema=schema)

    return run


def _sets(counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted shingle hashes of each text; a shingle of weight w stands w times, as itself and its successors."""
        schema = arrow_schema("id long, shingles array<long>")
        for batch in blocks(batches, 1 << 20, "text"):
            texts = text_bytes(batch)
            doc, element, weight = weights(*shingles(texts), counted)
            many = weight.astype(np.int64)
            nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            unit = np.repeat(element, many) + nth.astype(np.uint64) * _GOLD
            edges = np.searchsorted(np.repeat(doc, many), np.arange(len(texts) + 1))
            sets = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(unit.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), sets], schema=schema)

    return run


def _agreeing(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            near = (a == b).sum(1) >= least if batch.num_rows else np.zeros(0, bool)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


def _scattered(x: str) -> str:
    """SQL for a bijection of longs that leaves no order: four Feistel rounds on halves of 32 bits."""
    low, high = f"({x} & 4294967295L)", f"shiftrightunsigned({x}, 32)"
    for k in (0x5BD1E995, 0x2C1B3C6D, 0x297A2D39, 0x7FEB352D):
        low, high = f"({high} ^ (shiftrightunsigned({low} * {k}L, 13) & 4294967295L))", low
    return f"(shiftleft({high}, 32) | {low})"


def components(edges: DataFrame, scattered: bool = False) -> DataFrame:
    """(id, label): the smallest id that edges (a, b) join each id to; only ids with edges.

    Each id goes to the least of its neighbours and itself, and edges go along, until none is left between two ids: a star
    is gone in two rounds, a path in a number that grows with the logarithm of its length, as long as ids are in random order.
    scattered: they are. Every join is of two tables or exchanges with one row for an id in the second, so that adaptive execution
    splits the rows of a hub.
    """
    if not scattered:
        first = edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("id"), F.expr(_scattered("a")).alias("x"))
        found = first.join(components(edges.select(*(F.expr(_scattered(c)).alias(c) for c in "ab")), True).withColumnRenamed("id", "x"), "x")
        least = saved(found.groupBy("label").agg(F.min("id").alias("least")))
        return found.join(least, "label").select("id", F.col("least").alias("label"))
    left = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    gone = None
    while True:
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("to")))
        if gone is None:
            gone = step.withColumnRenamed("to", "label")
        else:
            gone = saved(gone.join(step.withColumnRenamed("id", "label"), "label", "left").select("id", F.coalesce("to", "label").alias("label")))
        half = left.join(step.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a").select("ta", "b")
        moved = half.join(step.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b").where("ta <> tb")
        left = saved(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        if left.isEmpty():
            return gone


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float, *more: str) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are as similar as asked."""
    first, second = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"x{c}")) for c in "ab")
    both = pairs.join(first, "a").join(second, "b").select("a", "b", *more, F.size(F.array_intersect("xa", "xb")).alias("c"), (F.size("xa") + F.size("xb")).alias("s"))
    return saved(both.where(F.col("c") >= F.lit(similarity - 1e-9) * (F.col("s") - F.col("c"))).select("a", "b", *more))


def _residual(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """(la, lb): classes that checked links join, of texts that share a bucket with another class and haven't both met.

    rows: (bucket, id, label) without leaders. A text's shingles are ordered by how many of these texts hold them, those
    that only its own class holds first. Two texts of n and m shingles that are similar enough have one of their first
    n - similarity n + 1 and m - similarity m + 1 in common, and enough after it: only such meet.
    """
    apart = saved(rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket"))
    if apart.isEmpty():
        return None
    some = rows.join(apart, "bucket").select("id", "label").distinct()
    held = saved(sets.join(some, "id").select("id", "label", F.size("shingles").alias("n"), "shingles"))
    each = held.select("id", "label", "n", F.explode("shingles").alias("s"))
    across = saved(each.groupBy("s").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("s", "df"))
    need = F.ceil(F.lit(similarity - 1e-9) * F.col("n"))
    tidy(sets.sparkSession)
    mine = each.join(across, "s").groupBy("id", "label", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("x")).where(F.size("x") >= need)  # of one text
    # place: where the shingle stands in the text's order, from 0
    first = F.slice("x", 1, (F.size("x") - need + 1).cast("int"))
    listed = saved(mine.select("id", "label", "n", F.size("x").alias("c"), F.posexplode(first).alias("k", "y")).select("id", "label", "n", F.col("y.s").alias("s"), (F.col("n") - F.col("c") + F.col("k")).alias("place")))
    a, b = (listed.select("s", F.col("id").alias(c), F.col("label").alias(f"l{c}"), F.col("n").alias(f"n{c}"), F.col("place").alias(f"p{c}")) for c in "ab")
    enough = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) * F.lit((1 + similarity) / similarity + 1e-9) >= F.col("na") + F.col("nb")
    pairs = saved(a.join(b, "s").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & enough).select("a", "b", "la", "lb").distinct())
    return _checked(pairs, held, similarity, "la", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))


def shape_for(similarity: float) -> tuple[int, int]:
    """(bands, prefilter): the fewest bands that a pair at the threshold misses with a probability under 0.001; coordinates that agree all but surely."""
    bands = next(b for b in (4, 8, 16, 32, 64) if (1 - similarity ** (COORDINATES // b)) ** b < 1e-3)
    return bands, max(0, int(COORDINATES * similarity - 5.3 * (COORDINATES * similarity * (1 - similarity)) ** 0.5))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, weight: str = "count", **cols) -> DataFrame:
    """(doc_id, text_id, class_id, class_size, kept, mark, class_key), a row for each row of ``docs``.

    text_id: the smallest identifier of the same words; class_id: the smallest of the class, one of whose rows with it is kept;
    mark: xxhash64 of the text, to tell rows of one identifier apart; class_key: a number of the class's own, the same for no two.
    weight: "count" weighs a shingle by how often it stands, "set" compares sets.
    """
    counted, (bands, prefilter) = weight == "count", shape_for(similarity)
    base = with_text(docs, **cols).withColumn("mark", F.xxhash64("text"))
    keyed = saved(base.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_keyed(counted, bands), _KEYED))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "row"))
    one = F.min(F.struct("row", "doc_id", "mark", "signature", "bands"))  # of rows with the same words
    nodes = saved(keyed.groupBy("t1", "t2").agg(one.alias("one"), F.count("*").alias("copies"), best.alias("best")).select(F.col("one.row").alias("id"), "t1", "t2", "copies", "best", "one"))
    tidy(base.sparkSession)
    labels = _labels(base, nodes, similarity, counted, prefilter)
    tidy(base.sparkSession)
    if labels is not None:
        texts = nodes.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    else:
        texts = nodes.withColumn("label", F.col("id"))
    texts = saved(texts)
    classes = saved(texts.groupBy("label").agg(F.sum("copies").alias("class_size"), F.min("best").alias("first")))
    told = saved(texts.join(classes, "label").select("t1", "t2", F.col("best.doc_id").alias("text_id"), F.coalesce("first.doc_id", F.least(F.col("label"), -F.col("label") - 1)).alias("class_id"), "class_size", F.col("first.row").alias("first_row")))
    out = keyed.join(told, ["t1", "t2"])
    return out.select("doc_id", "text_id", "class_id", "class_size", (F.col("row") == F.col("first_row")).alias("kept"), "mark", F.col("first_row").alias("class_key"))


def _labels(base: DataFrame, nodes: DataFrame, similarity: float, counted: bool, prefilter: int) -> DataFrame | None:
    """(id, label) of texts in classes of several; None without any candidates."""
    # aggregates are written before rows are joined with them: the join can then split a full bucket's rows
    marks = nodes.select("id", F.explode("one.bands").alias("bucket"))
    shared = Table(marks.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    if shared.df.isEmpty():
        return None
    rows = Table(marks.join(shared.df, "bucket"))
    tidy(base.sparkSession, shared)
    hubs = rows.df.groupBy("id").agg(F.sum("n").alias("hub"))
    known = saved(hubs.join(nodes.select("id", F.coalesce("one.doc_id", F.lit(-(1 << 63))).alias("doc"), "one.mark", "one.signature"), "id"))
    places = Table(rows.df.join(known.select("id", "hub", "signature"), "id"))
    # a bucket's members meet its leader, the one that stands in the fullest buckets
    leaders = Table(places.df.groupBy("bucket").agg(F.max(F.struct("hub", "id", "signature")).alias("top")).select("bucket", F.col("top.id").alias("a"), F.col("top.signature").alias("sa")))
    met = Table(places.df.join(leaders.df, "bucket").where("id <> a").select("bucket", "n", "a", F.col("id").alias("b"), "sa", F.col("signature").alias("sb")))
    tidy(base.sparkSession, rows, places, leaders)
    near = saved(met.df.select("a", "b", "sa", "sb").mapInArrow(_agreeing(prefilter), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # a bucket of two is done; texts of larger ones may have partners beside the leader
    rest = saved(met.df.where("n > 2").select("bucket", F.col("b").alias("id")))
    shown = saved(known.select("id", "doc", "mark").join(rest.select("id").union(near.select("a")).union(near.select("b")), "id", "left_semi"))
    tidy(base.sparkSession, met)
    # a bit for each of 2^24 classes of texts, 64 in a row: most other texts needn't travel to the join
    words = saved(shown.groupBy(F.expr(f"shiftright({_PLACE}, 6)").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast({_PLACE} & 63 as int)))").alias("bits")))
    some = base.withColumn("word", F.expr(f"shiftright({_PLACE}, 6)")).join(F.broadcast(words), "word").where(F.expr(f"shiftright(bits, cast({_PLACE} & 63 as int)) & 1L = 1L"))  # 2^18 rows at most
    texts = some.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), "mark", "text").join(shown, ["doc", "mark"]).groupBy("id").agg(F.min("text").alias("text"))  # rows that repeat, once
    sets = saved(texts.mapInArrow(_sets(counted), "id long, shingles array<long>"))
    tidy(base.sparkSession)
    links = _checked(near, sets, similarity)
    labels = None if links.isEmpty() else components(links, True)
    tidy(base.sparkSession)
    rest = rest.withColumn("label", F.col("id")) if labels is None else saved(rest.join(labels, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label")))
    more = _residual(rest, sets, similarity)
    if more is None or more.isEmpty():
        return labels
    joined = components(more, True)
    if labels is None:
        return joined
    both = labels.join(joined.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    return saved(both.union(joined.join(labels.select("id"), "id", "left_anti").select("id", "label")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
