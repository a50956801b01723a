"""Language-model scoring: a log-bilinear neural model trained by noise-contrastive estimation.

Training words are ranked by their counts. The first sqrt(V) of V distinct words are leaves of their own, so the model grows with
the vocabulary that the corpus shows; the others share hash leaves, one for 16 own ones; the end of a text is the last leaf.
Leaves stand in groups of about as many as there are groups, and a token's probability has two log-bilinear factors and a share:

    h = C1 * r[b] + C2 * r[a]                               (a, b: the leaves of the two tokens before)
    P(group | h) = softmax(q1 . h + b1),  P(leaf | group, h) = softmax of q2 . h + b2 over the group's leaves
    P(word | leaf) = 1 for own words, (count + 1) / (total + distinct + 1) in a hash leaf; unseen words share one place

Each factor adds up to 1, so token probabilities are normalised over all words at any vocabulary. All numbers are learned in
numpy by noise-contrastive estimation: seen groups (leaves of a group) against noise from their frequencies, the noise
shared by a batch, so that scores and gradients are matrix products. Biases begin at the log frequencies.

Documents are dealt into chunks by a hash of identifier and text, whatever their partitions, and stored bucketed by chunk:
training and scoring read them where they are. Every chunk's training documents train a copy of the model from the chunk's own
seed; copies are averaged by their tokens, in two steps of bounded groups. Nothing is sampled. Scoring meets each chunk with the counts of just
its words. Words are known by 64-bit hashes of their bytes.

Bounds: a chunk holds 16 MB, or 16 bytes times the square root of all bytes if that is more (160 MB of 100 TB); a model, which is
broadcast, has ``MOST_OWN`` own leaves at most (some 20 MB), reached at 17 billion distinct words.

Defined cases: a null or empty text is one end token; a null identifier counts as the text "null"; repeated rows count each and score
alike; of words with equal counts those with the smaller hash rank first; without any training documents all counts are 0 and the base is
that of an empty table; an empty table gives no rows; other columns are ignored, whatever their names; very long texts are read whole.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, arrow_schema, blocks, column, documents, saved, shared_dir, text_bytes, tidy, with_text
from .words import hash_words

OWN_PER_ROOT = 1
MOST_OWN = 1 << 17
OWN_PER_HASHED = 16
DIM = 16
NOISE = 48
BATCH = 2048
RATE = 0.5
CHUNK_BYTES = 16 << 20
HELD_OUT = (7, 2)  # crc32 of the identifier modulo 7 is 2
SEED = 31


class Leaves:
    """Where words go: own leaves first, by rank, then hash leaves, then the end; and the groups of consecutive leaves."""

    def __init__(self, own: list[int]):
        place = np.array(own, np.int64).view(np.uint64)
        self.own, self.hashed = len(own), max(4, len(own) // OWN_PER_HASHED)
        self.n = self.own + self.hashed + 1
        self.size = isqrt(self.n - 1) + 1
        self.groups = -(-self.n // self.size)
        self.of = np.argsort(place)
        self.keys = place[self.of]
        self.first = np.zeros(1 << 16, bool)  # 16 bits that a key begins with: most other words are told at once
        self.first[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = self.own + (h >> np.uint64(7)).astype(np.int64) % self.hashed
        if self.own:
            some = np.flatnonzero(self.first[(h >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, h[some]), self.own - 1)
            hit = self.keys[at] == h[some]
            out[some[hit]] = self.of[at[hit]]
        out[h == END] = self.n - 1
        return out

    def members(self, group: int) -> tuple[int, int]:
        return group * self.size, min(self.n, (group + 1) * self.size)

    def shapes(self) -> list[tuple[str, tuple]]:
        return [("r", (self.n, DIM)), ("c", (2, DIM)), ("q1", (self.groups, DIM)), ("b1", (self.groups,)), ("q2", (self.n, DIM)), ("b2", (self.n,))]


def initial(leaves: Leaves, frequency: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters before training, the same everywhere. frequency: positive, of leaves."""
    rng = np.random.default_rng(SEED)
    out = {name: rng.normal(0, 0.1, shape).astype(np.float32) for name, shape in leaves.shapes()}
    group = np.add.reduceat(frequency, np.arange(0, leaves.n, leaves.size))
    out |= {"c": np.ones((2, DIM), np.float32), "b1": np.log(group / group.sum()).astype(np.float32), "b2": np.log(frequency / np.repeat(group, leaves.size)[: leaves.n]).astype(np.float32)}
    return out


def contexts(model: dict, before: np.ndarray) -> np.ndarray:
    return model["c"][0] * model["r"][before[:, 1]] + model["c"][1] * model["r"][before[:, 0]]


def _order(index: np.ndarray, most: int) -> np.ndarray:
    """A stable order of numbers below ``most``; 16-bit ones are sorted by their digits, which is several times faster."""
    return np.argsort(index.astype(np.uint16) if most <= 1 << 16 else index, kind="stable")


class _Learner:
    """Adagrad on the rows that a batch touches."""

    def __init__(self, model: dict):
        self.model = {k: v.astype(np.float32) for k, v in model.items()}
        self.sums = {k: np.full(v.shape, 1e-3, np.float32) for k, v in model.items()}  # of squared gradients

    def update(self, name: str, index: np.ndarray | slice, gradient: np.ndarray) -> None:
        """index: places, repeated ones add up; or a slice."""
        if not isinstance(index, slice):
            order = _order(index, len(self.model[name]))
            at = index[order]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            index, gradient = at[first], np.add.reduceat(gradient[order], first, axis=0)
        sums = self.sums[name][index] + gradient**2
        self.sums[name][index] = sums
        self.model[name][index] -= np.float32(RATE) * gradient / np.sqrt(sums)

    def contrast(self, before: np.ndarray, target: np.ndarray, w: np.ndarray, noise: np.ndarray, q: str, b: str, block: slice) -> None:
        """A step of noise-contrastive estimation over a block of q and b, whose members' noise the sum takes as expected.

        target: places in the block; noise: how often noise has each member for a seen one.
        """
        m = self.model
        near, far, vectors = m["r"][before[:, 1]], m["r"][before[:, 0]], m[q][block]
        h = m["c"][0] * near + m["c"][1] * far
        seen = h @ -vectors.T
        seen += np.log(noise) - m[b][block]
        np.exp(seen, out=seen)
        seen += 1
        np.reciprocal(seen, out=seen)  # the probability that a member comes from the text and not from noise
        row = np.arange(len(h))
        # gradients by the scores are these times w and noise, which the small sides of the products take
        seen[row, target] += (seen[row, target] - 1) / noise[target]
        dh = seen @ (noise[:, None] * vectors)
        dh *= w[:, None]
        self.update("r", np.concatenate([before[:, 1], before[:, 0]]), np.concatenate([dh * m["c"][0], dh * m["c"][1]]))
        self.update("c", slice(None), np.stack([np.einsum("ij,ij->j", dh, near), np.einsum("ij,ij->j", dh, far)]))
        self.update(q, block, noise[:, None] * (seen.T @ (w[:, None] * h)))
        self.update(b, block, noise * (w @ seen))


def train(model: dict, leaves: Leaves, grams: np.ndarray, counts: np.ndarray, frequency: np.ndarray, seed: int) -> dict:
    """One pass over distinct trigrams of leaves, each weighted by its count: of groups, then of each group's leaves."""
    rng, learner = np.random.default_rng(seed), _Learner(model)
    order = rng.permutation(len(grams))
    grams, weight = grams[order], (counts[order] / counts.mean() / min(BATCH, len(grams))).astype(np.float32)
    group = grams[:, 2] // leaves.size
    starts = np.arange(0, leaves.n, leaves.size)

    def pass_over(rows: np.ndarray, target: np.ndarray, share: np.ndarray, q: str, b: str, block: slice) -> None:
        noise = (NOISE * share).astype(np.float32)
        for at in range(0, len(rows), BATCH):
            some = rows[at : at + BATCH]
            learner.contrast(grams[some, :2], target[some] - block.start, weight[some], noise, q, b, block)

    with np.errstate(over="ignore"):
        sums = np.add.reduceat(frequency, starts)
        pass_over(np.arange(len(grams)), group, sums / sums.sum(), "q1", "b1", slice(0, leaves.groups))
        by = _order(group, leaves.groups)
        cuts = np.searchsorted(group[by], np.arange(leaves.groups + 1))
        for g in range(leaves.groups):
            a, z = leaves.members(g)
            if cuts[g + 1] > cuts[g] and z - a > 1:
                pass_over(by[cuts[g] : cuts[g + 1]], grams[:, 2], frequency[a:z] / frequency[a:z].sum(), "q2", "b2", slice(a, z))
    return learner.model


def pack(model: dict, leaves: Leaves) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k, _ in leaves.shapes()])


def unpack(flat: np.ndarray, leaves: Leaves) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in leaves.shapes():
        n = int(np.prod(shape))
        out[name], at = flat[at : at + n].reshape(shape), at + n
    return out


def _log_softmax(h: np.ndarray, which: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of h the logarithm of the softmax of q . h + b at its place."""
    out = np.empty(len(h), np.float32)
    for at in range(0, len(h), 4096):
        scores = h[at : at + 4096] @ q.T
        scores += b
        mine = scores[np.arange(len(scores)), which[at : at + 4096]]
        top = scores.max(1)
        scores -= top[:, None]
        out[at : at + 4096] = mine - top - np.log(np.exp(scores, out=scores) @ np.ones(len(b), np.float32))
    return out


def log_probabilities(model: dict, leaves: Leaves, before: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Natural log of P(leaf | leaves before), normalised; by groups, so that each is a few matrix products."""
    m = {k: v.astype(np.float32, copy=False) for k, v in model.items()}
    group = leaf // leaves.size
    by = _order(group, leaves.groups)
    cuts = np.searchsorted(group[by], np.arange(leaves.groups + 1))
    h, out = contexts(m, before[by]), np.empty(len(leaf), np.float32)
    each = _log_softmax(h, group[by], m["q1"], m["b1"])
    for g in np.flatnonzero(np.diff(cuts)):
        (a, z), here = leaves.members(g), slice(cuts[g], cuts[g + 1])
        each[here] += _log_softmax(h[here], leaf[by[here]] - a, m["q2"][a:z], m["b2"][a:z])
    out[by] = each
    return out


#: Stands for the end of a text among the hashes of words.
END = np.uint64(1)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens: words with A-Z lowered, then the end; where each text's begin, with the end)."""
    h, at = hash_words([t.lower() for t in texts])
    return np.insert(h, at[1:], END), at + np.arange(len(at))


def _before(leaf: np.ndarray, at: np.ndarray, end: int) -> np.ndarray:
    """The two leaves before each token; a text begins after two ends."""
    n = len(leaf)
    one, two = np.full(n, end), np.full(n, end)
    one[1:], two[2:] = leaf[:-1], leaf[:-2]
    first = at[:-1]
    one[first] = two[first] = end
    two[first[np.diff(at) > 1] + 1] = end
    return np.stack([two, one], axis=1)


def _held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(str("null" if i is None else i).encode()) % HELD_OUT[0] == HELD_OUT[1] for i in ids], bool)


class _Chunks:
    """(chunk, doc_id, text), stored bucketed by chunk in the shared folder: work by chunk reads it without a shuffle."""

    def __init__(self, base: DataFrame):
        self.spark = base.sparkSession
        held = base.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
        n = max(1, -(-held // max(CHUNK_BYTES, 16 * isqrt(held))))
        buckets = min(n, 20_000)
        # rows without identifier may repeat without bound: they are spread
        salt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0)
        chunk = F.pmod(F.xxhash64("doc_id", "text", salt), F.lit(n))
        if n == buckets:  # numbers that fall into one bucket each
            number = self.spark.range(30 * n + 100).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("k")).agg(F.min("id").alias("id")).collect()
            free = {r.k: r.id for r in number}
            chunk = F.get(F.from_json(F.lit(str([free.get(k, k) for k in range(n)])), "array<long>"), chunk.cast("int"))
        dealt = base.select(chunk.alias("chunk"), "doc_id", "text")
        self.name, path = f"tessera_{uuid.uuid4().hex}", f"{shared_dir(self.spark)}/tessera-{uuid.uuid4().hex}"
        dealt.repartition(buckets, "chunk").write.bucketBy(buckets, "chunk").option("path", path).option("compression", "zstd").saveAsTable(self.name)
        Table.own(self.spark, path)
        self.df = self.spark.table(self.name)


_COUNTED = "chunk long, word long, n long"


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(place, np.concatenate(counts), len(key)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each chunk with how often its training documents have them (0 among them)."""
    schema, now, keys, counts = arrow_schema(_COUNTED), None, [], []

    def rows() -> pa.RecordBatch:
        word, n = _summed(keys, counts)
        keys.clear()
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(word), now)), pa.array(word.view(np.int64)), pa.array(n)], schema=schema)

    for batch in blocks(batches, 1 << 20):
        chunks = np.array(column(batch, "chunk"))
        for chunk in np.unique(chunks):
            if chunk != now and keys:
                yield rows()
            now = chunk
            part = batch.filter(pa.array(chunks == chunk))
            h, at = tokens(text_bytes(part))
            trains = np.repeat(~_held_out(column(part, "doc_id")), np.diff(at))
            word, place = np.unique(h, return_inverse=True)
            keys.append(word)
            counts.append(np.bincount(place, trains, len(word)))
    if keys:
        yield rows()


_MODEL = "chunk long, slot int, total array<float>, n long"
SLOT = 1 << 14  # a model's numbers travel in pieces of so many, so that sums of many models are spread
FAN_IN = 256  # models of a sum's first step


def _train_chunk(flat, leaves, frequency):
    def run(key, docs):
        """A model for a chunk's training texts, times its tokens."""
        held, schema, where = [], arrow_schema(_MODEL), leaves.value
        for batch in blocks(iter(docs.to_batches()), 1 << 20):
            part = batch.filter(pa.array(~_held_out(column(batch, "doc_id"))))
            if part.num_rows:
                h, at = tokens(text_bytes(part))
                leaf = where(h)
                before = _before(leaf, at, where.n - 1)
                held.append(np.unique((before[:, 0] * where.n + before[:, 1]) * where.n + leaf, return_counts=True))
        if not held:
            return schema.empty_table()
        gram, counts = _summed(*zip(*held))
        held.clear()
        grams = np.stack([gram // where.n**2, gram // where.n % where.n, gram % where.n], axis=1)
        chunk, n = key[0].as_py(), int(counts.sum())
        whole = pack(train(unpack(flat.value, where), where, grams, counts, frequency.value, chunk), where) * np.float32(n)
        parts = [whole[a : a + SLOT] for a in range(0, len(whole), SLOT)]
        return pa.table([pa.array([chunk] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.float32())), pa.array([n] * len(parts), pa.int64())], schema=schema)

    return run


def _sum_models(key, table):
    total = np.zeros(len(table["total"][0]))
    for x in table["total"]:
        total += np.asarray(x.values)
    return pa.table([pa.array([0]), pa.array([key[0].as_py()], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float32())), pa.array([sum(table["n"].to_pylist())], pa.int64())], schema=arrow_schema(_MODEL))


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_chunk(flat, leaves, of_leaf, train_tokens: int, distinct: int):
    def run(key, docs, counts):
        schema = arrow_schema(_SCORED)
        if not docs.num_rows:
            return schema.empty_table()
        word, c = (counts[x].combine_chunks().to_numpy(zero_copy_only=False) for x in ("word", "c"))
        order = np.argsort(word.view(np.uint64))
        word, c = np.append(word.view(np.uint64)[order], np.uint64(0)), np.append(c[order], 0).astype(float)
        where, (totals, sizes) = leaves.value, of_leaf.value
        model, out = unpack(flat.value, where), []
        for batch in blocks(iter(docs.select(["doc_id", "text"]).to_batches()), 1 << 20):
            h, starts = tokens(text_bytes(batch))
            leaf, first = where(h), starts[:-1]
            # an own word's count is its leaf's; the chunk's others are looked up
            other = np.flatnonzero((leaf >= where.own) & (leaf < where.n - 1))
            at = np.searchsorted(word[:-1], h[other])
            count = totals[leaf]
            count[other] = np.where(word[at] == h[other], c[at], 0.0)
            base = np.log10((count + 1) / (train_tokens + distinct + 1))
            # an own word is its leaf; in a hash leaf a word has its share
            share = np.where((leaf < where.own) | (leaf == where.n - 1), 0.0, np.log10((count + 1) / (totals[leaf] + sizes[leaf] + 1)))
            each = share + log_probabilities(model, where, _before(leaf, starts, where.n - 1), leaf).astype(float) / np.log(10)
            ids = column(batch, "doc_id")
            rows = [pa.array(ids, pa.int64()), pa.array(_held_out(ids)), pa.array(np.diff(starts)), pa.array(np.add.reduceat((count > 0).astype(np.int64), first)),
                    pa.array(np.full(len(ids), train_tokens)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(each, first))]
            out.append(pa.RecordBatch.from_arrays(rows, schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    return run


def score(docs: DataFrame, **cols) -> DataFrame:
    """``_SCORED`` for each document."""
    spark = docs.sparkSession
    texts = _Chunks(with_text(docs, **cols)).df
    tidy(spark)
    counted = saved(texts.mapInArrow(_count, _COUNTED))
    counts = saved(counted.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")))
    tidy(spark)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    own = [r.word for r in counts.where(F.col("word") != int(END)).orderBy(F.desc("c"), "word").limit(min(MOST_OWN, OWN_PER_ROOT * isqrt(distinct))).collect()]
    leaves = Leaves(own)
    # totals of the leaves: an own word by its rank, the others by their hash
    ranks = spark.createDataFrame([(w, i) for i, w in enumerate(own)] + [(int(END), leaves.n - 1)], "word long, own int")
    place = F.coalesce("own", (F.lit(leaves.own) + F.pmod(F.shiftrightunsigned("word", 7), F.lit(leaves.hashed))).cast("int"))
    totals, sizes = np.zeros(leaves.n), np.zeros(leaves.n)
    for r in counts.join(F.broadcast(ranks), "word", "left").groupBy(place.alias("leaf")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # a row for each leaf
        totals[r.leaf], sizes[r.leaf] = r.c, r.n
    frequency = (totals + 1) / (totals + 1).sum()
    flat = pack(initial(leaves, frequency), leaves)
    here, many, of_leaf, start = (spark.sparkContext.broadcast(x) for x in (leaves, frequency, (totals, sizes), flat))
    models = saved(texts.groupBy("chunk").applyInArrow(_train_chunk(start, here, many), _MODEL))
    some = models.groupBy("slot", F.expr(f"chunk div {FAN_IN}")).applyInArrow(_sum_models, _MODEL)
    rows = some.groupBy("slot").applyInArrow(_sum_models, _MODEL).collect()  # one model
    if rows:
        flat = np.concatenate([np.array(r.total) / r.n for r in sorted(rows, key=lambda r: r.slot)]).astype(np.float32)
    tidy(spark)
    mine = counted.join(counts, "word").select("chunk", "word", "c")
    return texts.groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInArrow(_score_chunk(spark.sparkContext.broadcast(flat), here, of_leaf, total, distinct), _SCORED)


def query(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
