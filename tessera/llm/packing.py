"""Best-fit packing of tokenised documents, after a Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens. What has to be packed is then a histogram: how many pieces
there are of each length. It has ``capacity`` bins whatever the input, so the packing itself is one small
computation; it gives patterns (lists of lengths that share a sequence) with the number of sequences that follow
each. Spark deals the pieces of a length to the places of that length by their rank, which is made of a rank inside the
tokenising task and of offsets by (length, task): no task ever holds all pieces of a length.

Dominance: a set of pieces holding the longest open piece dominates another such set if the other's pieces can be
exchanged, group by group, for pieces of the first that are no smaller. Fixing a dominating set keeps an optimal packing
reachable. Fixed are: a piece that nothing fits beside; two pieces that fill a sequence; a piece beside which only one
more fits, with the largest such; and, where at most two more fit, the pair that is at least as large in both
places as any other. What remains is packed best fit, longest first.

Defined cases: a null text is empty and gives one piece of length 1 (the end token); repeated rows give pieces each;
an empty table gives no rows; other columns are ignored; very long texts are tokenised whole and cut.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_schema, blocks, column, documents, rows_to_batch, saved, text_bytes, with_text
from .words import located_words

CAPACITY = 4096
END = 1
#: Words that a worker keeps with their ids.
CACHED_WORDS = 800_000
#: Words without their punctuation that it keeps besides.
CACHED_PARTS = 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return tokenizer, _Store(CACHED_WORDS), {}


class _Store:
    """Ids of recent words, by the words' 64-bit hashes in order; the half used last stays when it is full."""

    def __init__(self, limit: int):
        self.limit = limit
        self.keys, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.start, self.size, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.turn = 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the place of each key, whether it is held)."""
        at = np.searchsorted(self.keys, keys)
        held = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        held[inside] = self.keys[at[inside]] == keys[inside]
        return at, held

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        """ids: of each new word, 32 bits each."""
        if len(self.keys) + len(keys) > self.limit:
            kept = np.sort(np.argsort(self.used, kind="stable")[-(self.limit // 2) :])
            self.flat = self.take(kept)
            self.keys, self.size, self.used = self.keys[kept], self.size[kept], self.used[kept]
            self.start = np.cumsum(self.size) - self.size
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), np.uint32)])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.start, self.size, self.used = np.insert(self.start, at, start), np.insert(self.size, at, size), np.insert(self.used, at, self.turn)

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids of the words at ``places``, one word after the other."""
        size = self.size[places]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[places] - ends + size, size) + np.arange(int(size.sum()))]


#: Letters that stay letters when lowered, then punctuation: the tokenizer splits between them (no apostrophes: they join).
_PLAIN = re.compile("([a-zA-ZÀ-ÖØ-öø-įıĲ-ɏ]+)([.,!?;:#*&%$|]*)")


def _encoded(tokenizer, words: list[str]) -> Iterator[bytes]:
    for at in range(0, len(words), 10_000):
        ids = [e.ids for e in tokenizer.encode_batch_fast(words[at : at + 10_000], add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), np.uint32).tobytes()
        ends = list(accumulate(4 * len(x) for x in ids))
        yield from map(flat.__getitem__, map(slice, [0, *ends], ends))


def _new_words(tokenizer, parts: dict, words: list[str]) -> list[bytes]:
    """The ids of words that the store lacks: letters and the punctuation after them apart, as far as they are known."""
    found = list(map(_PLAIN.fullmatch, words))
    heads = [m[1].lower() if m else w for w, m in zip(words, found)]  # all of a word that isn't plain
    tails = [m[2] if m else "" for m in found]
    if len(parts) > CACHED_PARTS:
        parts.clear()
    asked = list(set(heads).union(tails).difference(parts))
    parts.update(zip(asked, _encoded(tokenizer, asked)))
    return [parts[a] + parts[b] if b else parts[a] for a, b in zip(heads, tails)]


def token_ids(texts: list[bytes], path: str) -> list[bytes]:
    """The ids of each UTF-8 text as little-endian unsigned 32-bit integers.

    The tokenizer drops white space, and nothing it does reaches across it; so each word between ASCII blanks is
    tokenised once and its ids are kept. Words are found and compared as 64-bit hashes of their bytes. Nor does the
    tokenizer join letters with punctuation after them: such words are put together from parts, of which there are fewer.
    """
    tokenizer, store, parts = _tokenizer(path)
    joined = b"\n".join([*texts, b""])
    h, at, first, last = located_words(joined, [len(t) + 1 for t in texts])
    keys, example, word = np.unique(h, return_index=True, return_inverse=True)
    if len(keys) > CACHED_WORDS // 4:
        store = _Store(len(keys))  # a very long text has a store of its own
    store.turn += 1
    place, held = store.find(keys)
    store.used[place[held]] = store.turn  # what is used now stays
    if not held.all():
        at_new = example[~held]
        store.add(keys[~held], _new_words(tokenizer, parts, [joined[a:b].decode("utf-8", "replace") for a, b in zip(first[at_new].tolist(), last[at_new].tolist())]))
        place, _ = store.find(keys)
    flat = store.take(place[word]).astype("<u4")
    ends = np.concatenate([[0], np.cumsum(store.size[place][word])])[at]
    return [flat[a:b].tobytes() for a, b in zip(ends.tolist(), ends[1:].tolist())]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, task = arrow_schema(_PIECES), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        end = END.to_bytes(4, "little")
        for batch in blocks(batches, 2 << 20):
            out = []
            for doc_id, ids in zip(column(batch, "doc_id"), token_ids(text_bytes(batch), path)):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    out.append((doc_id, piece, at // 4, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            yield rows_to_batch(out, schema)

    return run


class _Bins:
    """How many open pieces there are of each length, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, size: int, many: int) -> None:
        self.n[size] -= many
        if not self.n[size]:
            del self.n[size]
            self.order.pop(bisect.bisect_left(self.order, size))

    def largest(self, most: int) -> int | None:
        at = bisect.bisect_right(self.order, most)
        return self.order[at - 1] if at else None

    def smallest(self, how_many: int) -> list[int]:
        out: list[int] = []
        for s in self.order:
            out += [s] * min(self.n[s], how_many - len(out))
            if len(out) == how_many:
                break
        return out


def reduce_by_dominance(bins: _Bins, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes out of ``bins`` the sets that provably dominate; (lengths, how many such sequences)."""
    fixed = []
    for size in sorted(bins.n, reverse=True):
        while (have := bins.n.get(size, 0)) > 0:
            room = capacity - size
            bins.take(size, 1)  # the piece itself; `bins` now holds the others
            small = bins.smallest(3)
            a = bins.largest(room)
            most_others = next((k for k in range(3) if len(small) <= k or sum(small[: k + 1]) > room), 3)
            if a is None or most_others == 0:
                chosen: tuple[int, ...] | None = ()
            elif a == room or most_others == 1:
                chosen = (a,)
            elif most_others == 2:
                bins.take(a, 1)
                b = bins.largest(room - a)
                bins.n[a] = bins.n.get(a, 0) + 1
                if a not in bins.order:
                    bisect.insort(bins.order, a)
                second = _largest_second(bins, room)
                if b is None and second <= 0 or b is not None and b >= second:
                    chosen = (a,) if b is None else (a, b)
                elif a >= _largest_pair(bins, room):
                    chosen = (a,)  # one piece as large as any pair
                else:
                    chosen = None
            else:
                chosen = None
            bins.n[size] = bins.n.get(size, 0) + 1
            if size not in bins.order:
                bisect.insort(bins.order, size)
            if chosen is None:
                break
            # as pieces go, no more of them fit than before: the same step repeats while its lengths last
            uses = {s: (size, *chosen).count(s) for s in (size, *chosen)}
            times = min(bins.n[s] // u for s, u in uses.items())
            if not chosen:
                times = have
            for s, u in uses.items():
                bins.take(s, u * times)
            fixed.append(((size, *chosen), times))
    return fixed


def _largest_second(bins: _Bins, room: int) -> int:
    """The largest smaller member of any two open pieces that fit into ``room`` together; 0 if no two do."""
    q = bins.largest(room // 2)
    while q is not None:
        if bins.n[q] > 1 or (at := bisect.bisect_right(bins.order, q)) < len(bins.order) and bins.order[at] + q <= room:
            return q
        q = bins.largest(q - 1)
    return 0


def _largest_pair(bins: _Bins, room: int) -> int:
    """The largest sum, within ``room``, of two open pieces."""
    sums = (q + p for q in bins.order if q <= room // 2 and (p := bins.largest(room - q)) is not None and (p != q or bins.n[q] > 1))
    return max(sums, default=0)


def best_fit(bins: _Bins, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over whole groups of equal sequences: (lengths, how many)."""
    open_by_room: dict[int, list[list]] = {}  # room left to [[lengths, how many], ...]
    rooms: list[int] = []
    done = []

    def put(lengths: tuple[int, ...], many: int, room: int) -> None:
        if room == 0:
            done.append((lengths, many))
            return
        if room not in open_by_room:
            open_by_room[room] = []
            bisect.insort(rooms, room)
        open_by_room[room].append([lengths, many])

    for size in sorted(bins.n, reverse=True):
        left = bins.n[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                if left >= each:
                    put((size,) * each, left // each, capacity - size * each)
                if left % each:
                    put((size,) * (left % each), 1, capacity - size * (left % each))
                break
            room = rooms[at]
            group = open_by_room[room][-1]
            each = min(room // size, left)
            many = min(group[1], left // each)
            group[1] -= many
            if not group[1]:
                open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.pop(at)
            put(group[0] + (size,) * each, many, room - size * each)
            left -= many * each
    return done + [(lengths, many) for groups in open_by_room.values() for lengths, many in groups]


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The whole packing of a histogram of lengths: (lengths, how many sequences hold just these)."""
    bins = _Bins(counts)
    fixed = reduce_by_dominance(bins, capacity)
    return fixed + best_fit(bins, capacity)


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset), each going on for its pattern's number of sequences."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for lengths, many in patterns:
        offset = 0
        for s in lengths:
            out.setdefault(s, []).append((ranks.get(s, 0), sequence, offset))
            ranks[s] = ranks.get(s, 0) + many
            offset += s
        sequence += many
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, **cols) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece."""
    pieces = saved(with_text(docs, **cols).mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity), _PIECES))
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    places = pieces.sparkSession.sparkContext.broadcast(_places(pack_lengths(counts, capacity)))  # patterns over `capacity` lengths
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # written first: the join then deals pieces by length and task, and not by length alone
    offsets = saved(by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    ranked = pieces.join(offsets.hint("merge"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[order], prepend=-1)) if len(order) else []
            for a, b in zip(bounds, [*bounds[1:], len(order)]):
                at = order[a:b]
                rows = places.value[int(length[at[0]])]
                hit = np.searchsorted(rows[:, 0], rank[at], "right") - 1
                sequence[at] = rows[hit, 1] + rank[at] - rows[hit, 0]
                offset[at] = rows[hit, 2]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], schema=schema)

    return ranked.mapInArrow(deal, ddl)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
