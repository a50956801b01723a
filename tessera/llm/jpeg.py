"""Media columns: baseline JPEG, written and read in numpy.

The reader parses markers, Huffman-decodes the scan of a baseline file (any sampling, any tables, with or without
restart intervals) and rebuilds the luminance thumbnail from the DC coefficients alone: one sample for each 8 x 8 block.
Restart intervals start byte-aligned with fresh predictors, so that they are decoded side by side: step t
decodes the t-th unit of every interval of every picture of a batch in one go.

The writer stores a payload so that this thumbnail *is* the payload: each byte is the DC coefficient of one block
(quantiser 8, all AC zero), a row of 64 blocks is a restart interval. It is lossless, since DC coefficients are
entropy coded exactly. A JPEG has 65,535 lines at most; a longer payload continues in a further picture.

Defined cases: a null text is empty; an empty text is stored as one row of 64 zero bytes; repeated rows give equal values; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_schema, blocks, column, documents, rows_to_batch, text_bytes, with_text

WIDTH = 64  # blocks in a row
MOST_ROWS = 65_535 // 8
#: Code lengths of the writer's DC categories 0 to 8; AC has the end of a block alone.
_DC_LENGTHS = (3, 4, 4, 3, 3, 3, 3, 4, 4)
EOB_CODE, EOB_BITS = 0, 1


def _canonical(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(code, bits, symbol) of a DHT table: codes of a length follow each other, and double from length to length."""
    out, code, at = [], 0, 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out.append((code, bits, s))
            code += 1
        at += n
        code <<= 1
    return out


_DC_SYMBOLS = sorted(range(9), key=lambda s: (_DC_LENGTHS[s], s))
_DC_COUNTS = [sum(n == bits for n in _DC_LENGTHS) for bits in range(1, 17)]
_AC_COUNTS, _AC_SYMBOLS = [1] + [0] * 15, [0]


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each difference -255 to 255: the bits of a whole block (category, magnitude, end of block) and their number."""
    of = {s: (code, bits) for code, bits, s in _canonical(_DC_COUNTS, _DC_SYMBOLS)}
    value, length = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        k = abs(d).bit_length()
        code, bits = of[k]
        code = (code << k) | (d if d >= 0 else d + (1 << k) - 1)
        value[d + 255], length[d + 255] = (code << EOB_BITS) | EOB_CODE, bits + k + EOB_BITS
    return value, length


_VALUE, _LENGTH = _block_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _header(rows: int) -> bytes:
    return (b"\xff\xd8" + _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + _segment(0xDB, bytes([0, 8] + [1] * 63))
            + _segment(0xC0, bytes([8]) + (rows * 8).to_bytes(2, "big") + (WIDTH * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
            + _segment(0xC4, bytes([0x00, *_DC_COUNTS, *_DC_SYMBOLS])) + _segment(0xC4, bytes([0x10, *_AC_COUNTS, *_AC_SYMBOLS]))
            + _segment(0xDD, WIDTH.to_bytes(2, "big")) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])))


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 64 bytes) as one or more JPEG files in a row."""
    sizes = [len(p) // WIDTH for p in payloads]
    q = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int64).reshape(-1, WIDTH)
    # a sample of 128 is a DC of 0, and predictors start at 0
    diff = np.diff(q, axis=1, prepend=128)
    bits = _LENGTH[diff + 255]
    ends = np.cumsum(bits, axis=1)
    used = (ends[:, -1] + 7) // 8
    starts = np.concatenate([[0], np.cumsum(used)])
    at = (starts[:-1, None] * 8 + ends - bits).ravel()
    word = (_VALUE[diff + 255] << (24 - (at.reshape(bits.shape) & 7) - bits)).ravel()  # 24 bits from its first byte
    size = int(starts[-1])
    scan = np.zeros(size + 3)
    first = at >> 3
    for k in range(3):  # bits of different blocks don't overlap: sums are unions
        scan += np.bincount(first + k, (word >> (16 - 8 * k)) & 255, size + 3)
    scan = scan[:size].astype(np.uint8)
    pad = used * 8 - ends[:, -1]  # the rest of an interval's last byte is ones
    scan[starts[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    out, row, raw = [], 0, scan.tobytes()
    for n in sizes:
        parts = []
        for a in range(row, row + n, MOST_ROWS):
            b = min(a + MOST_ROWS, row + n)
            parts.append(_header(b - a))
            edge = starts[a : b + 1].tolist()
            for k, (x, y) in enumerate(zip(edge, edge[1:])):
                piece = raw[x:y]
                parts.append(piece.replace(b"\xff", b"\xff\0") if b"\xff" in piece else piece)
                if k < b - a - 1:
                    parts.append(bytes((0xFF, 0xD0 + k % 8)))
            parts.append(b"\xff\xd9")
        out.append(b"".join(parts))
        row += n
    return out


class Picture:
    """The parsed headers of one JPEG, its entropy-coded intervals, and where it ends."""

    def __init__(self, data: bytes, at: int = 0):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no JPEG starts here")
        self.quant: dict[int, int] = {}  # of DC
        self.huffman: dict[int, tuple] = {}
        self.interval = 0
        at += 2
        while True:
            while data[at + 1] == 0xFF:  # fill bytes
                at += 1
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker in (0xC0, 0xC1):
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])}
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline JPEG")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.interval = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                self.scan = tuple((body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0]))
                break
        # up to the first marker that is neither a stuffed byte nor a restart
        begin = at
        while True:
            at = data.index(b"\xff", at)
            if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
                at += 2
            else:
                break
        self.entropy, self.end = data[begin:at], at + 2
        if len(self.scan) == 1:  # blocks, without the fill of interleaved units
            self.unit = ((0, 1, 1),)
            h, v, _ = self.parts[self.scan[0][0]]
            most_h, most_v = max(p[0] for p in self.parts.values()), max(p[1] for p in self.parts.values())
            self.across, self.down = -(-self.width * h // (8 * most_h)), -(-self.height * v // (8 * most_v))
        else:
            self.unit = tuple((k, *self.parts[c][:2]) for k, (c, _, _) in enumerate(self.scan))
            most_h, most_v = max(p[0] for p in self.parts.values()), max(p[1] for p in self.parts.values())
            self.across, self.down = -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v))
        self.units = self.across * self.down

    def kind(self) -> tuple:
        """Pictures of one kind are decoded together."""
        return (self.unit, tuple((self.huffman[d], self.huffman[0x10 | a]) for _, d, a in self.scan))


def _lookup(table: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits ahead: the symbol and the length of its code (0: none)."""
    symbol, length = np.zeros(65_536, np.int64), np.zeros(65_536, np.int64)
    for code, bits, s in _canonical(*map(list, table)):
        a = code << (16 - bits)
        symbol[a : a + (1 << (16 - bits))], length[a : a + (1 << (16 - bits))] = s, bits
    return symbol, length


_LOOKUPS: dict[tuple, tuple] = {}


def _ahead(buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 16 bits from each bit position."""
    k = at >> 3
    return ((buffer[k] << 16 | buffer[k + 1] << 8 | buffer[k + 2]) >> (8 - (at & 7))) & 0xFFFF


def decode_dc(pictures: list[Picture]) -> list[np.ndarray]:
    """The luminance thumbnail of each picture: its DC coefficients as samples 0 to 255."""
    out: list = [None] * len(pictures)
    kinds: dict[tuple, list[int]] = {}
    for k, p in enumerate(pictures):
        kinds.setdefault(p.kind(), []).append(k)
    for (unit, tables), members in kinds.items():
        lanes, units, owner = [], [], []
        for k in members:
            p = pictures[k]
            step = p.interval or p.units
            raw = np.frombuffer(p.entropy, np.uint8)
            mark = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)) if p.interval else []
            a = 0
            for nth, b in enumerate([*(int(x) for x in mark), len(raw)]):
                lanes.append(p.entropy[a:b].replace(b"\xff\0", b"\xff"))
                units.append(min(step, p.units - nth * step))
                owner.append(k)
                a = b + 2
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lanes])])
        buffer = np.frombuffer(b"".join(lanes) + b"\xff" * 4, np.uint8).astype(np.int64)
        units_of, at = np.array(units), starts[:-1] * 8
        blocks_of = unit[0][1] * unit[0][2]
        got = np.zeros((len(lanes), max(units, default=0), blocks_of), np.int64)
        for t in (*tables,):
            for x in t:
                if x not in _LOOKUPS:
                    if len(_LOOKUPS) > 64:
                        _LOOKUPS.clear()
                    _LOOKUPS[x] = _lookup(x)
        predict = np.zeros((len(unit), len(lanes)), np.int64)
        for n in range(got.shape[1]):
            live = slice(None) if (units_of > n).all() else np.flatnonzero(units_of > n)
            pos = at[live]
            for part, h, v in unit:
                dc, ac = (_LOOKUPS[x] for x in tables[part])
                for b in range(h * v):
                    ahead = _ahead(buffer, pos)
                    size = dc[0][ahead]
                    if not dc[1][ahead].all():
                        raise ValueError("broken entropy-coded data")
                    pos = pos + dc[1][ahead]
                    raw = _ahead(buffer, pos) >> (16 - size)
                    predict[part, live] += np.where((size > 0) & (raw < (1 << size) >> 1), raw - (1 << size) + 1, raw)
                    pos = pos + size
                    if part == 0:
                        got[live, n, b] = predict[0, live]
                    pos = _skip_ac(buffer, pos, ac)
            at[live] = pos
        lane = 0
        for k in members:
            p = pictures[k]
            mine = got[lane : lane + (many := owner.count(k) if not p.interval else -(-p.units // p.interval))]
            lane += many
            flat = mine.reshape(-1, blocks_of)[: p.units] if p.interval == 0 or p.interval == got.shape[1] else np.concatenate([m[:u] for m, u in zip(mine, units[lane - many : lane])])
            h, v = unit[0][1], unit[0][2]
            grid = flat[: p.units].reshape(p.down, p.across, v, h).transpose(0, 2, 1, 3).reshape(p.down * v, p.across * h)
            q = p.quant[p.parts[p.scan[0][0]][2]]
            out[k] = np.clip(np.floor_divide(grid * q + 4, 8) + 128, 0, 255).astype(np.uint8)
    return out


def _skip_ac(buffer: np.ndarray, pos: np.ndarray, ac: tuple) -> np.ndarray:
    """The position after the 63 AC coefficients of each lane's block."""
    ahead = _ahead(buffer, pos)
    symbol = ac[0][ahead]
    pos = pos + ac[1][ahead]
    if not symbol.any():  # the end of the block everywhere
        return pos
    seen = np.zeros(len(pos), np.int64)
    todo = np.flatnonzero(symbol)
    symbol = symbol[todo]
    while len(todo):
        seen[todo] += (symbol >> 4) + 1  # a run of zeros, then a coefficient of so many bits (0xF0: sixteen zeros)
        pos[todo] += symbol & 15
        todo = todo[seen[todo] < 63]
        ahead = _ahead(buffer, pos[todo])
        symbol = ac[0][ahead]
        pos[todo] += ac[1][ahead]
        todo, symbol = todo[symbol > 0], symbol[symbol > 0]
    return pos


def decode(media: list[bytes]) -> list[list[tuple[Picture, np.ndarray]]]:
    """The pictures in each item, each with its thumbnail."""
    found = []
    for data in media:
        at, mine = 0, []
        while at < len(data):
            mine.append(Picture(data, at))
            at = mine[-1].end
        found.append(mine)
    thumbs = iter(decode_dc([p for mine in found for p in mine]))
    return [[(p, next(thumbs)) for p in mine] for mine in found]


def average_hash(thumb: np.ndarray, side: int = 8) -> str:
    """64 bits in hex: cells of a side x side grid that are brighter than the mean of all cells."""
    rows = np.linspace(0, thumb.shape[0], side + 1).astype(int)
    cols = np.linspace(0, thumb.shape[1], side + 1).astype(int)
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    total[1:, 1:] = thumb.cumsum(0, dtype=np.int64).cumsum(1)
    r0, r1, c0, c1 = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1), cols[:-1], np.maximum(cols[1:], cols[:-1] + 1)
    r0, r1, c0, c1 = np.minimum(r0, thumb.shape[0] - 1), np.minimum(r1, thumb.shape[0]), np.minimum(c0, thumb.shape[1] - 1), np.minimum(c1, thumb.shape[1])
    cells = (total[r1][:, c1] - total[r0][:, c1] - total[r1][:, c0] + total[r0][:, c0]) / np.outer(r1 - r0, c1 - c0)
    return np.packbits(cells > cells.mean()).tobytes().hex()


FIELDS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, feature string"


def _rows(with_media: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(FIELDS + ", media binary, thumbnail binary" * with_media)
        for batch in blocks(batches, 1 << 20):
            texts = text_bytes(batch)
            media = encode([t + bytes(max(64, -(-len(t) // 64) * 64) - len(t)) for t in texts])
            out = []
            for doc_id, text, stored, pictures in zip(column(batch, "doc_id"), texts, media, decode(media)):
                thumb = pictures[0][1] if len(pictures) == 1 else np.concatenate([x for _, x in pictures])
                back = thumb.tobytes()
                width, height = pictures[0][0].width, sum(p.height for p, _ in pictures)
                feature = f"{width}x{height}:{len(pictures)}:{average_hash(thumb)}"
                row = (doc_id, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), width, height, feature)
                out.append(row + ((stored, back) if with_media else ()))
            yield rows_to_batch(out, schema)

    return run


def media_columns(docs: DataFrame, with_media: bool = True, **cols) -> DataFrame:
    """``FIELDS`` for each document, with the stored JPEG and the thumbnail read back from it if asked for."""
    ddl = FIELDS + ", media binary, thumbnail binary" * with_media
    return with_text(docs, **cols).mapInArrow(_rows(with_media), ddl)


def query(spark, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir), with_media=False)
