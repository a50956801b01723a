"""Words of many texts at once, as 64-bit hashes, in numpy.

All texts of a batch stand in one byte array; a word's hash is a difference of two prefix sums of its bytes times
powers of an odd base, shifted back to the word's start, then mixed. No Python object is made for a word.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
#: Classes of bytes. 0 ends words; a word is a run of one other class.
BLANKS = np.array([0 if c == 0x20 or 0x09 <= c <= 0x0D else 1 for c in range(256)], np.uint8)
#: As BLANKS, with ASCII punctuation as words of their own.
PUNCTUATION = np.array([0 if c == 0x20 or 0x09 <= c <= 0x0D else 1 if c >= 0x80 or chr(c).isalnum() else 2 for c in range(256)], np.uint8)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64; kept for the largest n asked for."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if len(held) <= 1 << 22:
            _powers[base] = held
    return held[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_words(texts: list[bytes], classes: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """(the hashes of all words in order, where each text's words begin, with the end)."""
    return located_words(b"\n".join([*texts, b""]), [len(t) + 1 for t in texts], classes)[:2]


def located_words(joined: bytes, sizes: list[int], classes: np.ndarray = BLANKS) -> tuple[np.ndarray, ...]:
    """As ``hash_words``, of texts that each end in a line break, with the bytes where words begin and end."""
    if not joined:
        return np.zeros(0, np.uint64), np.zeros(len(sizes) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(joined, np.uint8)
    kind = classes[raw]
    change = np.flatnonzero(np.diff(kind, prepend=0))
    first = change[kind[change] != 0]  # words' first bytes
    last = change[np.append(0, kind)[change] != 0] if len(change) else change  # the bytes after words
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(raw)), dtype=np.uint64)])
    h = mixed((sums[last] - sums[first]) * powers(_BACK, len(raw))[first])
    return h, np.concatenate([[0], np.searchsorted(first, np.cumsum(sizes))]), first, last


def window_hashes(h: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of each ``size`` consecutive words (windows that cross texts among them)."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    base = mixed(np.array([_BASE + 2 * salt], np.uint64))[0] | np.uint64(1)
    n = len(h)
    with np.errstate(over="ignore"):
        up = powers(int(base), n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((h ^ np.uint64(salt)) * up, dtype=np.uint64)])
        return mixed((sums[size:] - sums[:-size]) * powers(pow(int(base), -1, 1 << 64), n)[: n - size + 1])


def span_hashes(h: np.ndarray, a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of the words from a to b (without b), for arrays of both."""
    base = mixed(np.array([_BASE + 2 * salt], np.uint64))[0] | np.uint64(1)
    n = max(len(h), 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((h ^ np.uint64(salt)) * powers(int(base), n)[: len(h)], dtype=np.uint64)])
    back = powers(pow(int(base), -1, 1 << 64), n + 1)
    return mixed((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))
