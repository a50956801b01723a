"""Random numbers keyed by (seed, stream), in numpy, many streams side by side.

The reference values need 64-bit unsigned arithmetic that wraps, which SQL doesn't have. A stream's numbers depend on its
number alone: results don't change with partitions or batches.
"""

from __future__ import annotations

import numpy as np

#: Constants of SplitMix64 and of the stream key.
GAMMA, MIX1, MIX2, STREAM = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x632BE59BD9B4E019
_U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + _U(GAMMA)
        x = (x ^ (x >> _U(30))) * _U(MIX1)
        x = (x ^ (x >> _U(27))) * _U(MIX2)
        return x ^ (x >> _U(31))


def _rotl(x: np.ndarray, k: int) -> np.ndarray:
    return (x << _U(k)) | (x >> _U(64 - k))


class Streams:
    """xoshiro256** generators, one for each stream."""

    def __init__(self, seed: int, streams: np.ndarray):
        with np.errstate(over="ignore"):
            x = splitmix(np.full(1, seed % (1 << 64), np.uint64)) ^ splitmix(np.asarray(streams, np.uint64) + _U(STREAM))
        self.s = []
        for _ in range(4):
            x = splitmix(x)
            self.s.append(x)
        self.spare = None
        self.n = len(x)

    def next(self, who: np.ndarray | None = None) -> np.ndarray:
        """The next number of all streams, or of some."""
        a, b, c, d = self.s if who is None else (x[who] for x in self.s)
        out = _rotl(b * _U(5), 7) * _U(9)
        t = b << _U(17)
        c ^= a
        d ^= b
        b ^= c
        a ^= d
        c ^= t
        d = _rotl(d, 45)
        if who is None:
            self.s[3] = d
        else:
            for x, y in zip(self.s, (a, b, c, d)):
                x[who] = y
        return out

    def uniform(self, who: np.ndarray | None = None) -> np.ndarray:
        return (self.next(who) >> _U(11)).astype(float) * 2.0**-53

    def index(self, n: int, who: np.ndarray | None = None) -> np.ndarray:
        return (self.uniform(who) * n).astype(np.int64)

    def normal(self) -> np.ndarray:
        """One for each stream, by the polar method; its second value waits for the next call."""
        out, self.spare = self.spare, None
        if out is not None:
            return out
        u, v = 2 * self.uniform() - 1, 2 * self.uniform() - 1
        s = u * u + v * v
        todo = np.flatnonzero((s <= 0) | (s >= 1))
        while len(todo):  # a fifth of the pairs lies outside of the circle
            u[todo], v[todo] = 2 * self.uniform(todo) - 1, 2 * self.uniform(todo) - 1
            s[todo] = u[todo] ** 2 + v[todo] ** 2
            todo = todo[(s[todo] <= 0) | (s[todo] >= 1)]
        f = np.sqrt(-2 * np.log(s) / s)
        self.spare = v * f
        return u * f

    def blocks(self, n: int, length: int, block: float) -> np.ndarray:
        """(streams, length) places of a stationary bootstrap over n observations."""
        out = np.empty((self.n, length), np.int64)
        pos = self.index(n)
        out[:, 0] = pos
        for t in range(1, length):
            again = self.uniform() < 1 / block
            pos = (pos + 1) % n
            who = np.flatnonzero(again)
            if len(who):
                pos[who] = self.index(n, who)
            out[:, t] = pos
        return out
