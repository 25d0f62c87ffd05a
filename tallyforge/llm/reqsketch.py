"""Mergeable percentile sketch of relative-rank compactors.

A sketch is a row of levels; a value on level ``h`` stands for ``2**h`` values. A level over its capacity is
sorted and its lower part compacted: every other value, from a coin toss, moves one level up. How much of
the level is compacted follows the trailing ones of its compaction count, in sections, so the largest
values of a level are compacted exponentially less often than the smallest. That protects the upper tail: the rank
of the estimate of the p-th percentile errs by at most about ``1 / (4 K)`` of ``n (1 - p)``, 95 times in
100, rather than of ``n``. (The scheme is that of Cormode, Karnin, Liberty, Thaler and Vesely,
"Relative Error Streaming Quantiles", 2021.) Up to ``6 K`` values are kept as they are, and exact.

Sketches of the same ``K`` merge level by level in any order. Coin tosses come from a seed given by the
caller, so a task that is run again makes the same sketch.
"""

from __future__ import annotations

import math
import struct

import numpy as np

K, SECTIONS = 40, 3
#: Of the distance to the top: what the sketch's rank error stays below, stated and tested.
ERROR = 0.02


class _Level:
    __slots__ = ("values", "size", "sections", "state", "coin")

    def __init__(self, size: float, sections: int = SECTIONS, state: int = 0, values: np.ndarray | None = None):
        self.size, self.sections, self.state, self.coin = size, sections, state, 0
        self.values = np.zeros(0) if values is None else values

    @property
    def section(self) -> int:
        return max(4, 2 * round(self.size / 2))

    @property
    def capacity(self) -> int:
        return 2 * self.sections * self.section

    def compact(self, rng: np.random.Generator) -> np.ndarray:
        self.values = np.sort(self.values)
        ones = 0
        while self.state >> ones & 1:
            ones += 1
        keep = self.capacity // 2 + (self.sections - min(ones + 1, self.sections)) * self.section
        n = max(0, len(self.values) - keep)
        n -= n % 2
        self.coin = 1 - self.coin if self.state & 1 else int(rng.integers(2))
        up, self.values = self.values[self.coin : n : 2], self.values[n:]
        self.state += 1
        if self.state >= 1 << (self.sections - 1) and self.size / math.sqrt(2) >= 4:
            self.size /= math.sqrt(2)
            self.sections *= 2
        return up


class Sketch:
    def __init__(self, seed: int = 0, k: int = K):
        self.k, self.n, self.levels = k, 0, [_Level(k)]
        self.rng = np.random.default_rng(seed & (2**63 - 1))

    @property
    def nbytes(self) -> int:
        return sum(level.values.nbytes for level in self.levels)

    def add(self, values: np.ndarray) -> None:
        """Values must be finite or infinite numbers; NaN has no rank and is refused."""
        if len(values):
            if np.isnan(values).any():
                raise ValueError("NaN has no rank")
            self.n += len(values)
            self.levels[0].values = np.concatenate((self.levels[0].values, values))
            self._compress()

    def merge(self, other: Sketch) -> None:
        if other.k != self.k:
            raise ValueError("sketches of different K do not merge")
        while len(self.levels) < len(other.levels):
            self.levels.append(_Level(self.k))
        for own, its in zip(self.levels, other.levels):
            own.state |= its.state
            if its.sections > own.sections:
                own.size, own.sections = its.size, its.sections
            own.values = np.concatenate((own.values, its.values))
        self.n += other.n
        self._compress()

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            while len(self.levels[h].values) >= self.levels[h].capacity:
                up = self.levels[h].compact(self.rng)
                if not len(up):
                    break
                if h + 1 == len(self.levels):
                    self.levels.append(_Level(self.k))
                self.levels[h + 1].values = np.concatenate((self.levels[h + 1].values, up))
            h += 1

    def percentiles(self, shares: list[float]) -> list[float | None]:
        """The smallest kept value whose rank reaches ``share * n``; None of an empty sketch."""
        if not self.n:
            return [None] * len(shares)
        values = np.concatenate([level.values for level in self.levels])
        weights = np.concatenate([np.full(len(level.values), 1 << h) for h, level in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        # the kept weights may differ from n by what odd compactions left over
        at = np.searchsorted(ranks, np.maximum(1, np.ceil(np.array(shares) * ranks[-1] - 1e-9)))
        return [float(x) for x in values[order][np.minimum(at, len(values) - 1)]]

    def dumps(self) -> bytes:
        head = struct.pack("<qqi", self.k, self.n, len(self.levels))
        body = b"".join(struct.pack("<diqi", x.size, x.sections, x.state, len(x.values)) + np.asarray(x.values, "<f8").tobytes() for x in self.levels)
        return head + body

    @classmethod
    def loads(cls, blob: bytes, seed: int = 0) -> Sketch:
        k, n, levels = struct.unpack_from("<qqi", blob)
        out, at = cls(seed, k), struct.calcsize("<qqi")
        out.n, out.levels = n, []
        for _ in range(levels):
            size, sections, state, count = struct.unpack_from("<diqi", blob, at)
            at += struct.calcsize("<diqi")
            out.levels.append(_Level(size, sections, state, np.frombuffer(blob, "<f8", count, at).copy()))
            at += 8 * count
        return out
