"""Words of many texts at once: their places and 64-bit hashes, with numpy over the texts' bytes."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes hashed at once; a word longer than that is hashed alone.
BLOCK = 1 << 21
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.default_rng(11).integers(1, 1 << 64, 256, np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


class Words:
    """Words of texts: bytes of starts[i]:ends[i] of data; those of text d are first[d]:first[d + 1]."""

    def __init__(self, texts: list[str | bytes | None], lower: bool = False):
        parts = [t.encode("utf-8", "replace") if isinstance(t, str) else t or b"" for t in texts]
        self.data = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
        if lower:
            self.data = LOWER[self.data]
        space = SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.text_starts = np.cumsum([1] + [len(p) + 1 for p in parts])
        self.first = np.searchsorted(self.starts, self.text_starts)

    def hashes(self) -> np.ndarray:
        """A polynomial of the bytes modulo 2^64, mixed."""
        out = np.empty(len(self.starts), np.uint64)
        k = 0
        while k < len(out):
            base = int(self.starts[k])
            end = max(k + 1, int(np.searchsorted(self.ends, base + BLOCK, side="right")))
            data = self.data[base : self.ends[end - 1]]
            power, inverse = _powers_to(max(len(data), 1))
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_VALUE[data] * power[: len(data)], out=sums[1:])
            a, b = self.starts[k:end] - base, self.ends[k:end] - base
            out[k:end] = (sums[b] - sums[a]) * inverse[a]
            k = end
            if len(_powers[0]) > 4 * BLOCK:
                _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        return mix(out)


_STEPS = np.random.default_rng(12).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive words, over text ends too: the caller leaves those out."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out += hashes[k : k + len(out)] * _STEPS[k]
    return mix(out)
