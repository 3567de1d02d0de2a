"""Content-defined chunking with a gear rolling hash, over all texts of a batch at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Characters that the gear hash depends on: 16-bit words, shifted by one bit for each character.
GEAR = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each integer."""
    x = (x.astype(np.uint64) + np.uint64(seed)) * _MIX
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(1)
def _character_table() -> np.ndarray:
    return mix(np.arange(0x110000), 11)


@lru_cache(4)
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    both = []
    for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
        step = np.full(size, np.uint64(base), dtype=np.uint64)
        step[0] = 1
        both.append(np.cumprod(step))
    return both[0], both[1]


class Chunker:
    """Boundaries and digests of texts.

    A boundary stands where the gear hash of the last ``GEAR`` characters is the least of some window of ``spread`` places (the first one on
    ties). Whether a place is one depends on ``spread + GEAR`` characters before it and ``spread`` after it only, so insertions elsewhere don't
    move boundaries, and any ``spread`` places in a text hold one.
    """

    def __init__(self, texts: list[str], spread: int):
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.n = n = len(codes)
        self.text_of = np.repeat(np.arange(len(texts)), lengths)
        self._values = values = _character_table()[codes]
        gear, step = (values >> np.uint64(40)).astype(np.uint16), 1
        while step < GEAR:
            shifted = np.zeros_like(gear)
            shifted[step:] = gear[:-step] << np.uint16(step)
            gear = gear + shifted
            step *= 2
        self.boundaries = np.zeros(0, dtype=np.int64)
        windows = n - spread + 1
        if windows > 0:
            keyed, have = (gear.astype(np.int64) << 32) | np.arange(n), 1
            while have < spread:
                move = min(have, spread - have)
                keyed[: n - move] = np.minimum(keyed[: n - move], keyed[move:])
                have += move
            inside = (self.text_of[:windows] == self.text_of[spread - 1 :]) & (np.arange(windows) - self.starts[self.text_of[:windows]] >= GEAR - 1)
            self.boundaries = np.unique(keyed[:windows][inside] & 0xFFFFFFFF)
        self._sums: dict[int, np.ndarray] = {}

    def digest(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        """Signed 64-bit digests of the spans; equal spans have equal ones. The two kinds are independent."""
        size = 1 << max(10, int(self.n + 1).bit_length())
        powers, inverses = _powers(which, size)
        if which not in self._sums:
            self._sums[which] = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(self._values * powers[: self.n])))
        sums = self._sums[which]
        return mix((sums[end] - sums[start]) * inverses[start], 5).view(np.int64)
