"""A minimal perfect hash over distinct 64-bit keys, built and asked for whole arrays.

Level by level, keys that are alone on their bit of a bit array settle there and the others
go on to the next level; a key's number is the count of set bits before its own, so n keys
have the numbers 0 to n - 1. Keys take about three bits each. What a key that wasn't built in
gets is arbitrary: callers compare a fingerprint.
"""

import numpy as np

from herdframe.llm.common import mix

#: Bits of a level for each key that reaches it, and levels before the rest is kept as it is.
GAMMA, LEVELS = 2, 24


class PerfectHash:
    def __init__(self, keys: np.ndarray):
        self.levels, self.n, left = [], 0, keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, GAMMA * len(left))
            at = self._place(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone)
            ranks = np.append(0, np.cumsum(np.add.reduceat(alone, np.arange(0, size, 64), dtype=np.int64)))[:-1] + self.n
            self.levels.append((size, bits, ranks))
            self.n += int(alone.sum())
            left = left[~alone[at]]
        self.rest = np.sort(left)
        self.n += len(left)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ mix(np.uint64([level + 1]))) % np.uint64(size)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys; -1 for some of those that weren't built in."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, bits, ranks) in enumerate(self.levels):
            if not len(left):
                return out
            at = self._place(keys[left], level, size)
            hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            got, at = left[hit], at[hit]
            word = at >> 6
            # bits of the same run of 64 that come before
            run = np.zeros((len(at), 8), np.uint8)
            for k in range(8):
                byte = np.minimum(word * 8 + k, len(bits) - 1)
                whole, part = (at & 63) >> 3 > k, (at & 63) >> 3 == k
                run[:, k] = np.where(whole, bits[byte], np.where(part, bits[byte] & ~(0xFF >> (at & 7)).astype(np.uint8), 0))
            out[got] = ranks[word] + np.bitwise_count(run).sum(1, dtype=np.int64)
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            same = self.rest[at] == keys[left]
            out[left[same]] = self.n - len(self.rest) + at[same]
        return out
