"""A minimal perfect hash of 128-bit keys, by levels of bit arrays.

Each level hashes the keys that are left into twice as many bits; a key that is alone at
its bit is settled there, the others go to the next level. A key's slot is the number of
bits set before its own, over all levels. The few keys that no level settles are kept as
they are. Every key of the set gets its own slot of 0 to n - 1; a key outside it may get
any, so each slot stores a fingerprint of its key, by another hash.
"""

from __future__ import annotations

import io
import struct

import numpy as np

LEVELS = 24
HEAD = struct.Struct("<8sqqq")
MAGIC = b"lexmphf1"


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(high: np.ndarray, low: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of each key (two 64-bit numbers)."""
    step = np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    return _mix(_mix(high.astype(np.uint64, copy=False) + step) ^ (low.astype(np.uint64, copy=False) + np.uint64(0x632BE59BD9B4E019)))


def fingerprints(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (hashed(high, low, 1_000_003) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Slots of distinct keys. levels: bit arrays as words of 64 bits; rest: keys that no level settled, in order."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, at = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(at + np.cumsum(ones) - ones)
            at += int(ones.sum())
        self.settled = at

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, levels: int = LEVELS) -> PerfectHash:
        high, low = high.astype(np.uint64), low.astype(np.uint64)
        made = []
        for seed in range(levels):
            if not len(high):
                break
            bits = max(64, -(-2 * len(high) // 64) * 64)
            place = (hashed(high, low, seed) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(place, minlength=bits) == 1
            made.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = ~alone[place]
            high, low = high[left], low[left]
        order = np.lexsort((low, high))
        return cls(made, np.stack([high[order], low[order]], axis=1))

    def __len__(self) -> int:
        return self.settled + len(self.rest)

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for a key that surely isn't in the set."""
        high, low = high.astype(np.uint64), low.astype(np.uint64)
        out = np.full(len(high), -1, dtype=np.int64)
        left = np.arange(len(high))
        for seed, words in enumerate(self.levels):
            if not len(left):
                break
            place = hashed(high[left], low[left], seed) % np.uint64(64 * len(words))
            word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            hit = (words[word] >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.ranks[seed][word] + below)[hit]
            left = left[~hit]
        if len(self.rest):
            known = {(a, b): k for k, (a, b) in enumerate(self.rest.tolist())}
            for i in left.tolist():
                k = known.get((int(high[i]), int(low[i])))
                out[i] = -1 if k is None else self.settled + k
        return out

    def dump(self) -> bytes:
        out = io.BytesIO()
        out.write(HEAD.pack(MAGIC, len(self.levels), len(self.rest), len(self)))
        out.write(np.array([len(w) for w in self.levels], dtype="<i8").tobytes())
        for words in self.levels:
            out.write(words.astype("<u8").tobytes())
        out.write(self.rest.astype("<u8").tobytes())
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> tuple[PerfectHash, int]:
        """With the number of bytes that were read."""
        magic, levels, rest, n = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not an index of keys")
        at = HEAD.size
        sizes = np.frombuffer(raw, "<i8", levels, at).tolist()
        at += 8 * levels
        words = []
        for size in sizes:
            words.append(np.frombuffer(raw, "<u8", size, at))
            at += 8 * size
        keys = np.frombuffer(raw, "<u8", 2 * rest, at).reshape(rest, 2)
        made = cls(words, keys)
        if len(made) != n:
            raise ValueError("a damaged index of keys")
        return made, at + 16 * rest
