"""A minimal perfect hash over 128-bit keys as numpy arrays: cascaded bit arrays with ranks."""

from __future__ import annotations

import numpy as np

#: Bits of a level for each key that reaches it.
GAMMA = 2.0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64(level + 1) * _STEP
    return (mixed(keys[:, 0] ^ mixed(keys[:, 1] + salt)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Maps ``n`` distinct keys, rows of two uint64, one to one to the slots 0..n-1.

    At each level a key takes the bit that its hash names, unless another key of that level names it too;
    those go on to the next level. The slot of a key is the number of set bits before its own. A key that
    is not of the set gets some slot or -1, so slots must hold a fingerprint to tell.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(sizes)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        with np.errstate(over="ignore"):
            while len(keys):
                size = 64 * -(-int(GAMMA * len(keys)) // 64)
                places = _places(keys, len(sizes), size)
                alone = np.bincount(places, minlength=size)[places] == 1
                level = np.zeros(size, bool)
                level[places[alone]] = True
                sizes.append(size)
                bits.append(level)
                keys = keys[~alone]
        packed = np.packbits(np.concatenate(bits) if bits else np.zeros(0, bool), bitorder="little")
        return cls(np.array(sizes, np.int64), packed.view("<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        with np.errstate(over="ignore"):
            for level, size in enumerate(self.sizes.tolist()):
                if not len(left):
                    break
                places = self.starts[level] + _places(keys[left], level, size)
                word, bit = places >> 6, (places & 63).astype(np.uint64)
                here = self.words[word]
                hit = (here >> bit) & np.uint64(1) == 1
                below = np.bitwise_count(here & ((np.uint64(1) << bit) - np.uint64(1)))
                found[left[hit]] = (self.before[word] + below)[hit]
                left = left[~hit]
        return found

    def to_bytes(self) -> bytes:
        return np.concatenate([[len(self.sizes)], self.sizes]).astype("<i8").tobytes() + self.words.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        levels = int(np.frombuffer(data, "<i8", 1)[0])
        return cls(np.frombuffer(data, "<i8", levels, 8), np.frombuffer(data, "<u8", offset=8 * (levels + 1)))
