"""A minimal perfect hash over 128-bit digests, with a fingerprint, a count and a last holder for each."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DIGEST = np.dtype([("lo", "<u8"), ("hi", "<u8")])
ROOM = 2  # bits of a level for each digest that it tries to place
MOST = 255  # counts are held in one byte


def _positions(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Where a level of so many bits puts each digest: both halves, mixed with the level."""
    with np.errstate(over="ignore"):
        x = keys["lo"] ^ (keys["hi"] * np.uint64(2 * level + 1) + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return (x % np.uint64(bits)).astype(np.int64)


@dataclass
class DigestIndex:
    """Digests of one shard, told apart by bit levels: a digest sits in the first level where no other one shares its bit.

    The rank of that bit is the digest's slot, so n digests fill the slots 0 to n - 1.
    """

    sizes: np.ndarray  # bits of each level, multiples of 64
    words: np.ndarray  # all levels, 64 bits a word
    prints: np.ndarray  # by slot: 32 bits of the digest
    counts: np.ndarray  # by slot: holders, MOST at most
    lasts: np.ndarray  # for slots with two holders or more, in order: the largest holder

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, lasts: np.ndarray) -> DigestIndex:
        """From distinct digests, how many hold each and the largest holder."""
        sizes, levels, left = [], [], keys
        while len(left):
            bits = -(-ROOM * len(left) // 64) * 64
            at = _positions(left, len(sizes), bits)
            alone = np.bincount(at, minlength=bits) == 1
            sizes.append(bits)
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        words = np.concatenate(levels) if levels else np.zeros(0, "<u8")
        index = cls(np.array(sizes, dtype=np.int64), words, np.zeros(len(keys), "<u4"), np.zeros(len(keys), "u1"), np.zeros(0, "<i8"))
        slot = index.slots(keys)
        index.prints[slot] = (keys["hi"] >> np.uint64(32)).astype("<u4")
        index.counts[slot] = np.minimum(counts, MOST)
        by_slot = np.zeros(len(keys), "<i8")
        by_slot[slot] = lasts
        index.lasts = by_slot[index.counts > 1]
        return index

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 or another digest's slot for those not in the index."""
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        out = np.full(len(keys), -1, dtype=np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, bits in enumerate(self.sizes.tolist()):
            at = base + _positions(keys[open_], level, bits)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (ranks[at >> 6] + below)[hit]
            open_, base = open_[~hit], base + bits
        return out

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, last holder) of each digest; 0 where it is not in the index.

        The last holder is given only for counts of two or more. A digest that is not in the
        index passes for one that is with a probability of 2^-32; those in it are never confused.
        """
        slot = self.slots(keys)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == (keys["hi"][known] >> np.uint64(32)).astype("<u4")
        counts, lasts = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        counts[known] = self.counts[slot[known]]
        shared = counts > 1
        lasts[shared] = self.lasts[(np.cumsum(self.counts > 1) - 1)[slot[shared]]]
        return counts, lasts
