"""Minimal perfect hashing by levels of collision-free bits (after Limasset et al., 2017).

Each level hashes the keys that are left into twice as many bits; keys that are
alone on their bit stay there, the others go to the next level. A key's slot is
the number of bits set before its own, so n keys get the slots 0 to n - 1. A
stored fingerprint tells keys that were never indexed.

Stored, a level's bits stand beside a count of earlier set bits for every
RANK_BITS bits, so that :func:`probe` answers a key from the stored bytes alone:
a hash, a bit and at most RANK_BITS bits to count per level, and a few levels.
"""

from __future__ import annotations

import struct

import numpy as np

#: Bits per key that is left at a level.
GAMMA = 2
FINGERPRINT_SEED = 0x5BD1E995
#: Bits between two stored counts.
RANK_BITS = 512
_MASK = (1 << 64) - 1


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of uint64 keys."""
    with np.errstate(over="ignore"):
        x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def mix_one(key: int, seed: int) -> int:
    """:func:`mix` of one key."""
    x = key ^ ((seed * 0x9E3779B97F4A7C15) & _MASK)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def probe(raw: bytes, key: int) -> int:
    """Slot of a key in a stored index, or -1: reads the places that the key hashes to and nothing else."""
    n_levels, n = struct.unpack_from("<II", raw)
    for k in range(n_levels):
        size, before, at = struct.unpack_from("<QQQ", raw, 8 + 24 * k)
        bit = mix_one(key, k + 1) % size
        byte = at + bit // 8
        if raw[byte] >> (bit % 8) & 1:
            block = bit // RANK_BITS
            (rank,) = struct.unpack_from("<I", raw, at + (size + 7) // 8 + 4 * block)
            here = int.from_bytes(raw[at + block * (RANK_BITS // 8) : byte], "little").bit_count()
            here += (raw[byte] & ((1 << bit % 8) - 1)).bit_count()
            slot = before + rank + here
            (held,) = struct.unpack_from("<I", raw, len(raw) - 4 * n + 4 * slot)
            return slot if held == mix_one(key, FINGERPRINT_SEED) & 0xFFFFFFFF else -1
    return -1


class PerfectHash:
    """Slots and fingerprints of distinct uint64 keys."""

    def __init__(self, levels: list[np.ndarray], fingerprints: np.ndarray):
        self.levels, self.fingerprints = levels, fingerprints
        sizes = np.cumsum([0, *(int(level.sum()) for level in levels)])
        self.before = [np.cumsum(level) - level + at for level, at in zip(levels, sizes)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = np.asarray(keys, np.uint64), []
        while len(left):
            size = GAMMA * len(left) + 1
            at = (mix(left, len(levels) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.int64))
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        out = cls(levels, np.zeros(len(keys), np.uint32))
        out.fingerprints[out._slots(np.asarray(keys, np.uint64))] = mix(np.asarray(keys, np.uint64), FINGERPRINT_SEED).astype(np.uint32)
        return out

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (level, before) in enumerate(zip(self.levels, self.before)):
            at = (mix(keys[left], k + 1) % np.uint64(len(level))).astype(np.int64)
            here = level[at] == 1
            out[left[here]] = before[at[here]]
            left = left[~here]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1 for keys that the fingerprint shows not to be indexed."""
        keys = np.asarray(keys, np.uint64)
        slots = self._slots(keys)
        held = slots >= 0
        held[held] = self.fingerprints[slots[held]] == mix(keys[held], FINGERPRINT_SEED).astype(np.uint32)
        return np.where(held, slots, -1)

    def to_bytes(self) -> bytes:
        parts, heads, at, before = [], [], 8 + 24 * len(self.levels), 0
        for level in self.levels:
            starts = np.arange(0, len(level), RANK_BITS)
            counts = np.add.reduceat(level, starts)
            body = np.packbits(level.astype(np.uint8), bitorder="little").tobytes() + (np.cumsum(counts) - counts).astype("<u4").tobytes()
            heads.append(struct.pack("<QQQ", len(level), before, at))
            parts.append(body)
            at, before = at + len(body), before + int(counts.sum())
        head = struct.pack("<II", len(self.levels), len(self.fingerprints))
        return b"".join([head, *heads, *parts, self.fingerprints.astype("<u4").tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n_levels, n = struct.unpack_from("<II", raw)
        levels = []
        for k in range(n_levels):
            size, _, at = struct.unpack_from("<QQQ", raw, 8 + 24 * k)
            packed = np.frombuffer(raw, np.uint8, (size + 7) // 8, at)
            levels.append(np.unpackbits(packed, count=size, bitorder="little").astype(np.int64))
        return cls(levels, np.frombuffer(raw, "<u4", n, len(raw) - 4 * n).copy())
