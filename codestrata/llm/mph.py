"""Minimal perfect hash: n distinct 128-bit keys to slots 0 to n - 1.

On each level the keys that are left are hashed into twice as many places. Those
alone in their place stay there, the others go on to the next level. A slot is the
rank of the key's place among all taken places. A key that was not built in may get
any slot or none, so callers compare what the slot holds.
"""

from __future__ import annotations

import numpy as np

_LEVELS = 64
_MASK = (1 << 64) - 1
_STEP, _A, _B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def as_keys(digests: list[bytes] | bytes, width: int = 16) -> np.ndarray:
    """The first 16 bytes of each digest of ``width`` bytes, as two numbers."""
    data = digests if isinstance(digests, bytes) else b"".join(digests)
    return np.frombuffer(data, np.uint8).reshape(-1, width)[:, :16].copy().view("<u8").reshape(-1, 2)


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    x = keys[:, 0] ^ np.uint64((level + 1) * _STEP & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_A) + keys[:, 1]
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_B)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class Mph:
    def __init__(self, sizes: list[int], packed: bytes) -> None:
        self.sizes, self.packed = [int(x) for x in sizes], packed
        self.bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=sum(self.sizes)).astype(bool)
        self.rank = np.cumsum(self.bits) - 1
        self.starts = [0, *np.cumsum(self.sizes).tolist()]
        self._one: tuple[bytes, list[int]] | None = None

    @classmethod
    def build(cls, keys: np.ndarray) -> Mph:
        sizes, taken = [], []
        while len(keys):
            if len(sizes) == _LEVELS:
                raise ValueError("keys repeat")
            size = 2 * len(keys) + 1
            place = _place(keys, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            taken.append(alone)
            keys = keys[~alone[place]]
        return cls(sizes, np.packbits(np.concatenate(taken)).tobytes() if taken else b"")

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it is certain that the key was not built in."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _place(keys[left], level, size) + self.starts[level]
            found = self.bits[at]
            out[left[found]] = self.rank[at[found]]
            left = left[~found]
        return out

    def slot(self, a: int, b: int) -> int:
        """``slots`` for one key."""
        if self._one is None:
            self._one = self.bits.tobytes(), self.rank.tolist()
        bits, rank = self._one
        for level, size in enumerate(self.sizes):
            x = a ^ ((level + 1) * _STEP & _MASK)
            x = (((x ^ (x >> 30)) * _A) + b) & _MASK
            x = ((x ^ (x >> 27)) * _B) & _MASK
            at = (x ^ (x >> 31)) % size + self.starts[level]
            if bits[at]:
                return rank[at]
        return -1
