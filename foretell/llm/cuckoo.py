"""A cuckoo filter over 64-bit keys, filled and emptied in whole batches with numpy.

Buckets of SLOTS 16-bit fingerprints (0: free); a key's two buckets differ by the hash of its fingerprint.  A key may be added more than once: `copies` counts its fingerprints in both buckets, so it is never below the number of times that the key was added and not removed, and above it only where fingerprints collide.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
LOAD = 0.8
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_S = np.uint64(33)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _MIX[0]
    x = (x ^ (x >> _S)) * _MIX[1]
    return x ^ (x >> _S)


def _place_in_group(groups: np.ndarray) -> np.ndarray:
    """The number (from 0) of each item among those of its group, in order."""
    order = np.argsort(groups, kind="stable")
    own = groups[order]
    new = np.r_[True, own[1:] != own[:-1]] if len(own) else np.empty(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0)) if len(own) else np.empty(0, np.int64)
    out = np.empty(len(groups), np.int64)
    out[order] = np.arange(len(own)) - first
    return out


class Full(Exception):
    """No place was found for some key; the filter must be built anew with more buckets."""


class CuckooFilter:
    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, entries: int) -> CuckooFilter:
        """An empty filter for so many entries."""
        buckets = 1 << max(3, int(np.ceil(np.log2(max(1, entries) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    @classmethod
    def of(cls, keys: np.ndarray, entries: int = 0) -> CuckooFilter:
        """A filter that holds keys, with room for `entries` at least."""
        entries = max(entries, len(keys))
        while True:
            made = cls.sized(entries)
            try:
                made.add(keys)
                return made
            except Full:
                entries *= 2

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @property
    def entries(self) -> int:
        return int(np.count_nonzero(self.table))

    def _where(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _mix(keys.astype(np.uint64))
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        one = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return prints, one, self._other(prints, one)

    def _other(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (_mix(prints.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def copies(self, keys: np.ndarray) -> np.ndarray:
        prints, one, two = self._where(keys)
        n = (self.table[one] == prints[:, None]).sum(axis=1)
        return n + np.where(one == two, 0, (self.table[two] == prints[:, None]).sum(axis=1))

    def add(self, keys: np.ndarray, most_rounds: int = 500) -> None:
        """Add keys, repeats included.  All items without a place move at once: each takes a free slot of its bucket or of the other, else one of a bucket puts out the fingerprint there, which goes on from its other bucket."""
        if self.entries + len(keys) > self.table.size * 0.95:
            raise Full
        prints, bucket, _ = self._where(keys)
        for turn in range(most_rounds):
            for _ in range(2):
                place = _place_in_group(bucket)
                free = SLOTS - np.count_nonzero(self.table[bucket], axis=1)
                fits = place < free
                into, which = bucket[fits], place[fits]
                empty = np.argsort(self.table[into] != 0, axis=1, kind="stable")  # free slots first
                self.table[into, empty[np.arange(len(into)), which]] = prints[fits]
                prints, bucket = prints[~fits], bucket[~fits]
                if not len(prints):
                    return
                bucket = self._other(prints, bucket)
            first = _place_in_group(bucket) == 0
            at, slot = bucket[first], (turn + bucket[first]) % SLOTS
            out = self.table[at, slot]
            self.table[at, slot] = prints[first]
            prints, bucket = np.r_[out, prints[~first]], np.r_[at, bucket[~first]]
            bucket = self._other(prints, bucket)
            if not np.all(out):  # a free slot was taken after all
                prints, bucket = prints[prints != 0], bucket[prints != 0]
        raise Full

    def remove(self, keys: np.ndarray) -> None:
        """Remove one copy for each of keys, which must have been added."""
        prints, one, two = self._where(keys)
        turn = _place_in_group((np.minimum(one, two).astype(np.int64) << 16) | prints)
        for k in range(int(turn.max()) + 1 if len(turn) else 0):
            now = turn == k
            p, at = prints[now], one[now]
            here = self.table[at] == p[:, None]
            at = np.where(here.any(axis=1), at, two[now])
            here = self.table[at] == p[:, None]
            if not here.any(axis=1).all():
                raise KeyError("a key that the filter does not hold")
            self.table[at, here.argmax(axis=1)] = 0
