"""A vectorised memo from short byte strings (units of text) to rows of integers, for encoders that work unit by unit.

Units are slices of one byte array.  Units of up to 16 bytes are held in an open-addressing table of numpy arrays under
their exact bytes; longer ones in a dictionary.  Only units that the memo doesn't know are encoded, in one call a batch.
The memo is bounded: beyond `capacity` units it is emptied.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_ONES = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)
#: _MASKS[n] keeps the lowest n bytes of a little-endian word of 8.
_MASKS = np.append(_ONES, np.uint64(0xFFFFFFFFFFFFFFFF))
PAD = b"\0" * 16


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after the other, padded by 16 zeros, and the n + 1 places where they begin and end."""
    places = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=places[1:])
    return np.frombuffer(b"".join([*texts, PAD]), np.uint8), places


class UnitMemo:
    def __init__(self, encode: Callable[[list[bytes]], list], capacity: int = 1_000_000):
        self.encode, self.capacity = encode, capacity
        self.bits = int(2 * capacity - 1).bit_length()
        self._clear()

    def _clear(self) -> None:
        size = 1 << self.bits
        self.k1, self.k2 = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.row = np.full(size, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.n = 0
        self.begin, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.flat, self.used = np.zeros(4096, np.uint32), 0

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rows of the keys, -1 for those that aren't there."""
        out = np.full(len(a), -1, np.int32)
        slot = self._slots(a, b)
        row = self.row[slot]
        hit = (self.k1[slot] == a) & (self.k2[slot] == b)
        out[hit] = row[hit]
        open_ = np.flatnonzero(~hit & (row >= 0))
        last = len(self.row) - 1
        while len(open_):
            s = (slot[open_] + 1) & last
            slot[open_] = s
            row = self.row[s]
            hit = (self.k1[s] == a[open_]) & (self.k2[s] == b[open_]) & (row >= 0)
            out[open_[hit]] = row[hit]
            open_ = open_[~hit & (row >= 0)]
        return out

    def _insert(self, a: np.ndarray, b: np.ndarray, rows: np.ndarray) -> None:
        """Different keys that aren't there yet."""
        slot, left, last = self._slots(a, b), np.arange(len(a)), len(self.row) - 1
        while len(left):
            s = slot[left]
            free = np.flatnonzero(self.row[s] < 0)
            _, first = np.unique(s[free], return_index=True)
            won = left[free[first]]
            self.k1[slot[won]], self.k2[slot[won]], self.row[slot[won]] = a[won], b[won], rows[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & last

    def _add(self, units: list[bytes]) -> np.ndarray:
        """Encodes units; their rows."""
        found = self.encode(units)
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        n, used = self.n + len(found), self.used + int(sizes.sum())
        while n > len(self.begin):
            self.begin, self.size = np.append(self.begin, np.zeros_like(self.begin)), np.append(self.size, np.zeros_like(self.size))
        while used > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        rows = np.arange(self.n, n, dtype=np.int32)
        self.size[self.n : n] = sizes
        self.begin[self.n : n] = self.used + np.cumsum(sizes) - sizes
        if found:
            self.flat[self.used : used] = np.fromiter((i for x in found for i in x), np.uint32, used - self.used)
        self.n, self.used = n, used
        return rows

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The rows of the units data[start:end]; data has 16 spare bytes at its end.  Valid until the next call."""
        if self.n > self.capacity:
            self._clear()
        size = ends - starts
        short = size <= 16
        if not data[:-16].all():  # a zero byte would look like no byte
            zeros = np.append(0, np.cumsum(data == 0))
            short &= zeros[ends] == zeros[starts]
        words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        at, n = (starts, size) if short.all() else (starts[short], size[short])
        a = words[at] & _MASKS[np.minimum(n, 8)]
        b = words[np.minimum(at + 8, len(words) - 1)] & _MASKS[np.clip(n - 8, 0, 8)]
        got = self._find(a, b)
        missing = np.flatnonzero(got < 0)
        if len(missing):
            key = np.empty(len(missing), np.dtype([("a", "<u8"), ("b", "<u8")]))
            key["a"], key["b"] = a[missing], b[missing]
            _, first, back = np.unique(key, return_index=True, return_inverse=True)
            one = missing[first]
            raw = data.tobytes()
            new = self._add([raw[i : i + k] for i, k in zip(at[one].tolist(), n[one].tolist(), strict=True)])
            self._insert(a[one], b[one], new)
            got[missing] = new[back]
        if len(got) == len(starts):
            return got
        out = np.empty(len(starts), np.int32)
        out[short] = got
        others = np.flatnonzero(~short)
        units = [data[i:k].tobytes() for i, k in zip(starts[others].tolist(), ends[others].tolist(), strict=True)]
        new_units = list(set(units).difference(self.long))
        self.long.update(zip(new_units, self._add(new_units).tolist(), strict=True))
        out[others] = [self.long[u] for u in units]
        return out

    def values(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All integers of the rows, one after the other, and how many each row has."""
        sizes = self.size[rows].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        index = np.repeat(self.begin[rows] - (ends - sizes), sizes) + np.arange(total)
        return self.flat[index], sizes
