"""Words and word hashes of many texts at once, as numpy arrays over the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A 64-bit number for each byte.
BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BASE = 0xD1342543DE82EF95
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2 ** 64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            np.cumprod(p, out=p)
            _powers[name] = p
    return _powers["up"][:n], _powers["down"][:n]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MARK = _BLANK.copy()
_MARK[[*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True
#: Bytes whose hashes are added up at a time, so that they stay in the cache.
_STEP = 1 << 15


def _mapped(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table`` (one byte or truth value for each byte) at every byte of ``raw``, read only."""
    return np.frombuffer(raw.tobytes().translate(table.tobytes()), table.dtype)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the offset of each row in them, with the end."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of every row of a string column: lower case in A to Z, cut at ASCII white space or also at ASCII marks.

    ``starts`` and ``ends`` are byte offsets into ``data``, ``first`` the number of each row's first word (with the end), ``hashes`` a
    64-bit hash of each word.
    """

    def __init__(self, column: pa.Array, at_marks: bool = False, hashes: bool = True):
        raw, self.offsets = column_bytes(column)
        self.data = _mapped(raw, LOWER)
        gap = _mapped(raw, _MARK if at_marks else _BLANK)
        inside = np.zeros(len(raw) + 1, bool)
        inside[:-1] = ~gap
        fresh = inside[:-1].copy()
        fresh[1:] &= ~inside[:-2]
        borders = self.offsets[:-1][self.offsets[:-1] < len(raw)]
        fresh[borders] = inside[borders]  # a row starts a word of its own
        stop = inside[:-1] & ~inside[1:]
        last = self.offsets[1:][self.offsets[1:] > self.offsets[:-1]] - 1
        stop[last] = inside[last]
        self.starts, self.ends = np.flatnonzero(fresh), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        if hashes:
            up, down = _power(len(raw))
            total, before = np.zeros(_STEP + 1, np.uint64), np.zeros(1, np.uint64)
            sums = np.empty(len(self.starts), np.uint64), np.empty(len(self.starts), np.uint64)
            for a in range(0, len(raw), _STEP):
                b = min(a + _STEP, len(raw))
                np.cumsum(BYTE_HASH[self.data[a:b]] * up[a:b], out=total[1 : b - a + 1])
                for at, out, lo in ((self.starts, sums[0], a), (self.ends, sums[1], a + 1)):
                    i, j = np.searchsorted(at, (lo, lo + b - a))
                    out[i:j] = total[at[i:j] - a] + before
                before = before + total[b - a]
            self.hashes = mixed((sums[1] - sums[0]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the number of each row's first one; a row with fewer words has one, of all of them."""
    h, first = words.hashes, words.first
    count = np.diff(first)
    out = np.zeros(len(h), np.uint64)
    n = len(h) - size + 1
    if n > 0:
        for k in range(size):
            out[:n] += h[k : k + n] * np.uint64(pow(int(_ODD), 2 * k + 3, 1 << 64))
    kept = np.maximum(count - size + 1, 0)
    short = np.flatnonzero((count > 0) & (count < size))
    for row in short.tolist():
        a = first[row]
        out[a] = sum((int(h[a + k]) * pow(int(_ODD), 2 * k + 5, 1 << 64) for k in range(count[row])), int(count[row])) % (1 << 64)
    kept[short] = 1
    starts = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(kept, out=starts[1:])
    take = np.arange(starts[-1]) + np.repeat(first[:-1] - starts[:-1], kept)
    return mixed(out[take]), starts
