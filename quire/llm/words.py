"""Word positions and substring hashes of many texts at once, over their UTF-8 bytes.

A batch of texts is one byte array with offsets. Words and lines have 64-bit hashes of their bytes in blocks of eight, each
mixed before the next is added; these stand where equality decides a result. `hashes` are polynomial prefix hashes, two
look-ups for any substring; some regular strings of a thousand bytes and more share one, so these only propose candidates.
Either depends on the bytes alone, not on where in a batch they stand.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
Batches = Iterator[pa.RecordBatch]
CHUNK = 2 << 20
LONG = 4096
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def block_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, eight bytes at a time; of long ranges by BLAKE2."""
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    n = (end - start).astype(np.int64)
    h = mix(n.astype(U) + U(0x2545F4914F6CDD1D))
    far = n > LONG
    for k in np.flatnonzero(far).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    live, done = np.flatnonzero((n > 0) & ~far), 0
    while len(live):
        left = n[live] - done
        word = np.ascontiguousarray(eight[start[live] + done]).view("<u8").ravel()
        word &= np.where(left < 8, (U(1) << (U(8) * np.minimum(left, 7).astype(U))) - U(1), U(0xFFFFFFFFFFFFFFFF))
        h[live] = mix(h[live] * U(0xA0761D6478BD642F) + mix(word + U(0xE7037ED1A0B428DB)))
        done += 8
        live = live[left > 8]
    return h


_VALUES = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept up to a few chunks, made anew for a longer text."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    made, asked, n = [], n, max(n, 2 * CHUNK)
    for b in (_BASE, _INVERSE):
        p = np.full(n, b, U)
        p[0] = 1
        made.append(np.cumprod(p, dtype=U))
    if n <= 4 * CHUNK:
        _POWERS[:] = made
    return made[0][:asked], made[1][:asked]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, which gives its task's memory back at the end: workers live on, and allocators would keep it for them."""

    def out(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return out


def pieces(batch: pa.RecordBatch, text: str, chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about chunk bytes of text each; a longer text has a range of its own."""
    off = offsets(batch.column(text))[1]
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + chunk, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def offsets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, where, data = col.buffers()
    off = np.frombuffer(where, np.int64, len(col) + 1, 8 * col.offset) if where else np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


class Texts:
    """The texts of some rows: data, off; words by starts and ends; first and last hold each text's range of words."""

    def __init__(self, col: pa.Array, lower: bool = False, separators: np.ndarray = _SPACE):
        self.data, self.off = offsets(col)
        self.n = len(self.off) - 1
        if lower:
            self.data = _LOWER[self.data]
        self._hash = None
        self.split(separators)

    def split(self, separators: np.ndarray) -> None:
        inner = ~separators[self.data]
        self.inner = inner
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.off] = True
        before = np.empty_like(inner)
        before[:1] = False
        before[1:] = inner[:-1]
        self.starts = np.flatnonzero(inner & (~before | edge[:-1]))
        after = np.empty_like(inner)
        after[-1:] = False
        after[:-1] = inner[1:]
        self.ends = np.flatnonzero(inner & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.off[:-1])
        self.last = np.searchsorted(self.starts, self.off[1:])
        self.count = self.last - self.first

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit polynomial hashes of the byte ranges."""
        up, down = _powers(len(self.data) + 1)
        if self._hash is None:
            h = np.zeros(len(self.data) + 1, U)
            np.cumsum(_VALUES[self.data] * up[:-1], out=h[1:])
            self._hash = h
        return mix((self._hash[end] - self._hash[start]) * down[start] + (end - start).astype(U))

    def word_hashes(self) -> np.ndarray:
        return block_hashes(self.data, self.starts, self.ends)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n), self.count)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each text has."""
        c = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.off[1:]] - c[self.off[:-1]]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive values, one for each start that has n of them in the array."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    x = np.full(m, n * 0x632BE59BD9B4E019 & (1 << 64) - 1, U)
    for k in range(n):
        x = mix(x * U(0xA0761D6478BD642F) + h[k : k + m])
    return x


def sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of integer values over the ranges."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[last] - c[first]
