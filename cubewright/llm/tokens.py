"""Vectorised words, shingles and 64-bit hashes over Arrow text, whole documents at a time.

Texts are looked at as UTF-8 bytes, in chunks of whole documents, so memory is bounded by the Arrow batch or by the longest
single document. A null text is an empty one.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words as runs of ASCII letters, digits and non-ASCII bytes, and words as runs of anything but ASCII white space.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
ALNUM[65:91] = True
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def random_words(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed * 2654435761 + 1))


_BASE = 0x2545F4914F6CDD1D | 1
_POW = np.ones(1, dtype=np.uint64)
_INV = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the odd base and of its inverse, modulo 2**64."""
    global _POW, _INV
    if len(_POW) < n:
        with np.errstate(over="ignore"):
            _POW = np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]).cumprod()
            _INV = np.concatenate([np.ones(1, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)]).cumprod()
    return _POW, _INV


#: Words of more blocks of eight bytes are hashed one by one.
_BLOCKS = 8


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 7) -> np.ndarray:
    """A 64-bit hash of each byte span: blocks of eight bytes, each mixed into what the blocks before it gave."""
    size = ends - starts
    blocks = np.concatenate([buf, np.zeros(8, np.uint8)])
    at = np.ndarray(shape=(len(buf) + 1,), dtype="<u8", buffer=blocks.data, strides=(1,))  # the eight bytes from every place on
    h = mix(size.astype(np.uint64) * U(0x9E3779B97F4A7C15) + random_words(1, seed)[0])
    left = np.arange(len(size))
    with np.errstate(over="ignore"):
        for j in range(_BLOCKS):
            left = left[size[left] > 8 * j]
            if not len(left):
                break
            rest = np.minimum(size[left] - 8 * j, 8).astype(np.uint64)
            block = at[starts[left] + 8 * j] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * rest))
            h[left] = mix((h[left] ^ block) * U(0x9FB21C651E98DF25) + U(j + 1))
    for i in left[size[left] > 8 * _BLOCKS] if len(left) else ():
        h[i] = np.frombuffer(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(4, "little")).digest(), np.uint64)[0]
    return h


def trim() -> None:
    """Hand freed memory of this worker back to the machine; many workers share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def arrow_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the offsets of each (one more than there are texts)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(col: pa.Array, most_bytes: int = 1 << 20, most_docs: int = 1000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents: (first, last + 1, their bytes, their offsets from 0). A longer document is a run of its own."""
    buf, offsets = arrow_bytes(col)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most_bytes, side="right")) - 1
        b = min(max(b, a + 1), a + most_docs, n)
        yield a, b, buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


class Words:
    """The words of a run of documents: byte spans, hashes, and for each document its first word's index (``first``)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, of: np.ndarray):
        n = len(buf)
        inside = of[buf]
        begin, end = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            full = offsets[1:] > offsets[:-1]
            at = offsets[:-1][full]
            begin[at] = inside[at]
            at = offsets[1:][full] - 1
            end[at] = inside[at]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.lowered = LOWER[buf]
        self.hash = word_hashes(self.lowered, self.starts, self.ends)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def part(self, i: int, j: int) -> Words:
        """The same of documents i to j - 1 alone."""
        out = object.__new__(Words)
        out.lowered = self.lowered
        own = slice(self.first[i], self.first[j])
        out.starts, out.ends, out.hash = self.starts[own], self.ends[own], self.hash[own]
        out.first, out.counts = self.first[i : j + 1] - self.first[i], self.counts[i:j]
        return out


_PLACE = random_words(64, 11) | U(1)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words (also across documents; the caller leaves those out)."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = words[: len(words) - k + 1] * _PLACE[0]
        for j in range(1, k):
            total = total + words[j : len(words) - k + 1 + j] * _PLACE[j]
    return mix(total)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The same for any ``k``, at a cost that doesn't grow with it."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * power[:n], out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each document, as (document, hash) in the order of the documents.

    A document of fewer words, but not none, has its whole word sequence as its one shingle. At most 1000 documents.
    """
    n = w.counts
    doc = w.doc()
    hashes = window_hashes(w.hash, k)
    left = w.first[1:][doc] - np.arange(len(doc))  # words from here to the document's end
    whole = left[: len(hashes)] >= k
    d, h = doc[: len(hashes)][whole], hashes[whole]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for i, s in enumerate(short):
                m = int(n[s])
                extra[i] = (w.hash[w.first[s] : w.first[s] + m] * _PLACE[:m]).sum() + U(m)
        d, h = np.concatenate([d, short]), np.concatenate([h, mix(extra)])
    # the document goes into the ten highest bits, most of the hash below: one sort puts equal ones together
    order = np.argsort((d.astype(np.uint64) << U(54)) | (h >> U(10)))
    d, h = d[order], h[order]
    same = (d[1:] == d[:-1]) & (h[1:] >> U(10) == h[:-1] >> U(10))
    if (same & (h[1:] != h[:-1])).any():
        order = np.lexsort((h, d))
        d, h = d[order], h[order]
        same = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
    new = np.ones(len(d), bool)
    new[1:] = ~same
    return d[new], h[new]
