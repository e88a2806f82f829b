"""Words, shingles and windows of whole Arrow text columns, hashed with numpy.

A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR
(``[^\\x20\\x09-\\x0D]+``; those bytes never occur inside a UTF-8 sequence).
Every function works on *chunks*: a few whole documents whose text lies in one
byte array, so that memory stays bounded by ``CHUNK_BYTES`` or by one document.

Hashes are 64 bits: a polynomial over the ring of integers modulo 2**64 whose
byte coefficients are random words, passed through the splitmix64 finaliser. A
window of words is hashed the same way over its word hashes, so any window
length costs one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit words."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_P))
_FOLDED = _BYTE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]

_powers = {_P: np.ones(1, _U), _P_INV: np.ones(1, _U)}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if len(_powers[base]) < n:
        p = np.full(max(n, CHUNK_BYTES + 1), _U(base))
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


@dataclass
class Chunk:
    """Some whole documents: rows ``row`` .. of the column, their bytes and words."""

    row: int
    data: np.ndarray  # uint8
    byte_at: np.ndarray  # first byte of each document, and the end
    starts: np.ndarray  # of words, in bytes
    ends: np.ndarray
    word_at: np.ndarray  # first word of each document, and the end

    @property
    def docs(self) -> int:
        return len(self.byte_at) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_at)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.n_words)

    def word_hashes(self, fold: bool = False) -> np.ndarray:
        """uint64 by word; ``fold`` takes A-Z as a-z."""
        n = len(self.data)
        v = (_FOLDED if fold else _BYTE)[self.data]
        v *= _power(_P, n)
        s = np.zeros(n + 1, _U)
        np.cumsum(v, out=s[1:])
        h = (s[self.ends] - s[self.starts]) * _power(_P_INV, n + 1)[self.starts]
        return mix(h + (self.ends - self.starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks; a null is a text without bytes."""
    if len(col) == 0:
        return
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, at, data = col.buffers()
    off = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield _chunk(lo, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def _chunk(row: int, data: np.ndarray, byte_at: np.ndarray) -> Chunk:
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Chunk(row, data, byte_at, none, none, np.zeros(len(byte_at), np.int64))
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[byte_at] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Chunk(row, data, byte_at, starts, ends, np.searchsorted(starts, byte_at))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """uint64 hash of every window of ``k`` consecutive words, documents not heeded."""
    n = len(words)
    if n < k:
        return np.zeros(0, _U)
    s = np.zeros(n + 1, _U)
    np.cumsum(words * _power(_P, n), out=s[1:])
    return mix((s[k:] - s[: n - k + 1]) * _power(_P_INV, n + 1)[: n - k + 1] + _U(k))


def window_starts(word_at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (positions in the chunk's words) of the windows that stay inside a
    document, and the number of them in each document."""
    n = np.maximum(np.diff(word_at) - k + 1, 0)
    total = int(n.sum())
    before = np.cumsum(n) - n
    return np.arange(total) + np.repeat(word_at[:-1] - before, n), n


def shingle_sets(chunk: Chunk, k: int = 5, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles of each document, ascending by hash within
    each, as one int64 array (so that Spark orders them alike), and their number
    by document. With fewer than ``k`` words the whole sequence is the only
    shingle; without words there is none."""
    w = chunk.word_hashes(fold)
    at, n = window_starts(chunk.word_at, k)
    h = window_hashes(w, k)[at] if len(at) else np.zeros(0, _U)
    doc = np.repeat(np.arange(chunk.docs), n)
    for d in np.flatnonzero((chunk.n_words > 0) & (chunk.n_words < k)):
        own = w[chunk.word_at[d] : chunk.word_at[d + 1]]
        h, doc = np.append(h, window_hashes(own, len(own))), np.append(doc, d)
    h = h.view(np.int64)
    if not len(h):
        return h, np.zeros(chunk.docs, np.int64)
    if chunk.docs < 1 << 16:
        doc = doc.astype(np.uint16)  # sorted by counting
    order = np.argsort(h)
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.bincount(doc[keep], minlength=chunk.docs)
