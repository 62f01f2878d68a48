"""Words and shingles of whole texts, hashed with numpy over Arrow string buffers.

A word is a run of ``[^\\x20\\x09-\\x0D]``; these separators are single bytes in
UTF-8, so words are found on bytes.  Words get 64-bit hashes from a polynomial
over their bytes (prefix sums, no Python loop over words), shingles from a
linear mix of their words' hashes with a bijective finaliser.  Texts are worked
on in groups of about ``GROUP_BYTES``; a longer text is read in pieces that end
between words, so working memory stays near the text's own size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 19
SHINGLE = 5

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64 (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _seeded(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


_BYTE_CODE = _seeded(256, 11)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_CODE_LOWER = _BYTE_CODE[_LOWER]
_SHINGLE_MUL = _seeded(16, 23) | np.uint64(1)
_COUNT_MUL = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INV):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _power_arrays(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << 16
    while size < n + 1:
        size <<= 1
    return _powers(size)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind, len(col) + 1 + col.offset)[col.offset:].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def per_text(data: np.ndarray, offsets: np.ndarray, flags) -> np.ndarray:
    """Per text, the bytes for which ``flags(part, starts)`` is true.

    Texts are taken a group at a time; ``starts`` are the offsets of the texts
    within the part.
    """
    out = np.zeros(len(offsets) - 1, np.int64)
    row = 0
    while row < len(out):
        stop = int(np.searchsorted(offsets, offsets[row] + GROUP_BYTES, side="right")) - 1
        stop = min(max(stop, row + 1), len(out))
        rel = offsets[row:stop + 1] - offsets[row]
        part = data[offsets[row]:offsets[stop]]
        total = np.zeros(len(part) + 1, np.int64)
        np.cumsum(flags(part, rel), out=total[1:])
        out[row:stop] = total[rel[1:]] - total[rel[:-1]]
        row = stop
    return out


class Words:
    """Words of a run of texts: byte spans, hashes and offsets per text."""

    __slots__ = ("first", "n", "hashes", "offsets", "starts", "ends", "base")

    def __init__(self, first, n, hashes, offsets, starts=None, ends=None, base=0):
        self.first, self.n, self.hashes, self.offsets = first, n, hashes, offsets
        self.starts, self.ends, self.base = starts, ends, base


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    is_word = _IS_WORD[data]
    before = np.empty_like(is_word)
    before[1:] = is_word[:-1]
    after = np.empty_like(is_word)
    after[:-1] = is_word[1:]
    edges = offsets[offsets < len(data)]
    before[edges] = False
    after[offsets[offsets > 0] - 1] = False
    return np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1


def _hash_spans(data, starts, ends, lower: bool) -> np.ndarray:
    power, inverse = _power_arrays(len(data))
    code = (_BYTE_CODE_LOWER if lower else _BYTE_CODE)[data]
    code *= power[:len(data)]
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(code, out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * _COUNT_MUL)


def _long_words(data: np.ndarray, lower: bool) -> np.ndarray:
    """Hashes of one long text's words, read in pieces that end between words."""
    parts, at = [], 0
    while at < len(data):
        size = GROUP_BYTES
        while True:
            piece = data[at:at + size]
            if at + size >= len(data):
                cut = len(piece)
                break
            gaps = np.flatnonzero(~_IS_WORD[piece])
            if len(gaps):
                cut = int(gaps[-1]) + 1
                break
            size *= 2
        piece = piece[:cut]
        starts, ends = _spans(piece, np.array([0, cut]))
        parts.append(_hash_spans(piece, starts, ends, lower))
        at += cut
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def word_groups(col: pa.Array, lower: bool) -> Iterator[Words]:
    """The words of all texts of a column, a group of texts at a time."""
    data, offsets = text_buffers(col)
    row, n_rows = 0, len(offsets) - 1
    while row < n_rows:
        stop = int(np.searchsorted(offsets, offsets[row] + GROUP_BYTES, side="right")) - 1
        stop = min(max(stop, row + 1), n_rows)
        base = offsets[row]
        part, rel = data[base:offsets[stop]], offsets[row:stop + 1] - base
        if len(part) > GROUP_BYTES:
            hashes = _long_words(part, lower)
            yield Words(row, 1, hashes, np.array([0, len(hashes)]), base=base)
        else:
            starts, ends = _spans(part, rel)
            yield Words(row, stop - row, _hash_spans(part, starts, ends, lower),
                        np.searchsorted(starts, rel), starts, ends, base)
        row = stop


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int = SHINGLE
             ) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's ``width``-word shingles in order, and offsets.

    A text with fewer words has its whole sequence as the one shingle; a text
    without words has none.
    """
    n = len(hashes)
    counts = np.diff(offsets)
    out = np.zeros(n, np.uint64)
    valid = np.zeros(n, bool)
    if n >= width:
        full = n - width + 1
        acc = hashes[:full] * _SHINGLE_MUL[0]
        for j in range(1, width):
            acc += hashes[j:j + full] * _SHINGLE_MUL[j]
        out[:full] = acc
        left = np.repeat(offsets[1:], counts)[:full] - np.arange(full)
        valid[:full] = left >= width
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        at, size = offsets[:-1][short], counts[short]
        acc = size.astype(np.uint64) * _COUNT_MUL
        for j in range(width - 1):
            has = size > j
            acc[has] += hashes[at[has] + j] * _SHINGLE_MUL[j]
        out[at] = acc
        valid[at] = True
    per_text = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    return mix64(out[valid]), np.concatenate([[0], np.cumsum(per_text)])


class MinHasher:
    """``k`` universal hash permutations of the 32-bit universe, x -> a*x + b
    with odd ``a``; a text's coordinate is the least value over its shingles."""

    EMPTY = np.uint32(0xFFFFFFFF)

    def __init__(self, k: int, seed: int):
        r = _seeded(2 * k, seed)
        self.k = k
        self.a = (r[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.b = (r[k:] >> np.uint64(32)).astype(np.uint32)

    def signatures(self, shingle_hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """uint32 matrix (texts, k); texts without shingles get ``EMPTY``."""
        sig = np.full((len(offsets) - 1, self.k), self.EMPTY, np.uint32)
        has = np.flatnonzero(np.diff(offsets) > 0)
        if len(has):
            x = (shingle_hashes >> np.uint64(32)).astype(np.uint32)
            x ^= shingle_hashes.astype(np.uint32)
            at = offsets[:-1][has]
            t = np.empty_like(x)
            for i in range(self.k):
                np.multiply(x, self.a[i], out=t)
                t += self.b[i]
                sig[has, i] = np.minimum.reduceat(t, at)
        return sig

    def of_column(self, col: pa.Array, lower: bool = True, width: int = SHINGLE) -> np.ndarray:
        """Signatures of all texts of a string column."""
        parts = [self.signatures(*shingles(w.hashes, w.offsets, width))
                 for w in word_groups(col, lower)]
        return np.concatenate(parts) if parts else np.empty((0, self.k), np.uint32)
