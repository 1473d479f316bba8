"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Every function takes the flat byte buffer of a slice of documents and its
``n + 1`` offsets, and works on all documents of the slice at once. Nulls
count as empty texts. A slice holds about ``SLICE_BYTES`` of text (one longer
text forms a slice of its own), which bounds a task's memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply); a bijection."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def flat(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) and not pa.types.is_large_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64) \
        if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (a, b) of about ``limit`` bytes; always whole documents."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b
        a = b


def sliced(col, limit: int = SLICE_BYTES):
    """(a, b, bytes, offsets) of each row range of a string column."""
    data, off = flat(col)
    for a, b in slices(off, limit):
        yield a, b, data[off[a]:off[b]], off[a:b + 1] - off[a]


def per_doc(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of set positions of each document."""
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, count per document) of the words ``[^\\x20\\x09-\\x0D]+``."""
    solid = ~WHITE[data]
    edge = off[:-1][off[:-1] < len(data)]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    begin[edge] = solid[edge]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    stop = off[1:][off[1:] > 0] - 1
    last[stop] = solid[stop]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(last) + 1, np.diff(np.searchsorted(start, off))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, SLICE_BYTES + 1)
        up, down = np.full(m, _U(_BASE)), np.full(m, _U(_INV))
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        _POWERS[:] = [up, down]
    return _POWERS[0], _POWERS[1]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``spans`` reads the hash of any byte range."""
    up, _ = _powers(len(data) + 1)
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:len(data)], out=p[1:])
    return p


def spans(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal ranges hash alike wherever they lie."""
    _, down = _powers(len(p))
    return mix((p[end] - p[start]) * down[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def shingles(word_hash: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word windows of each document and their number per
    document; a shorter document with words has its whole sequence as one."""
    first = np.concatenate([[0], np.cumsum(counts)])
    n = len(word_hash)
    acc = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        acc[:n - j] += mix(word_hash[j:] + _U(j + 1)) * _U((0xA0761D6478BD642F + 2 * j) | 1)
    take = np.maximum(counts - k + 1, 0)
    ok = np.zeros(n + 1, np.int64)
    full = counts >= k
    np.add.at(ok, first[:-1][full], 1)
    np.add.at(ok, (first[:-1] + take)[full], -1)
    out = mix(acc[np.cumsum(ok)[:n] > 0])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        each = [mix(np.array([sum((int(h) * (2 * i + 3) for i, h in enumerate(word_hash[first[d]:first[d + 1]])), int(counts[d]))
                              & (2**64 - 1)], np.uint64))[0] for d in short]
        out = np.insert(out, np.concatenate([[0], np.cumsum(take)])[short], each)
        take = take.copy()
        take[short] = 1
    return out, take
