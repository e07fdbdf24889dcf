"""Vectorised text primitives over Arrow string columns (numpy inside tasks).

Texts are handled as one UTF-8 byte array with document offsets, so that
word splitting and hashing cost a few array passes instead of a Python loop
per word. A null text counts as empty everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_U = np.uint64
_MASK = (1 << 64) - 1


def _odd_constants(seed: int, count: int) -> np.ndarray:
    """Odd 64-bit multipliers derived from a seed by the splitmix64 rule."""
    out, x = [], seed
    for _ in range(count):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append((z ^ (z >> 31)) | 1)
    return np.array(out, dtype=_U)


_BASE = int(_odd_constants(7, 1)[0])
_POS = _odd_constants(11, 64)
_POW_BITS = 16


def _powers() -> np.ndarray:
    out = np.empty(1 << _POW_BITS, dtype=_U)
    x = 1
    for i in range(len(out)):
        out[i] = x
        x = (x * _BASE) & _MASK
    return out


_POW: np.ndarray | None = None


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads every input bit over the word."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    _, off, dat = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(off, width, len(column) + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    data = np.frombuffer(dat, np.uint8) if dat is not None and dat.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (a longer row stands alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes unchanged."""
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def separator_table(ranges: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for a, b in ranges:
        table[a:b + 1] = True
    return table


#: the separators of ``[^\x20\x09-\x0D]+``
SPACES = separator_table([(0x20, 0x20), (0x09, 0x0D)])
#: the separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
PUNCTUATED = separator_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: line feed only
LINE_FEED = separator_table([(0x0A, 0x0A)])


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document index) of the maximal runs without separator bytes."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < len(data)]] = False
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span. The spans are ascending and don't overlap."""
    global _POW
    if not len(starts):
        return np.zeros(0, _U)
    if _POW is None:
        _POW = _powers()
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    at = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    if total == len(data):
        raw = data
    else:
        raw = data[at + np.repeat(starts, lengths)]
    value = raw.astype(_U) + _U(1)
    if int(lengths.max()) > len(_POW):
        value *= _POW[at & (len(_POW) - 1)] * ((at >> _POW_BITS).astype(_U) * _U(2) + _U(1))
    else:
        value *= _POW[at]
    summed = np.add.reduceat(value, first)
    return mix64(summed ^ (lengths.astype(_U) * _POS[0]))


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams with their document, in text order.

    A document with fewer words than ``width`` (but at least one) has its
    whole sequence as its only shingle; one without words has none.
    """
    counts = np.bincount(doc, minlength=n_docs)
    out_h, out_d = [], []
    if len(words) >= width:
        g = np.zeros(len(words) - width + 1, _U)
        for j in range(width):
            g += words[j:len(words) - width + 1 + j] * _POS[1 + j]
        whole = doc[:len(g)] == doc[width - 1:]
        out_h.append(mix64(g[whole]))
        out_d.append(doc[:len(g)][whole])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        begin = np.searchsorted(doc, short, "left")
        g = counts[short].astype(_U) * _POS[40]
        for j in range(width - 1):
            has = counts[short] > j
            g[has] += words[begin[has] + j] * _POS[1 + j]
        out_h.append(mix64(g))
        out_d.append(short)
    if not out_h:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h, d = np.concatenate(out_h), np.concatenate(out_d)
    if len(out_d) > 1:
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return h, d
