"""Vectorised hashing of the words of many texts at once, straight from Arrow's string buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D; the bytes A-Z count as a-z where `lower` is set.
Each word's hash is a polynomial over random 64-bit values of its bytes, taken from one prefix sum over
the whole buffer, then mixed; equal words have equal hashes, and two different words share one with a
probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C13  # odd, and 2 modulo 4 once one is taken away
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
#: Bytes of text that are hashed at once; a longer text is hashed alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of the splitmix64 generator)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _values(lower: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
    if lower:
        v[65:91] = v[97:123]
    return v


_VALUES = {False: _values(False), True: _values(True)}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK * 2)
        for i, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its values; null values are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first value, last value + 1, bytes, offsets into them) for pieces of about `CHUNK` bytes."""
    data, offs = spans(column)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, start and end of every word, in order."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, none
    full = offs[:-1] < offs[1:]
    gap = _SPACE[data]
    first = np.empty(n, bool)
    first[0], first[1:] = True, gap[:-1]
    first[offs[:-1][full]] = True
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, gap[1:]
    last[offs[1:][full] - 1] = True
    ink = ~gap
    starts = np.flatnonzero(first & ink)
    ends = np.flatnonzero(last & ink) + 1
    power, inverse = _powers(n)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    terms = _VALUES[lower][data]
    terms *= power[:n]
    np.cumsum(terms, out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))
    return h, np.searchsorted(offs, starts, side="right") - 1, starts, ends


def shingle_sets(h: np.ndarray, doc: np.ndarray, n_docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-word shingle hashes of each text, one text after the other, and their numbers.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    n_words = np.bincount(doc, minlength=n_docs)
    if len(h) >= n:
        inside = doc[: len(h) - n + 1] == doc[n - 1 :]
        at = np.flatnonzero(inside)
        s = h[at]
        for k in range(1, n):
            s = mix(s * U(_MULTIPLIER) + h[at + k])
        owner = doc[at]
    else:
        s, owner = np.zeros(0, U), np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < n))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(n_words)))
        more = []
        for d in short:
            x = h[begin[d] : begin[d] + 1].copy()
            for k in range(1, n_words[d]):
                x = mix(x * U(_MULTIPLIER) + h[begin[d] + k : begin[d] + k + 1])
            more.append(mix(x + U(int(n_words[d]))))
        s, owner = np.concatenate([s, *more]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        s, owner = s[order], owner[order]
    size = np.bincount(owner, minlength=n_docs)
    end = np.cumsum(size)
    for d in np.flatnonzero(size > 1):
        s[end[d] - size[d] : end[d]].sort()
    if len(s):
        new = np.empty(len(s), bool)
        new[0] = True
        new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
        s, owner = s[new], owner[new]
    return s, np.bincount(owner, minlength=n_docs)


def per_text(reduce: np.ufunc, values: np.ndarray, sizes: np.ndarray, empty) -> np.ndarray:
    """`reduce` over each text's stretch of `values`; `empty` where a text has none."""
    out = np.full(len(sizes), empty, values.dtype)
    full = sizes > 0
    if len(values):
        out[full] = reduce.reduceat(values, (np.cumsum(sizes) - sizes)[full])
    return out
