"""Vectorised word hashing over Arrow string columns.

Works on the raw UTF-8 buffer of a whole batch: no Python string is made per
word.  A word is a maximal run of bytes other than ASCII white space; ASCII
letters are folded to lower case.  Null counts as the empty text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
SPACE = b" \t\n\r\x0b\x0c"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLDED = _FOLD.astype(np.uint64) + np.uint64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE)] = True
_IS_ALNUM = np.zeros(256, dtype=bool)
_IS_ALNUM[128:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _IS_ALNUM[_c] = True
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLES: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    held = _TABLES.get(int(base))
    if held is None or len(held) < n:
        with np.errstate(over="ignore"):
            out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            out[0] = 1
            held = _TABLES[int(base)] = np.multiply.accumulate(out)
    return held


def powers(n: int) -> np.ndarray:
    """1, b, b**2, ... modulo 2**64, at least n of them."""
    return _powers(_BASE, n)


def inverse_powers(n: int) -> np.ndarray:
    """1, 1/b, 1/b**2, ... modulo 2**64, at least n of them."""
    return _powers(_INVERSE, n)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column: text i is bytes[offsets[i]:offsets[i + 1]]; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) and not pa.types.is_large_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=kind, count=len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


@dataclass
class Words:
    """Words of a batch, in order. start, end: byte range in the batch; hash: 64 bits; first: of text i, words first[i]:first[i + 1]."""

    raw: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def runs(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray, begins: np.ndarray | None = None) -> Words:
    """The runs of bytes that are inside, cut where texts do and where `begins` is set."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n == 0 or not inside.any():
        return Words(raw, offsets, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    edge = np.empty(n, dtype=bool)
    edge[0] = inside[0]
    np.greater(inside[1:], inside[:-1], out=edge[1:])
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    edge[cut] |= inside[cut]
    stop = np.empty(n, dtype=bool)
    stop[-1] = inside[-1]
    np.greater(inside[:-1], inside[1:], out=stop[:-1])
    stop[cut - 1] |= inside[cut - 1]
    if begins is not None:
        more = np.flatnonzero(begins & inside)
        edge[more] = True
        more = more[more > 0]
        stop[more - 1] |= inside[more - 1]
    start, end = np.flatnonzero(edge), np.flatnonzero(stop) + 1
    length = end - start
    with np.errstate(over="ignore"):
        spread = np.zeros(n, np.int64)
        spread[start[1:]] = start[1:] - start[:-1]
        spread[0] = start[0]
        place = np.arange(n) - np.cumsum(spread)  # within its word
        place[~inside] = 0
        np.maximum(place, 0, out=place)
        weighed = powers(int(length.max()) + 1)[place]
        weighed *= _FOLDED[raw]
        weighed[~inside] = 0
        value = np.add.reduceat(weighed, start)
        hashes = mix(value + length.astype(np.uint64) * _BASE)
    return Words(raw, offsets, start, end, hashes, np.searchsorted(start, offsets))


def words(col: pa.Array, alnum: bool = False) -> Words:
    """Tokenise and hash a column. alnum: words are runs of ASCII letters, digits and non-ASCII bytes instead."""
    raw, offsets = buffers(col)
    return runs(raw, offsets, _IS_ALNUM[raw] if alnum else ~_IS_SPACE[raw])


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every n consecutive hashes; shorter by n - 1."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        pw = powers(64 if n < 64 else n)
        for k in range(n):
            out += hashes[k : k + m] * pw[n - k]
    return mix(out)
