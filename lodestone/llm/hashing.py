"""Vectorised hashing of the words of many texts.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Each word gets a 64-bit value that depends on
its bytes alone: a polynomial over random byte values, taken from prefix sums so that one pass over the bytes
serves all words, then mixed.  Texts are taken in pieces of about PIECE bytes cut at word ends, which bounds
memory however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 18
_GAMMA = U64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits (the splitmix64 finaliser)."""
    x = np.atleast_1d(np.asarray(x, U64))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * _GAMMA) | U64(1)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, PIECE + (PIECE >> 2))
        up, down = np.full(size, _BASE, U64), np.full(size, pow(_BASE, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
    return _powers


def piece_words(data: np.ndarray, cuts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of data; at each of cuts a new text begins."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if lower:
        data = LOWER[data]
    gap = SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = gap[:-1]
    edge[cuts[cuts < len(data)]] = True
    starts = np.flatnonzero(~gap & edge[:-1])
    after = np.ones(len(data), bool)
    after[:-1] = gap[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    after[inner - 1] = True
    ends = np.flatnonzero(~gap & after) + 1
    up, down = _power_tables(len(data) + 1)
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), starts, ends


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a binary column; a null is an empty text."""
    if column.type != pa.large_binary():
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def hashed_texts(column: pa.Array, lower: bool = False, spans: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """(first row, word hashes, word offsets of the rows, starts, ends) for runs of rows; starts and ends count from the run's first byte."""
    data, offsets = texts_of(column)
    row, rows = 0, len(column)
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        base, stop = int(offsets[row]), int(offsets[last])
        found = []
        at = base
        while True:
            end = min(stop, at + 4 * PIECE)
            if end < stop:  # one very long text: cut it after a separator
                back = np.flatnonzero(SPACE[data[at:end]])
                while not len(back) and end < stop:
                    end = min(stop, end + 4 * PIECE)
                    back = np.flatnonzero(SPACE[data[at:end]])
                if end < stop or len(back) and end - at > 4 * PIECE:
                    end = at + int(back[-1]) + 1
            cuts = offsets[row:last] - at
            h, s, e = piece_words(data[at:end], cuts[(cuts >= 0) & (cuts < end - at)], lower)
            found.append((h, s + (at - base), e + (at - base)))
            at = end
            if at >= stop:
                break
        h, s, e = (np.concatenate([f[i] for f in found]) if len(found) > 1 else found[0][i] for i in range(3))
        words = np.searchsorted(s, offsets[row : last + 1] - base)
        yield (row, h, words, s, e) if spans else (row, h, words, None, None)
        row = last


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and their offsets; a text of 1 to k-1 words has one, of all its words."""
    n = np.diff(offsets)
    per = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out_off = np.concatenate([[0], np.cumsum(per)])
    rolled = np.zeros(max(0, len(words) - k + 1), U64)
    for i in range(k):
        rolled += words[i : len(words) - k + 1 + i] * U64(pow(_BASE, i + 1, 1 << 64))
    rolled = mix(rolled + U64(k))
    take = np.repeat(offsets[:-1] - out_off[:-1], per) + np.arange(out_off[-1])
    out = np.zeros(int(out_off[-1]), U64)
    short = (n > 0) & (n < k)
    full = np.repeat(~short, per)
    out[full] = rolled[take[full]]
    for t in np.flatnonzero(short):
        w = words[offsets[t] : offsets[t + 1]]
        factors = np.array([pow(_BASE, i + 1, 1 << 64) for i in range(len(w))], U64)
        out[out_off[t]] = mix((w * factors).sum(dtype=U64) + U64(len(w)))[0]
    return out, out_off


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width words, by prefix sums over the word hashes."""
    count = len(words) - width + 1
    if count <= 0:
        return np.zeros(0, U64)
    up, down = _power_tables(len(words) + 1)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[:count] + U64(width))


def as_long(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed values, for Spark's bigint."""
    return np.ascontiguousarray(x).view(np.int64)
