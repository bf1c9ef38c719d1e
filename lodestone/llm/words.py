"""Words, lines and characters of batches of texts, by Arrow and numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on together; a longer text is a part of its own.
PART_BYTES = 1 << 20


def parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive slices of a binary array of texts, of about PART_BYTES each; null becomes empty."""
    texts = pc.fill_null(texts, b"")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PART_BYTES, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def _nonempty(lists: pa.Array, keep: pa.Array, values: pa.Array, n: int) -> tuple[pa.Array, np.ndarray]:
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    return values.filter(keep), np.bincount(owner[keep.to_numpy(zero_copy_only=False)], minlength=n)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, words of each text), a word being a run of bytes other than space, tab and the other ASCII blanks."""
    lists = pc.ascii_split_whitespace(texts.view(pa.string()))
    values = pc.list_flatten(lists)
    return _nonempty(lists, pc.greater(pc.binary_length(values), 0), values, len(texts))


def lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all lines that have a word, their number in each text)."""
    lists = pc.split_pattern(texts.view(pa.string()), "\n")
    values = pc.list_flatten(lists)
    return _nonempty(lists, pc.greater(pc.binary_length(pc.ascii_trim_whitespace(values)), 0), values, len(texts))


def codes(values: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """A number for each value, the same for equal values of one text and for no others."""
    owner = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    encoded = values.dictionary_encode()
    key = owner * max(1, len(encoded.dictionary)) + encoded.indices.to_numpy(zero_copy_only=False)
    return np.unique(key, return_inverse=True)[1].reshape(-1)


def totals(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of these sizes."""
    ends = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    return ends[edges[1:]] - ends[edges[:-1]]


def characters(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """For each text and row of a table of 256 flags, the number of its bytes that have the flag."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    data = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
    return np.stack([totals(flags[data], lengths) for flags in table])
