"""Vector arithmetic on arrays, and the embedder registry."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import UsageError
from lodestone.functions.text import ascii_joined, slices, unless_ascii


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Inner product over the product of the lengths, which counts as 1e-12 at least."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def to_float32(a: Column) -> Column:
    return a.cast("array<float>")


def hashed_words(text: Column, dim: int = 32) -> Column:
    """A deterministic embedding: words counted by the first byte of their SHA-256 modulo dim, brought to unit length; zeros without words.

    Spark splits the text; the words of some texts are counted together by an Arrow function, each different one hashed once.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def counted(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([_counts(part, dim) for part in slices(texts)])

    return counted(unless_ascii(text, F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")))


def _counts(texts: pa.Array, dim: int) -> pa.Array:
    lists = pc.split_pattern(ascii_joined(pa.concat_arrays([pc.fill_null(texts, "")]), b"_"), " ")
    words = pc.list_flatten(lists)
    full = pc.greater(pc.binary_length(words), 0)
    row = pc.list_parent_indices(lists).filter(full).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.filter(full).dictionary_encode()
    slot = np.fromiter((sha256(w.encode()).digest()[0] % dim for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    counts = np.bincount(row * dim + slot[coded.indices.to_numpy(zero_copy_only=False)], minlength=len(texts) * dim).reshape(-1, dim).astype(np.float64)
    counts /= np.maximum(np.sqrt((counts * counts).sum(1, keepdims=True)), 1.0)  # a word makes it 1 at least
    return pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, dim, dtype=np.int32)), pa.array(counts.reshape(-1)))


_EMBEDDERS: dict[str, Callable[[str], Callable[[Column], Column]]] = {"hashed-words": lambda model: hashed_words}


def register_embedder(name: str, factory: Callable[[str], Callable[[Column], Column]]) -> None:
    """factory(model) returns a function from a text column to an array<double> column (built-in or a pandas UDF)."""
    _EMBEDDERS[name] = factory


def get_embedder(name: str, model: str = "") -> Callable[[Column], Column]:
    if name not in _EMBEDDERS:
        raise UsageError(f"no embedder {name!r}; there are {', '.join(sorted(_EMBEDDERS))}")
    return _EMBEDDERS[name](model)
