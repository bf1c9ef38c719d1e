"""Embedders that call a model: texts go to it in full batches, equal ones once, and its answers are checked."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.errors import EnvironmentFailure

Model = Callable[[list[str]], Sequence[Sequence[float]]]
#: Vectors that a task keeps at hand; beyond these it starts anew.
CACHE = 20_000


def checked(model: Model, texts: list[str], dim: int | None, tries: int) -> list[list[float]]:
    """The model's vectors of texts, one for each, all finite and of one dimension (dim, if it is known).

    A call that fails is made again, `tries` times in all.  An answer that doesn't fit is not asked for again: a model
    that gives too few, empty or differing vectors is no embedding model.
    """
    for left in reversed(range(tries)):
        try:
            vectors = [[float(x) for x in v] for v in model(texts)]
            break
        except EnvironmentFailure:
            raise
        except Exception as e:  # noqa: BLE001  whatever a plug-in raises
            if not left:
                raise EnvironmentFailure(f"the embedding model failed: {type(e).__name__}: {e}") from e
    if len(vectors) != len(texts):
        raise EnvironmentFailure(f"the model gave {len(vectors)} vectors for {len(texts)} texts")
    for v in vectors:
        if not v:
            raise EnvironmentFailure("the model gave an empty vector")
        if len(v) != (dim or len(vectors[0])):
            raise EnvironmentFailure(f"the model's vectors have {len(v)} and {dim or len(vectors[0])} dimensions")
        if not all(map(math.isfinite, v)):
            raise EnvironmentFailure("the model gave a vector with a component that is no number")
    return vectors


def embedded(batches: Iterator[pd.Series], model: Model, size: int, tries: int) -> Iterator[pd.Series]:
    """A series of vectors for each series of texts, in order; calls take `size` texts, whatever series these are of.

    Null stays null.  A series waits until all its texts are known; only the last call of a task may be smaller.
    """
    known: dict[str, list[float]] = {}
    waiting: dict[str, None] = {}  # distinct texts without a vector, in order
    pending: deque[tuple[pd.Series, int]] = deque()  # series with the number of texts asked for until they are known
    asked = answered = 0
    dim = None

    def call(n: int) -> None:
        nonlocal dim, answered
        texts = list(waiting)[:n]
        vectors = checked(model, texts, dim, tries)
        dim = len(vectors[0])
        for text, vector in zip(texts, vectors, strict=True):
            known[text] = vector
            del waiting[text]
        answered += len(texts)

    def ready() -> Iterator[pd.Series]:
        while pending and pending[0][1] <= answered:
            series, _ = pending.popleft()
            yield pd.Series([None if t is None else known[t] for t in series], dtype=object)
        if not pending and len(known) > CACHE:
            known.clear()

    for batch in batches:
        texts = batch.astype(object).where(batch.notna(), None)
        for text in texts:
            if text is not None and text not in known and text not in waiting:
                waiting[text] = None
                asked += 1
        pending.append((texts, asked))
        while len(waiting) >= size:
            call(size)
        yield from ready()
    if waiting:
        call(len(waiting))
    yield from ready()


def model_embedder(model: Model, size: int = 32, tries: int = 2) -> Callable[[Column], Column]:
    """An embedder, as register_embedder() takes one, of a function from a list of texts to a list of vectors.

    A task calls the model with `size` distinct texts at a time across its batches of rows, and once for texts that
    are equal (while it keeps them: CACHE vectors).  An answer that doesn't fit ends the job with EnvironmentFailure.
    """

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return embedded(batches, model, size, tries)

    return embed
