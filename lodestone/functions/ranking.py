"""Strategies that turn the scores of a document's chunks into one score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.errors import UsageError


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _number(name: str, param: str, default: float, whole: bool = False) -> float:
    try:
        return (int if whole else float)(param) if param else default
    except ValueError:
        raise UsageError(f"{name} needs a number, not {param!r}") from None


def parse_agg(spec: str) -> Callable[[Column], Column]:
    """`max`, `topk[:k]`, `softmax[:temperature]`, `decay` or `count[:threshold]` as a function of the scores in descending order."""
    name, _, param = spec.partition(":")
    if name in ("max", "decay") and param:
        raise UsageError(f"{name} takes no parameter")
    if name == "max":
        return lambda s: F.get(s, F.lit(0))
    if name == "topk":
        k = int(_number(name, param, 3, whole=True))
        if k < 1:
            raise UsageError("topk needs at least 1")
        return lambda s: _sum(F.slice(s, 1, k)) / F.least(F.size(s), F.lit(k))
    if name == "softmax":
        t = _number(name, param, 0.05)
        if t <= 0:
            raise UsageError("softmax needs a temperature above 0")
        weight = lambda s, v: F.exp((v - F.get(s, F.lit(0))) / t)
        return lambda s: _sum(F.transform(s, lambda v: v * weight(s, v))) / _sum(F.transform(s, lambda v: weight(s, v)))
    if name == "decay":
        return lambda s: _sum(F.transform(s, lambda v, i: v / F.pow(F.lit(2.0), i)))
    if name == "count":
        at = _number(name, param, 0.5)
        return lambda s: F.size(F.filter(s, lambda v: v >= at)).cast("double")
    raise UsageError(f"no strategy {name!r}; there are max, topk, softmax, decay and count")
