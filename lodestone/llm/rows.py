"""Carrying the columns of a caller's table, whatever their names, through an operator."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """The name as it stands in a column expression, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def extended(df: DataFrame, made: str) -> T.StructType:
    """The columns of df and behind them those of a schema string."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(made).fields])


def fresh(name: str, taken: list[str]) -> str:
    """The name, with underscores behind it until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def packed(docs: DataFrame, *without: str) -> Column:
    """One struct `row` of all columns but some; of no column, a struct of a null."""
    rest = [c for c in docs.columns if c not in without]
    return (F.struct(*[column(c) for c in rest]) if rest else F.struct(F.lit(None).cast("int").alias("none"))).alias("row")


def unpacked(names: list[str], **replaced: Column) -> list[Column]:
    """The columns of these names, from the struct `row` but for those replaced."""
    return [(replaced[n] if n in replaced else F.col("row").getField(n)).alias(n) for n in names]


def beside(docs: DataFrame, keep: list[str], source: Column, function: Callable, made: str) -> DataFrame:
    """The columns `keep` of docs and those that a function of batches (row, in) makes of the source: it returns (row, made...)."""
    rows = docs.select(packed(docs, *[c for c in docs.columns if c not in keep]), source.alias("in"))
    out = rows.mapInArrow(function, extended(rows.select("row"), made))
    return out.select(*unpacked(keep), *[F.col(f.name) for f in T.StructType.fromDDL(made).fields])


def trimmed(function: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """The function; when its task ends, the memory that the worker keeps goes back to the system.

    Workers outlive tasks, so what one operator leaves in them would count against the next.
    """

    def run(batches: Iterator[pa.RecordBatch], **parameters) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches, **parameters)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run
