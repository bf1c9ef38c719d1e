"""Structured answers of a language model as columns: types, checks, and calls with a second attempt for what didn't fit.

A model is an injected function; an answer is JSON text that Spark parses by one of the types below.  An answer that is
no JSON, lacks a field or has one of another type is no answer (null), and its row alone is asked again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import EnvironmentFailure, UsageError
from lodestone.plans.materialize import cut, release

#: model(prompt, images, temperature, json_schema) returns the text, or {text, in_tokens, out_tokens, generating} with seconds.
Model = Callable[[str, list[bytes], float, dict], Any]
#: The temperatures of the first and the second attempt, and the names of the views.
TEMPERATURES = (0.0, 0.3)
VIEWS = ("notable", "main_ideas", "methods", "why_cite")

_WEIGHED = "array<struct<name: string, weight: double>>"
# The fields of the answers.
TYPES = {
    "outline": "sections array<struct<title: string, context: string, ideas: array<struct<first_words: string>>>>",
    "figures": "figures array<struct<page: int, description: string>>",
    "views": ", ".join(f"{v} string" for v in VIEWS),
    "tags": "tags array<string>",
    "doc_type": "doc_type string",
    "choice": "choice string",
    "query": f"semantic_query string, tags {_WEIGHED}, authors {_WEIGHED}, doc_types {_WEIGHED}, year_from int, year_to int",
    "ranking": "ranking array<int>",
}
#: Fields that an answer may leave out.
OPTIONAL = frozenset({"context"})
_BAD = "__unfit"


def answer_type(kind: str) -> T.StructType:
    if kind not in TYPES:
        raise UsageError(f"no answer {kind!r}; there are {', '.join(TYPES)}")
    return T.StructType.fromDDL(TYPES[kind])


def json_schema(kind: str, choices: list[str] | None = None) -> dict:
    """The JSON schema of an answer, for models that write by one; choices are the values that a string field may have."""

    def of(t: T.DataType, top: bool = False) -> dict:
        if isinstance(t, T.StructType):
            fields = {f.name: of(f.dataType) | ({"enum": choices} if top and choices and f.dataType == T.StringType() else {}) for f in t}
            return {"type": "object", "properties": fields, "required": [f for f in fields if f not in OPTIONAL]}
        if isinstance(t, T.ArrayType):
            return {"type": "array", "items": of(t.elementType)}
        return {"type": {"string": "string", "int": "integer", "double": "number"}[t.simpleString()]}

    return of(answer_type(kind), top=True)


def _complete(value: Column, t: T.DataType) -> Column:
    """Whether all fields that must be there are there, in all elements."""
    if isinstance(t, T.StructType):
        parts = [_complete(value[f.name], f.dataType) for f in t if f.name not in OPTIONAL]
        return reduce(lambda a, b: a & b, parts, value.isNotNull())
    if isinstance(t, T.ArrayType):
        return value.isNotNull() & F.forall(value, lambda x: _complete(x, t.elementType))
    return value.isNotNull()


def parsed(raw: Column, kind: str, choices: list[str] | None = None) -> Column:
    """The answer in a text as a struct; null if the text is no JSON object or doesn't fit, or names none of the choices."""
    t = answer_type(kind)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    read = F.from_json(raw, T.StructType([*t.fields, T.StructField(_BAD, T.StringType())]), options)
    fits = raw.rlike(r"(?s)^\s*\{.*\}\s*$") & read[_BAD].isNull() & _complete(read, t)
    if choices is not None:
        fits = fits & read[t.fields[0].name].isin(choices)
    return F.when(fits, F.struct(*[read[f.name].alias(f.name) for f in t]))


def _caller(model: Model, temperature: float, schema: dict) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("text string, seconds double, in_tokens long, out_tokens long, generating double, failure string")
    def call(prompts: pd.Series, images: pd.Series) -> pd.DataFrame:
        rows = []
        for prompt, pictures in zip(prompts, images, strict=True):
            begun, reply, failure = time.monotonic(), None, None
            try:
                reply = model(prompt, [bytes(p) for p in pictures if p is not None] if pictures is not None else [], temperature, schema)
            except EnvironmentFailure:
                raise
            except Exception as e:  # noqa: BLE001  the row is reported as failed, the others go on
                failure = f"{type(e).__name__}: {e}"[:500]
            seconds = time.monotonic() - begun
            told = reply if isinstance(reply, dict) else {"text": reply}
            text = told.get("text")
            rows.append((text if text is None or isinstance(text, str) else json.dumps(text), seconds, told.get("in_tokens"), told.get("out_tokens"), told.get("generating"), failure))
        out = pd.DataFrame(rows, columns=["text", "seconds", "in_tokens", "out_tokens", "generating", "failure"])
        return out.astype({"in_tokens": "Int64", "out_tokens": "Int64", "seconds": "float64", "generating": "float64"})

    return call


def ask(
    rows: DataFrame,
    key: list[str],
    kind: str,
    model: Model,
    prompt: Column,
    images: Column | None = None,
    choices: list[str] | None = None,
    temperatures: tuple[float, ...] = TEMPERATURES,
    again: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(key..., answer, attempts, seconds, in_tokens, out_tokens, tokens_per_second, failure) of each row.

    Rows have unique keys without nulls; one with a null prompt isn't asked (no answer, 0 attempts).  A row whose answer
    doesn't fit is asked once for each further temperature; `again` may give such rows, of a table of their keys, where
    making them is dear.  A call that raises has a failure and is not repeated here.  EnvironmentFailure ends the job.
    Seconds and tokens are sums over the attempts, tokens_per_second is that of the last one.  What was answered is
    written before anything reads it, so no model is asked twice but by tasks that were lost; release() the result.
    """
    made: list[DataFrame] = []
    answered: list[DataFrame] = []
    schema = json_schema(kind, choices)
    pictures = F.lit(None).cast("array<binary>") if images is None else images
    todo = rows
    for attempt, temperature in enumerate(temperatures, 1):
        asked = todo.select(*key, prompt.alias("__prompt"), pictures.alias("__images"))
        if attempt == 1:
            silent = asked.where("__prompt is null").select(*key)
        got = asked.where("__prompt is not null").withColumn("__reply", _caller(model, temperature, schema)("__prompt", "__images"))
        got = cut(got.select(*key, F.lit(attempt).alias("attempt"), "__reply.*"), f"answers-{kind}")
        got_parsed = got.withColumn("answer", parsed(F.col("text"), kind, choices)).drop("text")
        made.append(got)
        answered.append(got_parsed)
        unfit = got_parsed.where("answer is null and failure is null").select(*key)
        if attempt == len(temperatures) or unfit.isEmpty():
            break
        todo = (again(unfit) if again else rows).join(unfit, key, "left_semi")
    every = reduce(DataFrame.unionByName, answered)
    last = lambda c: F.max_by(c, "attempt")
    speed = F.when(F.col("generating") > 0, F.round(F.col("out_tokens") / F.col("generating"), 1))
    sums = every.withColumn("speed", speed).groupBy(*key).agg(
        last("answer").alias("answer"), F.max("attempt").alias("attempts"), F.sum("seconds").alias("seconds"), F.sum("in_tokens").alias("in_tokens"),
        F.sum("out_tokens").alias("out_tokens"), last("speed").alias("tokens_per_second"), last("failure").alias("failure"),
    )
    out = cut(sums.unionByName(silent.withColumn("attempts", F.lit(0)), allowMissingColumns=True), f"answered-{kind}")
    release(*made)
    return out
