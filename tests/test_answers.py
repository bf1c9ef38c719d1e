"""Structured answers: what fits, what doesn't, and what is asked again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.errors import UsageError
from lodestone.functions.answers import TYPES, answer_type, ask, json_schema, parsed

CASES = [
    ("outline", '{"sections": [{"title": "a", "ideas": [{"first_words": "x y"}]}]}', True),
    ("outline", '{"sections": [{"title": "a", "context": "c", "ideas": []}]}', True),
    ("outline", '{"sections": [{"title": "a"}]}', False),
    ("outline", '{"sections": [{"title": "a", "ideas": [{}]}]}', False),
    ("figures", '{"figures": [{"page": 3, "description": "d"}]}', True),
    ("figures", '{"figures": [{"page": "3", "description": "d"}]}', False),
    ("figures", '{"figures": []}', True),
    ("views", '{"notable": "", "main_ideas": "m", "methods": "", "why_cite": "w"}', True),
    ("views", '{"notable": "", "main_ideas": "m", "methods": ""}', False),
    ("tags", '{"tags": ["a"], "more": 1}', True),
    ("tags", '{"tags": "a"}', False),
    ("tags", '{"tags": [null]}', False),
    ("tags", '{"tags": ["a"', False),
    ("tags", '[{"tags": ["a"]}]', False),
    ("tags", "", False),
    ("tags", None, False),
    ("doc_type", '{"doc_type": "note"}', True),
    ("choice", " \n{\"choice\": \"NEW\"} ", True),
    ("choice", "null", False),
    ("query", '{"semantic_query": "q", "tags": [{"name": "t", "weight": 1}], "authors": [], "doc_types": [], "year_from": 0, "year_to": 0}', True),
    ("query", '{"semantic_query": "q"}', False),
    ("ranking", '{"ranking": [1, 0]}', True),
    ("ranking", '{"ranking": [1.5]}', False),
]


@pytest.mark.parametrize("kind", TYPES)
def test_answers_that_fit(spark, kind):
    cases = [(raw, fits) for k, raw, fits in CASES if k == kind]
    rows = spark.createDataFrame(cases, "raw string, fits boolean").select("raw", "fits", parsed(F.col("raw"), kind).alias("a"))
    assert [(r.raw, r.a is not None) for r in rows.collect()] == cases
    assert rows.schema["a"].dataType.simpleString() == answer_type(kind).simpleString()


def test_choices_and_schema(spark):
    raw = spark.createDataFrame([('{"choice": "a"}',), ('{"choice": "c"}',)], "raw string")
    assert [r[0] for r in raw.select(parsed(F.col("raw"), "choice", ["a", "b"]).isNotNull()).collect()] == [True, False]
    assert json_schema("choice", ["a", "b"])["properties"] == {"choice": {"type": "string", "enum": ["a", "b"]}}
    section = json_schema("outline")["properties"]["sections"]["items"]
    assert section["required"] == ["title", "ideas"] and section["properties"]["ideas"]["items"]["required"] == ["first_words"]
    assert json_schema("figures")["properties"]["figures"]["items"]["properties"]["page"] == {"type": "integer"}
    with pytest.raises(UsageError):
        json_schema("poem")


def test_only_what_does_not_fit_is_asked_again(spark, tmp_path):
    log = tmp_path / "calls"
    log.touch()

    def model(prompt, images, temperature, schema):
        with open(log, "a") as f:
            f.write(f"{prompt} {temperature} {b''.join(images).decode()}\n")
        if prompt == "raise":
            raise RuntimeError("down")
        if prompt == "never" or prompt == "later" and temperature == 0:
            return "{"
        return {"text": '{"ranking": [2, 1]}', "in_tokens": 10, "out_tokens": 6, "generating": 1.5}

    rows = spark.createDataFrame([(1, "good", [b"a", b"b"]), (2, "later", []), (3, "never", None), (4, "raise", None), (5, None, None)], "id long, prompt string, images array<binary>")
    got = {r.id: r for r in ask(rows, ["id"], "ranking", model, F.col("prompt"), F.col("images")).collect()}
    assert sorted(log.read_text().splitlines()) == sorted(["good 0.0 ab", "later 0.0 ", "later 0.3 ", "never 0.0 ", "never 0.3 ", "raise 0.0 "])
    assert {i: (r.answer and r.answer.ranking, r.attempts, r.in_tokens, r.out_tokens, r.tokens_per_second, r.failure) for i, r in got.items()} == {
        1: ([2, 1], 1, 10, 6, 4.0, None),
        2: ([2, 1], 2, 10, 6, 4.0, None),
        3: (None, 2, None, None, None, None),
        4: (None, 1, None, None, None, "RuntimeError: down"),
        5: (None, 0, None, None, None, None),
    }
    assert got[1].seconds >= 0 and got[5].seconds is None
    none = ask(rows.where("false"), ["id"], "ranking", model, F.col("prompt"))
    assert none.count() == 0 and none.schema["answer"].dataType == answer_type("ranking")
