"""The likeness of texts is difflib's."""

from __future__ import annotations

import difflib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions.likeness import fidelity, likeness, longest_common, matching

short = st.text("abä ", max_size=40)


@settings(max_examples=400, deadline=None)
@given(short, short)
def test_equals_difflib(a, b):
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    block = m.find_longest_match()
    assert longest_common(a, b) == (block.a, block.b, block.size)
    assert likeness(a, b) == m.ratio()


def test_long_texts_and_edges(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghij ") for _ in range(60_000))
    places = sorted(rng.sample(range(60_000), 30))
    edited = "".join(text[a:b] + "#" for a, b in zip([0, *places], [*places, 60_000], strict=True))
    assert matching(text, edited) == 60_000  # difflib would compare 300 million pairs
    assert likeness("", None) == 1.0 and likeness("a", "") == 0.0 and likeness("a" * 50, "a" * 70, 50) == 1.0
    rows = spark.createDataFrame([("abc def", "abc xdef"), (None, "x"), (None, None)], "a string, b string")
    assert [r[0] for r in rows.select(fidelity(F.col("a"), F.col("b"))).collect()] == [0.9333, 0.0, 1.0]
