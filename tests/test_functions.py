from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.errors import UsageError
from lodestone.functions import text as tx
from lodestone.functions.ranking import parse_agg
from lodestone.functions.vectors import get_embedder, hashed_words


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def scores(spark, spec, values):
    return one(spark, parse_agg(spec)(F.sort_array(F.array(*[F.lit(v) for v in values]), asc=False)))


@pytest.mark.parametrize(
    "spec, values, want",
    [
        ("max", [0.2, 0.9, 0.5], 0.9),
        ("topk:2", [0.2, 0.9, 0.5], 0.7),
        ("topk:3", [0.4], 0.4),
        ("topk", [1.0, 1.0, 1.0, 0.0], 1.0),
        ("decay", [0.2, 0.8, 0.4], 1.05),
        ("count:0.5", [0.9, 0.5, 0.1], 2.0),
        ("count", [0.9, 0.4], 1.0),
    ],
)
def test_strategies(spark, spec, values, want):
    assert scores(spark, spec, values) == pytest.approx(want)


def test_softmax_lies_between_mean_and_max(spark):
    assert 0.5 < scores(spark, "softmax:0.1", [0.9, 0.5, 0.1]) < 0.9
    assert scores(spark, "softmax", [0.3]) == pytest.approx(0.3)


@pytest.mark.parametrize("spec", ["nope", "max:3", "topk:0", "topk:x", "softmax:0", "decay:1", "count:y"])
def test_bad_strategies(spec):
    with pytest.raises(UsageError):
        parse_agg(spec)


def test_fold(spark):
    assert one(spark, tx.fold(F.lit("  Jörg  ﬁn É "))) == "jorg fin e"
    assert one(spark, tx.fold(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("anchor, want", [("brown", 6), ("BROWN", 6), ("absent", -1), ("", -1)])
def test_locate(spark, anchor, want):
    assert one(spark, tx.locate(F.lit(anchor), F.lit("quick brown fox"))) == want


def test_query_terms_keep_repeats_and_drop_single_letters(spark):
    assert one(spark, tx.query_terms(F.lit('a "Über" OR uber-x NEAR(2)'))) == ["uber", "or", "uber", "near"]


def test_names(spark):
    assert one(spark, tx.flip_name(F.lit("Ada King Lovelace"))) == "Lovelace, Ada King"
    assert one(spark, tx.flip_name(F.lit("Lovelace, Ada"))) == "Lovelace, Ada"
    given = lambda n: tx.given_words(F.lit(n))
    agree = lambda a, b: one(spark, tx.given_compatible(given(a), given(b)))
    assert agree("king, a. b.", "king, ada") and agree("king, ada", "king") and not agree("king, ada", "king, bea")


def test_year_clamp_scrub(spark):
    assert one(spark, tx.year_of(F.lit("spring 1999, 2004"))) == "1999"
    assert one(spark, tx.year_of(F.lit("12345"))) is None
    assert [one(spark, tx.clamp(F.lit(v))) for v in ("0.4", "7", "-1", "x")] == [0.4, 1.0, 0.0, 0.0]
    assert one(spark, tx.scrub(F.lit(" a\t\nb "))) == "a b"


def test_vocabulary_lines():
    assert tx.strip_variants("mocvd  # = metal vapour (old), movpe") == ("mocvd", ["metal vapour", "movpe"])
    assert tx.strip_variants("plain") == ("plain", []) and tx.strip_variants("# comment") is None


def test_hashed_words(spark):
    vector = one(spark, hashed_words(F.lit("red red blue")))
    assert len(vector) == 32 and sum(v * v for v in vector) == pytest.approx(1.0)
    assert set(one(spark, hashed_words(F.lit("")))) == {0.0}
    with pytest.raises(UsageError):
        get_embedder("absent")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=1, max_size=6))
def test_strategies_ignore_order(spark, values):
    for spec in ("max", "topk:2", "decay"):
        assert scores(spark, spec, values) == pytest.approx(scores(spark, spec, values[::-1]), abs=1e-9)
