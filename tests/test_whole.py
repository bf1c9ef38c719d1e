"""Queries that take whole tables, against plain Python."""

from __future__ import annotations

import math
import random
import unicodedata
from collections import Counter

import pytest

from lodestone.operators import catalog as cat
from lodestone.plans import catalogue


def test_all_documents_are_folded(spark, tmp_path):
    texts = ["Straße  ﬁn ﬀ №5 ™ ½¼¾ x²³ ªº …", "É" * 3000 + " Ångström", "ΆΣ İstanbul \u1e9e\t\n a\u0301", "한국어 が", "", None]
    rows = [(i, t, None if i % 2 else len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")

    def plain(t):
        return " ".join("".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.combining(c) == 0).lower().split())

    got = {r.doc_id: r.folded for r in catalogue.queries()["fold_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else plain(t) for i, t in enumerate(texts)}
    assert got[0].startswith("straße fin ff no5 tm") and got[1].startswith("e" * 3000)


def angle(a, b):
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / (math.hypot(*a) * math.hypot(*b)), 12)


@pytest.fixture
def embeddings(spark, tmp_path):
    """Ids on both sides of 100 and 200, copies and near copies among them."""
    rng = random.Random(3)
    ids = [*range(80, 260, 9), *range(300, 306)]
    vectors = {i: [rng.gauss(0, 1) for _ in range(4)] for i in ids}
    vectors[302], vectors[305] = vectors[80], [x + 0.05 for x in vectors[89]]
    spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], "vec_id long, embedding array<double>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), vectors


@pytest.mark.parametrize("block", [4096, 7])
def test_every_vector_is_a_term_and_an_entity(spark, embeddings, monkeypatch, block):
    monkeypatch.setattr(cat, "TERM_BLOCK", block)
    sf, vectors = embeddings
    want = {t: sorted((-angle(v, w), f"v{e}") for e, w in vectors.items())[:5] for t, v in vectors.items()}
    got = catalogue.queries()["nearest_entities_all"](spark, sf).collect()
    assert {(r.term, r.rank, r.name) for r in got} == {(f"term {t}", i + 1, n) for t, near in want.items() for i, (_, n) in enumerate(near)} and len(got) == 5 * len(vectors)
    assert all(r.similarity == pytest.approx(-want[int(r.term[5:])][r.rank - 1][0], abs=1e-6) for r in got)
    banded = {r.term: (r.nearest, r.band) for r in catalogue.queries()["tag_banding_all"](spark, sf).collect()}
    assert banded == {f"term {t}": (near[0][1], "auto") for t, near in want.items()}
    assert [(r.band, r.terms, r.occurrences, r.share) for r in catalogue.queries()["band_histogram_all"](spark, sf).collect()] == [("auto", len(vectors), sum(t % 5 + 1 for t in vectors), 1.0)]


def test_vectors_of_other_lengths_and_nulls_take_no_part(spark):
    terms = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", None), ("d", [0.0])], "term string, vec array<double>")
    names = spark.createDataFrame([("y", [2.0, 0.0]), ("x", [3.0, 0.0]), ("z", [0.0, 1.0, 0.0]), ("n", None)], "name string, vec array<double>")
    assert sorted((r.term, r.name, r.similarity, r["rank"]) for r in cat.nearest(terms, names, 2).collect()) == [("a", "x", 1.0, 1), ("a", "y", 1.0, 2), ("b", "z", 0.0, 1)]


def test_every_vector_is_resolved(spark, embeddings):
    sf, vectors = embeddings
    state, want = cat.State("tag"), {}
    for i in sorted(vectors):
        want[i] = state.resolve_term(f"term {i * 3 // 5}", vectors[i])
    got = {r.pos: r.name for r in catalogue.queries()["resolve_terms_all"](spark, sf).collect()}
    assert got == want and got[302] == got[80] and max(Counter(want.values()).values()) > 1


def test_every_id_divisible_by_20_is_asked(spark, tmp_path):
    spark.createDataFrame([(i, [1.0, i * 0.1], 0) for i in range(0, 130, 5)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.queries()["knn_batch20_top5"](spark, str(tmp_path)).collect()
    assert Counter(r.qid for r in got) == dict.fromkeys(range(0, 130, 20), 5) and all(r.chunk_id == r.qid for r in got if r.vec_rank == 1)


def test_the_true_document_holds_the_whole_passage(spark, tmp_path):
    passage = " ".join(f"word{i}" for i in range(30))
    texts = [passage[:60] + " and then something else", "Another opening. " + passage, *(f"filler text {i} of no interest" for i in range(9))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r.grp, r.queries, r.mrr) for r in catalogue.queries()["mrr_eval_whole"](spark, str(tmp_path)).collect()] == [(0, 1, 1.0)]
