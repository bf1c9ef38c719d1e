from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestone.functions.vectors import hashed_words
from lodestone.operators import documents as do
from lodestone.operators.retrieval import bm25, corpus_size, knn, postings, rrf

TEXTS = ["the cat sat on the mat", "a dog barked at the cat cat", "Über quick brown foxes", "nothing of note here at all", "dog and fox and dog"]


def test_knn_orders_and_breaks_ties_by_id(spark):
    vectors = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (9, None)], "chunk_id long, embedding array<double>")
    got = knn(vectors, spark.createDataFrame([(7, [1.0, 0.0])], "qid long, embedding array<double>"), 2).orderBy("vec_rank").collect()
    assert [(r.chunk_id, r.similarity) for r in got] == [(1, 1.0), (3, 1.0)]
    assert knn(vectors.limit(0), spark.createDataFrame([(7, [1.0, 0.0])], "qid long, embedding array<double>"), 2).count() == 0
    assert knn(vectors, spark.createDataFrame([], "qid long, embedding array<double>"), 2).count() == 0


@pytest.mark.parametrize("query", ["cat dog", "uber", "cat cat mat", "the"])
def test_bm25_equals_an_independent_engine(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(text)")
    db.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", list(enumerate(TEXTS)))
    asked = " OR ".join(f'"{w}"' for w in query.split())
    want = dict(db.execute("SELECT rowid, -bm25(f) FROM f WHERE f MATCH ?", (asked,)).fetchall())
    index = postings(spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id long, text string"))
    got = bm25(index, spark.createDataFrame([(0, query)], "qid long, query string"), 10, *corpus_size(index)).collect()
    assert {r.chunk_id: r.bm25 for r in got} == pytest.approx(want, abs=1e-8)


def test_rrf(spark):
    vec = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "qid long, chunk_id long, vec_rank int")
    fts = spark.createDataFrame([(0, 2, 1), (0, 4, 2)], "qid long, chunk_id long, fts_rank int")
    got = rrf(vec, fts).orderBy("fused_rank").collect()
    assert got[0].chunk_id == 2 and got[0].score == pytest.approx(1 / 62 + 1 / 61)
    assert [r.chunk_id for r in got] == [2, 1, 4, 3]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(
        [(1, "a", "Same Title", {"year": "2001", "creators": "King, Ada"}, "set"), (2, "b", "same  title", {"year": "2001"}, None), (3, "c", "Other", {"year": "2010"}, "review")],
        "document_id long, key string, title string, meta map<string,string>, doc_type string",
    )
    files = spark.createDataFrame([(i, i, f"{k}.txt", "f", "ok") for i, k in ((1, "a"), (2, "b"), (3, "c"))], "file_id long, document_id long, path string, fingerprint string, status string")
    chunks = spark.createDataFrame([(10, 1, 0, "solar cells and panels", "body"), (20, 2, 0, "solar cells and panels too", None), (30, 3, 0, "the MOCVD reactor", "body")], "chunk_id long, file_id long, seq int, text string, kind string")
    tags = spark.createDataFrame([(1, "solar"), (3, "growth")], "document_id long, tag string")
    authors = spark.createDataFrame([(1, "King, Ada", 0)], "document_id long, author string, seq int")
    return do.IndexTables(docs, files, chunks, chunks.select("chunk_id", hashed_words(F.col("text")).alias("embedding")), tags, authors)


def ask(spark, tables, query, **kw):
    queries = spark.createDataFrame([(0, query)], "qid long, query string")
    return do.search(tables, queries, hashed_words, **kw).orderBy("rank").collect()


def test_search_dedups_and_keeps_keys_and_paths(spark, tables):
    got = ask(spark, tables, "solar cells")
    assert got[0].key == "a" and got[0].duplicate_keys == ["b"] and sorted(got[0].paths) == ["a.txt", "b.txt"]
    assert [r.key for r in ask(spark, tables, "solar cells", dedup=False)][:2] == ["a", "b"]
    assert ask(spark, tables, "mocvd")[0].key == "c" and ask(spark, tables, "mocvd")[0].kind == "body"


def test_facet_filters(spark, tables):
    assert [r.key for r in ask(spark, tables, "solar", tags=[["growth", "x"]])] == ["c"]
    assert ask(spark, tables, "solar", tags=[["solar"], ["growth"]]) == []
    assert [r.key for r in ask(spark, tables, "solar", types=["review"], prefilter=True)] == ["c"]
    assert [r.key for r in ask(spark, tables, "solar", authors=[["King, Ada"]])] == ["a"]


def test_facet_multiplier_and_years(spark):
    facet = lambda terms, w, kind: F.struct(F.array(*map(F.lit, terms)).alias("terms"), F.lit(w).alias("weight"), F.lit(kind).alias("kind"))
    none = F.lit(None).cast("array<string>")
    run = lambda facets, tags=none, authors=none, creators="": spark.range(1).select(do.facet_multiplier(F.array(*facets), tags, authors, F.lit(creators), F.lit("book")).alias("m")).first()["m"]
    assert run([facet(["x"], 0.5, "tag"), facet(["y"], 0.5, "author")]) == 0.25
    assert run([facet(["x"], 1.0, "tag")]) == 0.0 and run([facet(["x"], 1.0, "tag")], tags=F.array(F.lit("x"))) == 1.0
    assert run([facet(["king, a"], 0.4, "author")], creators="king, ada") == 1.0
    assert run([facet(["book"], 0.4, "doctype")]) == 1.0
    year = lambda y, a, b: spark.range(1).select(do.year_factor(F.lit(y), F.lit(a).cast("int"), F.lit(b).cast("int")).alias("m")).first()["m"]
    assert (year("1990", 1995, None), year("bad", None, 2000), year("1990", None, None), year("1999", 1995, 2000)) == (0.4, 0.4, 1.0, 1.0)


def test_rerank(spark):
    rows = spark.createDataFrame([(0, i + 1, f"doc{i}", 1.0 - i / 10) for i in range(5)], "qid long, rank int, key string, score double")
    order = spark.createDataFrame([(0, [3, 0, 99, 3, 1])], "qid long, ranking array<int>")
    assert [r.key for r in do.rerank(rows, order).orderBy("rank").collect()] == ["doc0", "doc3", "doc1", "doc2", "doc4"]
    assert [r.score for r in do.rerank(rows.limit(1), order).collect()] == [1.0]
    many = spark.createDataFrame([(0, i + 1, f"doc{i}", 1.0) for i in range(25)], "qid long, rank int, key string, score double")
    got = do.rerank(many, order).orderBy("rank").collect()
    assert [r.key for r in got[20:]] == [f"doc{i}" for i in range(20, 25)] and 0 < got[-1].score < got[-2].score < got[19].score


def test_reranked_hits_are_scored_once(spark):
    """What reranking reads twice is stored: its plan holds no scoring of chunks."""
    from lodestone.plans.catalogue_tables import rerank_fusion

    plan = rerank_fusion(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" not in plan
