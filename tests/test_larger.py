"""Queries against their SQL, or against plain Python, on what only larger tables hold: repeated urls, keys that meet, many equal vectors."""

from __future__ import annotations

import tracemalloc
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vectors
from lodestone.functions.nearest import Best, unit
from lodestone.functions.vectors import cosine
from lodestone.operators import catalog as cat
from lodestone.operators import evaluation as ev
from lodestone.operators import passages, retrieval
from lodestone.plans import catalogue
from lodestone.plans.materialize import cut, release


def same_as_sql(spark, folder, name):
    """The rows of a query, equal to those of its SQL over the Parquet folders in `folder`."""
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    cursor = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall(), key=repr)
    got = sorted((tuple(r) for r in catalogue.queries()[name](spark, str(folder)).select(*[f"`{n}`" for n in names]).collect()), key=repr)
    assert got == want
    return got


def test_pages_of_one_url_keep_a_path_each(spark, tmp_path):
    rows = [(1, "u1", "<title>A b</title>"), (2, "u2", "<title>a B </title>"), (3, "u1", "<title>a b</title>"), (4, "u4", "none"), (5, "u5", "<title>c</title>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert ("a b", 1, "2,3", "u1 u2 u1") in same_as_sql(spark, tmp_path, "dedup_title_year")


def test_attachments_whose_ids_are_those_of_orders(spark, tmp_path):
    orders = [(1, 1), (1_000_011, 2), (1_000_012, 3), (1_000_025, 4)]  # 1,000,012 is divisible by 13 and so deleted
    items = [(1, 1, 5, "N"), (1, 4, 6, "N"), (2, 5, 7, "A"), (1, 2, 8, "N")]
    when = "timestamp'1995-01-01' AS o_orderdate"
    spark.createDataFrame([*orders, (1_000_014, 5)], "o_orderkey long, o_custkey long").selectExpr("*", when).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(*items[0], 0), *[(*i, 0) for i in items[1:]], (1, 8, 9, "N", 0)], "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, n int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "c", "BUILDING")], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    assert (1_000_014, 1, "storage/A1000014/f6.pdf") in same_as_sql(spark, tmp_path, "stored_attachments")


class Sent:
    """Stands for a broadcast."""

    def __init__(self, value):
        self.value = value


def vectors_in_batches(rng, n, dim, keys):
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[: n // 4] = x[0]  # a large group of copies
    column = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(x.reshape(-1)))
    return x, [pa.RecordBatch.from_arrays([keys.slice(i, 10_000), column.slice(i, 10_000)], names=["key", "vec"]) for i in range(0, n, 10_000)]


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_best_equals_a_full_sort():
    rng = np.random.default_rng(0)
    x, q = rng.integers(-2, 3, (900, 3)).astype(float), rng.integers(-2, 3, (40, 3)).astype(float)  # many ties
    x[7], q[3] = np.nan, np.nan
    keys = rng.permutation(900)
    for k in (1, 5, 200):
        for kind in (np.int64, str):
            best = Best(q, k)
            for a in range(0, 900, 250):
                best.add(keys[a : a + 250].astype(kind), x[a : a + 250])
            scores, found = best.result()
            products = np.round(q @ x.T, 12)
            for i in range(len(q)):
                want = sorted(((-s if s == s else np.inf), t) for s, t in zip(products[i], keys.astype(kind).tolist(), strict=True))[:k]
                assert [t for _, t in want] == found[i].tolist() and [None if s == np.inf else -s for s, _ in want] == [None if s != s else s for s in scores[i].tolist()]


def test_nearest_searches_hold_few_products_at_once():
    rng = np.random.default_rng(1)
    ids = pa.array(np.arange(20_000))
    x, batches = vectors_in_batches(rng, 20_000, 16, ids)
    q = unit(rng.normal(size=(4096, 16)))
    assert peak_mb(lambda: list(retrieval._top(iter(batches), Sent((np.arange(4096), q)), 5))) < 150
    names = pa.array([f"v{i}" for i in range(20_000)])
    x, batches = vectors_in_batches(rng, 20_000, 16, names)
    assert peak_mb(lambda: list(cat._best(iter(batches), Sent({16: (np.arange(4096).astype(str), q)}), 5))) < 150


def test_pooled_cosines_equal_those_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vector = lambda i: None if i % 11 == 5 else [] if i % 29 == 3 else rng.normal(size=2 + (i % 7 == 0)).tolist()
    queries = spark.createDataFrame([(i, vector(i)) for i in range(20)] + [(20, [0.0, 0.0]), (21, [1.0, None])], "qid long, x array<float>")
    pool = spark.createDataFrame([(None if i % 6 == 0 else f"d{i % 6}", vector(i)) for i in range(60)] + [("none", None), ("null", [None, 1.0])], "document_id string, y array<float>").repartition(3)
    rows = lambda df: {(r.qid, r.document_id): round(r.score, 9) for r in df.collect()}
    same = F.size("x") == F.size("y")
    want = rows(ev.pool_scores(queries, pool, F.when(same, cosine(F.col("x"), F.col("y")))))
    assert rows(ev.pool_cosines(queries, pool)) == want and len(want) == 22 * 8
    monkeypatch.setattr(ev, "POOL_BLOCK", 7)
    assert rows(ev.pool_cosines(queries, pool)) == want


def test_pool_best_makes_no_row_for_each_pair(spark, tmp_path):
    spark.createDataFrame([(i, [1.0, float(i)], i % 3) for i in range(120)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert len(same_as_sql(spark, tmp_path, "pool_best")) == 9
    plan = catalogue.queries()["pool_best"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_resolution_compares_few_entities_and_equals_the_plain_fold(monkeypatch):
    plain = cat._cosine
    for adjudicate in (None, lambda kind, term, names: names[len(term) % len(names)] if len(term) % 3 else None):
        rng = np.random.default_rng(5)
        base = rng.normal(size=(40, 4))
        rows = [(f"Term {rng.integers(0, 900)}" if i % 50 else " ", i, None if i % 37 == 0 else base[i % 40] + rng.normal(size=4) * 0.15) for i in range(1500)]
        state = cat.State("tag")
        want = [state.resolve_term(t, None if v is None else v.tolist(), adjudicate) if t.strip() else None for t, _, v in rows]
        calls = []
        monkeypatch.setattr(cat, "_cosine", lambda a, b: calls.append(1) or plain(a, b))  # noqa: B023
        known = pd.DataFrame(columns=["what", "name_", "other", "number", "vec", "pos"])
        got = cat._fold(("tag",), pd.DataFrame(rows, columns=["term", "pos", "vec"]), known, adjudicate)
        monkeypatch.setattr(cat, "_cosine", plain)
        assert got[got.what == "mention"].name.tolist() == want
        assert {r.name: r.number for r in got[got.what == "entity"].itertuples()} == state.usage
        assert len(calls) < 10 * len(rows)


def test_folding_holds_few_texts_as_strings():
    texts = pa.array([None, "", *(f"É{i} " * 1500 for i in range(6000))])  # 60 MB
    made = []
    assert peak_mb(lambda: made.append(tx.fold.func(texts))) < 30
    assert len(made[0]) == len(texts) and made[0][0].as_py() is None and made[0][5].as_py() == tx.fold_text(texts[5].as_py())
    assert tx.fold.func(pa.array([], pa.string())).to_pylist() == []


def test_equal_words_of_a_batch_are_hashed_once(spark, monkeypatch):
    calls, plain = [], vectors.sha256
    monkeypatch.setattr(vectors, "sha256", lambda w: calls.append(w) or plain(w))
    found = vectors._counts(pa.array(["a b a", None, "", " b "] * 50), 32).to_pylist()
    assert sorted(calls) == [b"a", b"b"] and found[1] == found[2] == [0.0] * 32 and sorted(found[0])[-1] == 2 / 5**0.5
    monkeypatch.undo()
    rows = [(0, None), (1, ""), (2, "A b_c İstanbul ΑΣ ß x\ty z ²³ 한국 éa"), (3, "..."), (4, "the the The")]
    got = {r.i: r.e for r in spark.createDataFrame(rows, "i int, t string").select("i", vectors.hashed_words(F.col("t")).alias("e")).collect()}
    assert got[0] == got[1] == got[3] == [0.0] * 32 and got[4][plain(b"the").digest()[0] % 32] == 1.0 and round(sum(x * x for x in got[2]), 9) == 1


def test_rows_of_some_mb_are_written_and_read_one_by_one(spark):
    made = cut(spark.range(0, 7, 1, 1).withColumn("x", F.repeat(F.lit("a"), 1000)), "large-rows", group_rows=1)
    files = list(Path(made._lodestone_path.removeprefix("file://")).glob("*.parquet"))
    assert made.count() == 7 and [g for f in files for g in range(pq.read_metadata(f).num_row_groups)] == list(range(7))
    release(made)


def test_blocks_of_the_language_model_are_rows_of_their_own(spark, monkeypatch):
    scoring = pytest.importorskip("lodestone.llm.scoring")
    asked = {}
    monkeypatch.setattr(scoring, "cut", lambda df, name, **how: asked.setdefault(name, how) and None or cut(df, name, **how))
    docs = spark.createDataFrame([(i, "a b c", False) for i in range(5)], "doc_id long, text string, held_out boolean")
    ranks = {bytes([i]): i for i in range(256)}
    monkeypatch.setattr(scoring, "read_ranks", lambda path: ranks)
    assert scoring.score_texts(docs, "", r"\S+|\s+").count() == 5 and asked["lm-blocks"]["group_rows"] == 1


def test_a_search_makes_no_row_for_a_pair_of_word_and_query(spark, monkeypatch):
    texts = [(i, f"same {'words ' * (i % 5)}here w{i % 7} É{i % 3}" if i % 11 else None if i % 2 else " ") for i in range(3000)]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string").repartition(4)
    queries = spark.createDataFrame([(q, f"same words here w{q % 9} e{q % 4} e1 absent") for q in range(300)] + [(998, "absent"), (999, None)], "qid long, query string")
    monkeypatch.setattr(retrieval, "SCORED_QUERIES", 64)
    rows, listed = retrieval.postings(chunks), cut(retrieval.listed_postings(chunks), "listed")
    size = retrieval.corpus_size(listed)
    assert size == retrieval.corpus_size(rows)
    plain = {}
    df, mean = rows.groupBy("term").count().rdd.collectAsMap(), size[1] / size[0]
    for r in rows.collect():
        for q in range(300):
            times = f"same words here w{q % 9} e{q % 4} e1".split().count(r.term)
            if times:
                idf = np.log((size[0] - df[r.term] + 0.5) / (df[r.term] + 0.5))
                plain.setdefault(q, Counter())[r.chunk_id] += times * max(idf, 1e-6) * r.tf * 2.2 / (r.tf + 1.2 * (0.25 + 0.75 * r.len / mean))
    want = {(q, n + 1): (c, s) for q, sums in plain.items() for n, (s, c) in enumerate((-s, c) for s, c in sorted((-round(s, 9), c) for c, s in sums.items())[:8])}
    counts = retrieval.frequencies(listed)
    assert counts.rdd.collectAsMap() == df
    for index, known in ((rows, None), (listed, None), (listed, counts), (rows, counts)):
        hits = retrieval.bm25(index, queries, 8, *size, known)
        got = {(r.qid, r.fts_rank): (r.chunk_id, r.bm25) for r in hits.collect()}
        assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-9 for x in got)
    # before, the texts' words were joined with all queries that ask for them
    joins = retrieval.bm25(listed, queries, 8, *size)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in joins and "MapInArrow" in joins
    monkeypatch.setattr(retrieval, "BROADCAST_WEIGHTS", 500)
    again = {(r.qid, r.fts_rank): (r.chunk_id, r.bm25) for r in retrieval.bm25(listed, queries, 8, *size).collect()}
    assert again == got


def test_ascii_texts_are_joined_as_others_are(spark):
    every = "".join(map(chr, range(128)))
    rows = [(0, every), (1, every + "É"), (2, ""), (3, None), (4, "A_b C d ²"), (5, "x" * 9)]
    d = spark.createDataFrame(rows, "chunk_id long, text string")
    want = {r.chunk_id: Counter(r.words) for r in d.select("chunk_id", tx.index_terms(F.col("text")).alias("words")).where("text is not null").collect()}
    got = {i: Counter() for i in want}
    for r in retrieval.postings(d).collect():
        got[r.chunk_id][r.term] += r.tf
    assert got == want
    assert tx.ascii_joined(pa.array(["q", "A_b-C", "é_É"]).slice(1), b"_").to_pylist() == ["a_b c", "é_É"]


@pytest.mark.parametrize("most", [200_000, 0])
def test_passages_are_found_in_one_pass_or_by_a_join(spark, monkeypatch, most):
    monkeypatch.setattr(passages, "BROADCAST_ANCHORS", most)
    docs = [(1, "a red\x0bwhale  sings ünder the sea"), (2, "red whale sings"), (3, None), (4, ""), (5, "x\x1cy red whale sings under the sea"), (6, "and a red whale sings at sea, a red whale sings"), (6, "and a red whale sings at sea, a red whale sings")]
    asked = [(0, "a red\x0bwhale  sings ünd"), (1, "red whale sings"), (2, "d a red whale sings at s"), (3, "a red whale sings at s"), (4, None), (5, ""), (6, "y red whale sings under the sea"), (7, "an absent whale sings at sea"), (8, "whale")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "qid long, passage string")
    want = {(q, i) for q, p in asked for i, t in docs if p and t and p in t}
    found = passages.holders(d, q)
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    plan = passages.holders(d, q.where("qid in (0, 2, 3)"))._jdf.queryExecution().executedPlan().toString()
    assert ("Join" in plan) == (most == 0)  # before, every three words of a text went into a join
