from __future__ import annotations

import numpy as np
import pyarrow as pa

from lodestone.llm import neighbours as nn


def table(spark, ids, x):
    return spark.createDataFrame(pa.table({"vec_id": ids, "embedding": pa.FixedSizeListArray.from_arrays(x.astype(np.float32).reshape(-1), x.shape[1]).cast(pa.list_(pa.float32()))}))


def test_recall_on_many_vectors_with_a_short_list(spark, monkeypatch):
    rng = np.random.default_rng(0)
    n, k = 50_000, 20
    x = rng.normal(size=(200, 32))[rng.integers(0, 200, n)] + 0.5 * rng.normal(size=(n, 32))
    x = x.astype(np.float32).astype(np.float64)
    asked = np.arange(0, n, 250)
    monkeypatch.setattr(nn, "QUERY_ROWS", 64)
    monkeypatch.setattr(nn, "WAVE", 2)
    vectors = table(spark, np.arange(n), x)
    got = nn.nearest(vectors, vectors.where("vec_id % 250 = 0"), k, nn.AdditiveQuantiser(rerank=40)).toPandas().sort_values(["query_id", "rank"])
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    found = {q: set(g.vec_id) for q, g in got.groupby("query_id")}
    recall = np.mean([len(found[q] & set(b)) / k for q, b in zip(asked, best, strict=True)])
    assert recall >= 0.95 and (got.groupby("query_id").size() == k).all()
    assert np.allclose(got.score, (x[got.query_id] * x[got.vec_id]).sum(1), rtol=0, atol=1e-12)


def test_one_group_alone_misses_what_only_codes_rank(spark):
    """Without a margin and with a list of k the codes decide: recall shows that they rank, and that they are inexact."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 16)).astype(np.float32).astype(np.float64)
    q = nn.AdditiveQuantiser(books=4, words=16, rerank=20, errors=0.0)
    books = nn.train(x, q)
    codes = nn.encode(x, books, q.beam)
    left = ((x - nn.decode(codes, books)) ** 2).sum(1)
    assert left.mean() < 0.5 * (x * x).sum(1).mean()
    first = nn.encode(x, books, 1)
    assert left.mean() < ((x - nn.decode(first, books)) ** 2).sum(1).mean()


def test_repeated_ids_ties_and_strange_vectors(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [0.5, 0.5]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nn.nearest(vectors, vectors.where("vec_id = 20"), 2).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(20, 1, 7, 0.5), (20, 2, 1, 0.0)]
    assert nn.nearest(vectors, vectors.where("vec_id = 3"), 2).count() == 0
