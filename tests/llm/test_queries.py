"""Each query over a small awkward table against a brute-force version, and over empty tables."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import queries as q  # each query is a name of this module


def table(df, key):
    return {r[key]: r for r in df.collect()}


def test_op1(spark, sf, rows):
    got = table(q.op1_superminhash_near_dedup(spark, sf), "doc_id")
    sets = {}
    for d, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(sets[d]), find(d), find(d) == d) for d in sets}
    assert got[65].component_id == 60 and got[70].component_id == 3


def test_op2(spark, sf, rows):
    got = table(q.op2_winnowing_fingerprints(spark, sf), "doc_id")
    order = sorted(((d, t or "") for d, t, *_ in rows), reverse=True)
    for i, (d, text) in enumerate(order):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + order[(i + 1) % len(order)][1][:cut]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert got[3].fingerprint == got[66].fingerprint and got[0].near_edited > 0.3 > got[0].near_next


def test_op2_edited_marks_equal_marks_from_scratch(spark, sf):
    from pyspark.sql import functions as F

    from lodestone.llm.winnowing import edited_marks, marks

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text").where("text is not null")
    kept = (F.length("text") * 2 / 3).cast("int")
    other = docs.withColumn("e", F.concat(F.substring("text", F.lit(1), kept), F.reverse(F.substring("text", kept + 1, F.length("text")))))
    both = other.select(marks(F.col("e")).alias("a"), edited_marks(marks(F.col("text")), F.col("e"), kept).alias("b"))
    assert both.where("a <> b").count() == 0


def test_op3(spark, sf, rows):
    got = table(q.op3_attention_lm_scoring(spark, sf), "doc_id")
    texts = {d: [*(t or "").encode().lower().split(), None] for d, t, *_ in rows}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    c = Counter(w for d, ws in texts.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in texts.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert r.score < 0


def test_op4(spark, sf, rows):
    import public_tokenizers as p
    import tiktoken

    from lodestone.llm.bpe import decode, encode, read_ranks, vocabulary

    path = p.path("byte_bpe_multi_50k.tiktoken")
    want = tiktoken.Encoding("t", pat_str=p.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    got = table(q.op4_duckdb_byte_bpe(spark, sf), "doc_id")
    for d, t, *_ in rows:
        ids = want.encode_ordinary(t or "")
        assert got[d].n_tokens == len(ids) and got[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    shared = vocabulary(spark, path, p.PATTERN)
    back = decode(encode(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id > 60"), shared), shared)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back.collect())


def test_op5(spark, sf, rows):
    got = table(q.op5_random_indexing_quality(spark, sf), "doc_id")
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    good, bad = ([got[d].score for d in range(60) if (d % 3 == 2) == b] for b in (False, True))  # German is labelled 0 here
    assert np.mean(good) > np.mean(bad) + 0.5
    assert got[3].score == got[66].score


def test_op6(spark, sf, rows):
    got = table(q.op6_debruijn_substring_dedup(spark, sf), "doc_id")
    texts = {d: (t or "").encode().split() for d, t, *_ in rows}
    starts = Counter(tuple(w[i : i + 35]) for w in texts.values() for i in range(len(w) - 34))
    for d, w in texts.items():
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if starts[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest()), d


def test_op7(spark, sf):
    got = defaultdict(list)
    for r in q.op7_additive_quantisation_ann(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 400").collect()]
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    for i, x in rows:
        if i % 20 == 0:
            best = sorted((-round(float(x @ y), 9), j) for j, y in rows if j != i)[:20]
            assert [r.vec_id for r in got[i]] == [j for _, j in best] and [r.rank for r in got[i]] == list(range(1, 21))
            assert all(abs(r.score + s) < 1e-6 for r, (s, _) in zip(got[i], best, strict=True))


def test_op8(spark, sf, rows):
    got = table(q.op8_pareto_source_mixing(spark, sf), "doc_id")
    sizes = {d: len((t or "").encode().split()) for d, t, *_ in rows}
    by = defaultdict(list)
    for d, _, _, s in rows:
        by[s].append(d)
    total = {s: sum(sizes[d] for d in ds) for s, ds in by.items()}
    order = sorted(s for s in total if s is not None) + [None]
    weight = dict(zip(order, [3, 1, 2] * 2, strict=False))
    target, open_, left = {}, set(order), 1.5 * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * total[s] <= level * weight[s]}
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else level * weight[s]
            left -= target[s] if full else 0
        open_ = open_ - full if full else set()
    for s, ds in by.items():
        assert all(got[d].source_size == total[s] and got[d].target == pytest.approx(target[s]) for d in ds)
        assert abs(sum(got[d].taken for d in ds) - target[s]) <= max(sizes[d] for d in ds) + 1e-6
    assert all(r.size == sizes[d] and r.taken in (0, r.size, 2 * r.size) for d, r in got.items())
    assert got == table(q.op8_pareto_source_mixing(spark, sf), "doc_id")


def test_op9(spark, sf, rows):
    got = table(q.op9_feistel_sharding(spark, sf), "doc_id")
    slots = defaultdict(list)
    for d, t, *_ in rows:
        raw = (t or "").encode()
        assert (got[d].size, got[d].text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        slots[got[d].shard].append(got[d].slot)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and set(slots) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("n", [1, 2, 3, 7, 90, 1000])
def test_feistel_is_a_permutation(spark, n):
    from pyspark.sql import functions as F

    from lodestone.llm.sharding import feistel

    assert sorted(r[0] for r in spark.range(n).select(feistel(F.col("id"), n)).collect()) == list(range(n))


def test_op10(spark, sf, rows):
    got = table(q.op10_word_backoff_language_id(spark, sf), "doc_id")
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (76, 77, 78, 80))
    assert all(got[d].lang_pred == lang for d, _, lang, _ in rows if d < 60)
    assert all(0 <= r.score <= 1 for r in got.values())


@pytest.mark.parametrize("name", [f.__name__ for f in q.QUERIES])
def test_empty_tables(spark, empty, name):
    assert q.queries()[name](spark, empty).count() == 0


def test_superminhash_estimates_similarity():
    from lodestone.llm.minhash import superminhash

    rng = np.random.default_rng(1)
    sizes, got = (3, 40, 2000), []
    for n in sizes:
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[: n * 3 // 4], rng.integers(0, 2**63, n - n * 3 // 4, dtype=np.uint64)])
        s = superminhash(np.concatenate([a, b, a]), np.repeat([0, 1, 2], n), 3, 128)
        assert (s[0] == s[2]).all() and (s != np.uint64(2**64 - 1)).all()
        got.append(abs((s[0] == s[1]).mean() - (n * 3 // 4) / (2 * n - n * 3 // 4)))
    assert max(got) < 0.13
