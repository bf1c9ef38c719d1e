"""Null and repeated ids, clashing and dotted column names, very long pieces: each with its defined result, compared by value."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, langid, minhash, mixing, quality, queries, sharding, substrings, winnowing

SCHEMA = "doc_id long, text string, lang string, source string, score double, lang_pred string, n_removed int, `a.b` string, `in` int, row string, n_tokens int"
NAMES = ["score", "lang_pred", "n_removed", "a.b", "in", "row"]


def odd_rows():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["an", "er", "the", "on", "in"]) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(50))
    texts = [" ".join(word() for _ in range(rng.randint(40, 90))) for _ in range(12)]
    texts[3] = f"{texts[3]} {passage}"
    texts[4] = f"{passage} {texts[4]}"
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)]
    rows += [(None, "null id here and some words", "en", "s0"), (None, None, None, None), (5, "repeated id with another text", None, "s1")]
    rows += [(7, *rows[7][1:])] * 2 + [(20, "", None, "s1"), (21, "² ½ Ⅷ ④", "en", "s0")]
    return [(*r, 7.5, "mine", 3, f"dotted{i % 12}", i, "r", 1) for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def own(df, *also):
    return sorted((str(r) for r in df.select(*[f"`{n}`" for n in (*NAMES, *also)]).collect()))


def kept_by(rows, keep):
    return [r for r in rows if keep(r)]


def test_language_stage(spark, odd):
    got = cp.language(spark, odd, "")
    want = odd.where(F.col("text").rlike(r"\p{L}"))
    assert got.columns == odd.columns and own(got, "doc_id", "text") == own(want, "doc_id", "text")
    assert got.where("lang is null").count() == 0


def test_near_duplicates_stage(spark, odd):
    got = cp.near_duplicates(spark, odd, "")
    assert got.columns == odd.columns and got.count() == odd.count() - 2  # of three equal rows one stays
    assert got.where("score = 7.5 and lang_pred = 'mine' and `a.b` is not null").count() == got.count()


def test_repeated_passages_stage(spark, odd):
    single = cp.near_duplicates(spark, odd, "").where("doc_id < 12")
    got = cp.repeated_passages(spark, single, "")
    assert got.columns == single.columns and own(got, "doc_id") == own(single, "doc_id")
    before = {r["in"]: r.text for r in single.collect()}
    after = {r["in"]: r.text for r in got.collect()}
    assert {k: len(before[k].split()) - len(after[k].split()) for k in before if before[k] != after[k]} == {3: 50, 4: 50}
    with_null = cp.repeated_passages(spark, odd.where("text is null or text = ''"), "")
    assert sorted(repr(r.text) for r in with_null.collect()) == ["''", "None"]


def test_source_mixture_stage(spark, odd):
    got = cp.source_mixture(spark, odd, "")
    assert got.columns == odd.columns and set(own(got)) <= set(own(odd))
    assert got.groupBy("`in`").count().agg(F.max("count")).first()[0] <= 2
    assert sorted(map(str, got.collect())) == sorted(map(str, cp.source_mixture(spark, odd.repartition(5), "").collect()))


def test_stages_of_an_empty_table(spark, odd):
    none = odd.where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, none, "").count() == 0


def test_sharding_keeps_all_columns(spark, odd):
    got = sharding.shard_rows(odd, 4)
    assert sorted(str(r.row) for r in got.collect()) == sorted(map(str, odd.collect()))


def test_scores_and_encodings_stand_beside_the_columns(spark, odd):
    import public_tokenizers as p

    shared = bpe.vocabulary(spark, p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN)
    coded = bpe.encode(odd, shared, want=("ids",))
    assert coded.columns == [*odd.columns, "ids"] and own(coded, "n_tokens") == own(odd, "n_tokens")
    model = quality.fit(odd, odd.select("doc_id", F.lit(1).alias("quality")), quality.QualityTraining(epochs=1))
    assert quality.score(odd, model).select("`a.b`", "`in`", "row").count() == odd.count()
    named = langid.identify(odd, langid.fit(odd))
    assert sorted(r["lang_pred"] for r in named.where("text is null or not text rlike '\\\\p{L}'").collect()) == ["und"] * 3


def test_equal_rows_are_drawn_one_by_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h", "s")] * 900 + [(2, "x y", "t")] * 300, "doc_id long, text string, source string")
    taken = mixing.mixing_plan(docs).groupBy("src").agg(F.sum(F.col("copies") * F.col("size")).alias("n"), F.first("target").alias("t")).collect()
    assert all(abs(r.n - r.t) <= 8 for r in taken)


def test_inclusion_frequencies_are_in_proportion_to_size(spark):
    rng = random.Random(3)
    sizes = [rng.randint(1, 60) for _ in range(60)] + [900]
    docs = spark.createDataFrame([(i, "w " * n, "s") for i, n in enumerate(sizes)], "doc_id long, text string, source string").repartition(2)
    times, drawn, rounds = np.zeros(len(sizes)), set(), 30
    groups = mixing._groups(docs, "doc_id", "source", "text")
    for seed in range(rounds):
        m = mixing.Mixture(weights=(1,), percent=70, seed=seed)
        rows = mixing._decided(mixing._ranked(mixing._units(groups, m), mixing.cut_offs(groups, m))).select("id", "copies", "p").collect()
        for r in rows:
            times[r.id] += r.copies
        drawn.add(sum(r.copies for r in rows))
    p = np.array([r.p for r in sorted(rows, key=lambda r: r.id)])
    assert len(drawn) == 1 and drawn.pop() == round(p.sum())
    assert p[-1] == 1 and times[-1] == rounds
    error = (times / rounds - p) / np.sqrt(np.maximum(p * (1 - p), 1e-9) / rounds)
    assert abs(error[:-1]).max() < 4.5 and abs(error[:-1].mean()) < 0.5


def test_null_and_repeated_ids_of_the_queries(spark, odd, tmp_path):
    folder = str(tmp_path)
    odd.write.parquet(f"{folder}/documents.parquet")
    odd.select("doc_id", F.lit(1).alias("quality")).write.parquet(f"{folder}/labels.parquet")
    rows = odd_rows()
    for name, query in queries.queries().items():
        if not name.startswith("op7") and name != "pipeline":
            got = query(spark, folder).collect()
            assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows), name


def test_long_pieces_and_many_pieces_are_encoded_as_by_tiktoken():
    import public_tokenizers as p
    import tiktoken

    ranks = bpe.read_ranks(p.path("byte_bpe_multi_50k.tiktoken"))
    want = tiktoken.Encoding("t", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, p.PATTERN)
    rng = random.Random(2)
    letters = lambda n, of: "".join(rng.choices(of, k=n)).encode()
    pieces = [letters(250, "abcdefghijklmnopqrstuvwxyz") for _ in range(1500)]
    pieces += [b"a" * 20_000, b" " * 3001, b"=" * 4097, b"ab" * 700, letters(5000, "etaoinshrdlu"), letters(900, "漢字的一是不了人我"), letters(40_000, "etaoinshrdlu")]
    pieces += ["".join(rng.choice(["a", "aa", "ab", " ", "=", "th"]) * rng.randint(1, 30) for _ in range(30)).encode() for _ in range(40)]
    assert all(len(x) > bpe.SHORT for x in pieces[1500:1505]) and len(pieces[1506]) > bpe.WHOLE
    assert [x.tolist() for x in codec.encode_pieces(pieces)] == [want._core_bpe.encode_single_piece(x) for x in pieces]


def test_winnowing_marks_against_brute_force(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab é") for _ in range(n)) for n in (0, 5, 16, 40, 47, 48, 300, 1000)] + ["a" * 200]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    grams = sorted({t[i : i + winnowing.GRAM] for t in texts for i in range(len(t) - winnowing.GRAM + 1)})
    of = {r.t: r.m[0] >> 31 for r in spark.createDataFrame([(g,) for g in grams], "t string").select("t", winnowing.marks(F.col("t")).alias("m")).collect()}
    for r in rows.select("t", winnowing.marks(F.col("t")).alias("m"), F.transform(winnowing.marks(F.col("t")), winnowing.position).alias("at")).collect():
        h = [of[r.t[i : i + winnowing.GRAM]] for i in range(len(r.t) - winnowing.GRAM + 1)]
        want = set()
        for i in range(max(1, len(h) - winnowing.WINDOW + 1) if h else 0):
            part = h[i : i + winnowing.WINDOW]
            want.add(i + max(j for j, x in enumerate(part) if x == min(part)))
        if h:
            assert sorted(want) == r["at"] and [m >> 31 for m in r.m] == [h[i] for i in r["at"]]
    shared = "".join(rng.choice("xyz ") for _ in range(winnowing.GUARANTEE))
    pair = spark.createDataFrame([("pq" * 40 + shared + "rst" * 9, "uv" * 13 + shared + "w" * 77)], "a string, b string")
    assert pair.select(F.size(F.array_intersect(winnowing.hashes(winnowing.marks(F.col("a"))), winnowing.hashes(winnowing.marks(F.col("b")))))).first()[0] > 0


def test_repeats_are_compared_by_their_words(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text), (2, f"x {text} y"), (3, " ".join(f"v{i}" for i in range(40)))], "doc_id long, text string")
    got = {r.row.doc_id: (r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs).collect()}
    assert got[1] == (80, hashlib.sha256(b"").hexdigest()) and got[2] == (80, hashlib.sha256(b"x y").hexdigest()) and got[3][0] == 0


def test_keep_one_of_rows_with_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g"), (None, None)], "doc_id long, text string")
    assert minhash.keep_one(docs).count() == 2


def test_windows_are_named_by_their_words(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{'same' if 20 <= j < 60 and i < 2 else i}{j}" for j in range(90))) for i in range(6)], "doc_id long, text string")
    want = {0: 40, 1: 40, 2: 0, 3: 0, 4: 0, 5: 0}
    for p in (substrings.Repeats(), substrings.Repeats(paths=False)):
        assert {r.row.doc_id: r.n_removed for r in substrings.remove_repeats(docs, p).collect()} == want
    at = lambda text, starts: substrings._digests(np.frombuffer(text, np.uint8), np.array(starts), np.array(starts) + 1, [(0, 2)])
    assert [x.tolist() for x in at(b"a b  c", [0, 2, 5])] == [x.tolist() for x in at(b"a  b", [0, 3])] != [x.tolist() for x in at(b"a c", [0, 2])]
