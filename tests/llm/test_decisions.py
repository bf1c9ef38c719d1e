"""Counts against brute force, the learner on rows with known rules, and Spark conditions against the rules themselves."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decisions as dc
from lodestone.llm.queries import op11_learned_quality_rules


def counted(text):
    raw = (text or "").encode()
    words = [w.decode() for w in raw.split()]
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))


def fails(c):
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


def texts():
    rng = random.Random(3)
    out = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\nx\n\nx \n y\n", "#$%&|<> ** é", "a\x1cb c a\x1cb c a\x1cb c", "line\r\nline\r\nline\n", "\n".join(["same old line"] * 4)]
    for _ in range(80):
        words = [rng.choice("ab") for _ in range(rng.randint(0, 30))]
        out.append("".join(w + rng.choice([" ", "\n", "  ", "\r\n", "\t"]) for w in words))
    return [*out, " ".join(str(i % 977) for i in range(60_000))]


def test_counts_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, i, "r") for i, t in enumerate(texts())], "doc_id long, text string, n_words int, row string")
    got = {r.doc_id: tuple(r[c] for c in dc.COUNTS) for r in dc.statistics(docs.repartition(2)).collect()}
    assert got == {i: counted(t) for i, t in enumerate(texts())}
    assert dc.statistics(docs).columns == ["doc_id", "row", *dc.COUNTS, *dc.FEATURES]


def test_features(spark):
    text = "The CAT sat 12 times.\nno end\nextraordinarily, (so) a** a**"
    r = dc.statistics(spark.createDataFrame([(text,)], "text string")).first()
    want = {"words": 11, "word_length": 48 / 11, "symbols_per_word": 4 / 11, "marks_per_word": 4 / 11, "dup_line_share": 0, "repeat_share": 0, "distinct_share": 10 / 11, "top_word_share": 2 / 11, "words_per_line": 11 / 3, "capital_share": 4 / 48, "digit_share": 2 / 48, "short_word_share": 8 / 11, "long_word_share": 1 / 11, "sentence_line_share": 1 / 3}
    assert {f: r[f] for f in dc.FEATURES} == pytest.approx(want)


def made(n, seed=0, noise=0.0):
    """Bad is (symbols high and words few) or digits high."""
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(dc.FEATURES)))
    s, w, d = (dc.FEATURES.index(f) for f in ("symbols_per_word", "words", "digit_share"))
    bad = (x[:, s] > 0.6) & (x[:, w] < 0.4) | (x[:, d] > 0.9)
    return x, bad ^ (rng.random(n) < noise)


def test_learned_rules_are_those_of_the_rows():
    x, bad = made(3000)
    rules = dc.learn(x, bad)
    fresh, truth = made(3000, seed=1)
    said = np.logical_or.reduce([dc.covers(r, fresh) for r in rules])
    assert (said == truth).mean() > 0.985
    assert {c.feature for r in rules for c in r} >= {"symbols_per_word", "words", "digit_share"} and len(rules) <= 5
    assert rules == dc.learn(x, bad)


def test_noise_is_pruned_and_good_rows_are_left_alone():
    x, bad = made(4000, noise=0.03)
    rules = dc.learn(x, bad)
    fresh, truth = made(4000, seed=1)
    said = np.logical_or.reduce([dc.covers(r, fresh) for r in rules])
    assert truth[said].mean() > 0.9 and said[truth].mean() > 0.8 and sum(map(len, rules)) <= 16
    chance = np.random.default_rng(5).random(2000) < 0.1  # labels that no statistic explains
    assert dc.learn(np.random.default_rng(6).random((2000, len(dc.FEATURES))), chance) == []


def test_growing_and_pruning_against_brute_force():
    x, bad = made(300, noise=0.05)
    one = dc._best(x, bad)

    def gain(c):
        inside = c.holds(x)
        p, size = bad[inside].sum(), inside.sum()
        return p * (np.log2(p / size) - np.log2(bad.mean())) if p else 0

    cuts = [dc.Condition(f, above, float(v)) for j, f in enumerate(dc.FEATURES) for v in x[:, j] for above in (True, False)]
    assert gain(one) == pytest.approx(max(map(gain, cuts)))
    rule = dc.grow(x, bad, dc.RuleTraining(conditions=4))
    worth = [2 * bad[dc.covers(rule[:n], x)].mean() - 1 for n in range(1, len(rule) + 1)]
    assert len(dc.prune(rule, x, bad)) == int(np.argmax(worth)) + 1
    assert dc.learn(x, np.zeros(300, bool)) == [] and dc.learn(x[:0], bad[:0]) == [] and isinstance(dc.learn(x, np.ones(300, bool)), list)


def test_ties_and_equal_rows():
    x = np.ones((40, len(dc.FEATURES)))
    assert dc.learn(x, np.arange(40) % 2 == 0) == []  # nothing tells them apart
    x[:20] = 0
    first = dc._best(x, np.arange(40) < 20)
    assert first == dc.Condition(dc.FEATURES[0], False, 0.5)


def test_spark_conditions_are_the_rules(spark):
    x, bad = made(500)
    rules = dc.learn(*made(3000))
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], ["i", *dc.FEATURES])
    got = [r.rule for r in rows.select("i", dc.DecisionList(rules).fired().alias("rule")).orderBy("i").collect()]
    want = [next((n for n, r in enumerate(rules, 1) if dc.covers(r, x[i : i + 1])[0]), None) for i in range(len(x))]
    assert got == want and len(set(want)) > 2
    assert str(dc.DecisionList(rules)).count("drop if") == len(rules) and "<=" in str(dc.DecisionList(rules))


@pytest.fixture(scope="module")
def junk(spark, tmp_path_factory):
    """Good prose, texts full of symbols, and fragments in capitals; every seventh row has no label."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["an", "er", "the", "on", "in"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(600):
        words = [word() for _ in range(rng.randint(55, 120))]
        kind = i % 6
        if kind == 0:
            words = [w + rng.choice(["###", "%%", "$"]) for w in words]
        elif kind == 1:
            words = [w.upper() for w in words]
        elif kind == 2 and i % 4 == 0:
            words = words[:20]
        rows.append((i, " ".join(words), kind))
    folder = tmp_path_factory.mktemp("junk")
    spark.createDataFrame([(i, t, "en", "s", 7) for i, t, _ in rows], "doc_id long, text string, lang string, source string, kept int").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(k > 1), 0) for i, _, k in rows if i % 7], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_op11_drops_junk_and_keeps_prose(spark, junk):
    folder, rows = junk
    got = {r.doc_id: r for r in op11_learned_quality_rules(spark, folder).collect()}
    assert set(got) == {i for i, *_ in rows}
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rules = dc.fit(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    features = {r.doc_id: np.array([[r[f] for f in dc.FEATURES]]) for r in dc.statistics(docs).collect()}
    for i, text, kind in rows:
        r, c = got[i], counted(text)
        assert tuple(r[n] for n in dc.COUNTS) == c and r.base_failed == fails(c)
        verdict = not any(dc.covers(rule, features[i])[0] for rule in rules.rules)
        assert r.kept == (not fails(c) and verdict)
        if r.held_out and not fails(c):
            assert r.kept == (kind > 1)


def test_op11_over_awkward_and_empty_tables(spark, sf, rows, empty):
    got = {r.doc_id: r for r in op11_learned_quality_rules(spark, sf).collect()}
    assert {d: tuple(r[c] for c in dc.COUNTS) for d, r in got.items()} == {r[0]: counted(r[1]) for r in rows}
    assert all(got[r[0]].base_failed == fails(counted(r[1])) and not (got[r[0]].base_failed and got[r[0]].kept) for r in rows)
    assert op11_learned_quality_rules(spark, empty).collect() == []


def test_labels_of_one_kind_and_dotted_names(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(60))) for i in range(30)], "`doc.id` long, `a text` string")
    labels = spark.createDataFrame([(i, 1 if i else None) for i in range(30)], "`doc.id` long, `is.good` int")
    rules = dc.fit(docs, labels, id_col="doc.id", text_col="a text", label_col="is.good")
    assert rules.rules == [] and dc.judge(docs, rules, text_col="a text").where("kept").count() == 30
