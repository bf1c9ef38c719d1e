"""Words, lag counts and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import periodic as pr
from lodestone.llm import words as wd
from lodestone.llm.queries import op12_periodic_runs


def brute(words, least=6, periods=4):
    """{(start, length): period} by trying every period and place."""
    found = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, periods * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return found


def collapsed(words, runs):
    gone = {i for (s, n), q in runs.items() for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def sequences():
    rng = random.Random(12)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 700, list("abab" * 2), list("ababab"), list("abcabcabcabc"), list("xabcabcabcabcay")]
    for alphabet in (1, 2, 3, 5, 40):
        for _ in range(60):
            words = [str(rng.randrange(alphabet)) for _ in range(rng.randint(1, 60))]
            for _ in range(rng.randint(0, 3)):
                block = [str(rng.randrange(alphabet + 1)) for _ in range(rng.randint(1, 9))]
                at = rng.randint(0, len(words))
                words[at:at] = (block * 9)[: rng.randint(1, 9 * len(block))]
            out.append(words)
    nested = (["a"] * 8 + ["b"] + ["c", "d"] * 5) * 6
    return [*out, nested, ["the"] * 3000 + [str(i % 500) for i in range(4000)] + ["the"] * 40, [w for i in range(900) for w in ("the", str(i))]]


def coded(texts):
    flat = pa.array([w.encode() for t in texts for w in t], pa.binary()).view(pa.string())
    sizes = np.array([len(t) for t in texts])
    return wd.codes(flat, sizes), sizes


def test_runs_equal_brute_force():
    texts = sequences()
    word, sizes = coded(texts)
    assert pr.find_runs(word, sizes) == [brute(t) for t in texts]
    rule = pr.RunRule(words=3, periods=2)
    short = [t for t in texts if len(t) < 400]
    assert pr.find_runs(*coded(short), rule) == [brute(t, 3, 2) for t in short]


@pytest.mark.parametrize("held", [1, 1 << 20])
def test_lag_counts_of_frequent_and_rare_words(monkeypatch, held):
    monkeypatch.setattr(pr, "HELD", held)
    texts = [t for t in sequences() if len(t) < 3000]
    word, sizes = coded(texts)
    kinds = {bool(pr.is_frequent(np.array([t.count(w)]), np.array([len(t)]))[0]) for t in texts for w in set(t)}
    assert kinds == {False, True}
    limit = sizes // 4
    got = pr.lag_matches(word, sizes, limit)
    want = [sum(t[i] == t[i + q] for i in range(len(t) - q)) if q else 0 for t, m in zip(texts, limit, strict=True) for q in range(m + 1)]
    assert got.tolist() == want


def test_words_and_lines():
    texts = ["", " \t\r\n\x0b\x0c", "one", " one  two\x0bthree\n", "a\n\na \n \na\n", "é\x1cß x y z", None]
    array = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    (part,) = wd.parts(array)
    values, sizes = wd.words(part)
    assert values.to_pylist() == [w.decode() for t in texts for w in (t or "").encode().split()] and sizes.tolist() == [len((t or "").encode().split()) for t in texts]
    values, sizes = wd.lines(part)
    assert values.to_pylist() == [x for t in texts for x in (t or "").split("\n") if x.encode().split()] and len(sizes) == len(texts)
    assert [len(p) for p in wd.parts(pa.array([b"x" * (wd.PART_BYTES - 1), b"y", b"z", b"w" * 3 * wd.PART_BYTES, b""], pa.binary()))] == [2, 1, 1, 1]


def test_op12_equals_brute_force(spark, sf, rows):
    got = {r.doc_id: r for r in op12_periodic_runs(spark, sf).collect()}
    assert set(got) == {r[0] for r in rows} and any(zlib.crc32(str(d).encode()) % 10 == 0 for d in got)
    digest = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    for d, text, *_ in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(d).encode()), len(words)
        if n > 2000:
            continue  # brute force is square; the test above has long ones
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        top = min(((-n, s, q) for (s, n), q in runs.items()), default=None)
        want = (len(runs), *((top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4))
        shown = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(((s, n, q) for (s, n), q in runs.items()), key=lambda r: (r[0], r[2])))
        r = got[d]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == (*want, digest(shown), digest(" ".join(collapsed(words, runs))))


def test_operator_keeps_other_columns(spark):
    docs = spark.createDataFrame([(None, "a b a b a b a b c", 1, 2), (None, "a b a b a b a b c", 1, 2), (3, None, 1, 2), (4, "", 1, 2)], "doc_id long, body string, `a.b` int, runs int")
    got = pr.periodic_runs(docs.repartition(2), text_col="body")
    assert got.columns == ["doc_id", "a.b", "n_words", "runs", "collapsed_text"]
    assert sorted(map(str, ((r.doc_id, r["a.b"], r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in got.collect()))) == sorted(map(str, [(None, 1, 9, [(0, 8, 2)], "a b c")] * 2 + [(3, 1, 0, [], ""), (4, 1, 0, [], "")]))
    assert pr.periodic_runs(docs.where("false"), text_col="body").count() == 0
    assert got.select(pr.longest(F.col("runs")).alias("t")).where("t.length = 8").count() == 2


def test_op12_of_no_documents(spark, empty):
    assert op12_periodic_runs(spark, empty).collect() == []
