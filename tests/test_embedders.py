"""The batched embedder with a model that records its calls."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.errors import EnvironmentFailure
from lodestone.functions import embedders as em
from lodestone.functions import vectors as vec
from lodestone.plans.index import Index


class Recorder:
    def __init__(self, fail=0):
        self.calls, self.fail = [], fail

    def __call__(self, texts):
        self.calls.append(list(texts))
        if len(self.calls) <= self.fail:
            raise ConnectionError("refused")
        return [[float(len(t)), float(sum(map(ord, t)) % 97)] for t in texts]


def run(series, model, size=32, tries=2):
    return [list(s) for s in em.embedded(iter([pd.Series(s, dtype=object) for s in series]), model, size, tries)]


@pytest.mark.parametrize("lengths", [[10] * 20, [1] * 70, [200], [0, 31, 1, 0, 33, 5], [3, 500, 3], []])
def test_full_batches_across_series_and_equal_texts_once(lengths):
    rng = random.Random(1)
    series = [[rng.choice([None, f"text {rng.randrange(120)}"]) for _ in range(n)] for n in lengths]
    model = Recorder()
    got = run(series, model)
    assert got == [[None if t is None else Recorder()([t])[0] for t in s] for s in series]
    sent = [t for c in model.calls for t in c]
    assert len(sent) == len(set(sent)) and set(sent) == {t for s in series for t in s if t is not None}
    assert all(len(c) == 32 for c in model.calls[:-1]) and all(model.calls)


def test_the_vectors_at_hand_are_bounded(monkeypatch):
    monkeypatch.setattr(em, "CACHE", 10)
    series = [[f"t{i + j}" for j in range(8)] for i in range(0, 400, 4)]
    assert run(series, model := Recorder(), 8) == [[Recorder()([t])[0] for t in s] for s in series]
    assert len(model.calls) > 404 // 8  # some were asked for again


def test_failed_calls_and_answers_that_do_not_fit():
    assert run([["a"]], Recorder(fail=1)) == [[[1.0, 0.0]]]
    with pytest.raises(EnvironmentFailure, match="ConnectionError: refused"):
        run([["a"]], Recorder(fail=2))
    for answer, said in ((lambda t: [], "0 vectors for 2"), (lambda t: [[], []], "empty"), (lambda t: [[1.0], [1.0, 2.0]], "dimensions"), (lambda t: [[1.0], [float("nan")]], "no number")):
        calls = []
        with pytest.raises(EnvironmentFailure, match=said):
            run([["a", "b"]], lambda t, answer=answer, calls=calls: calls.append(t) or answer(t))
        assert len(calls) == 1
    with pytest.raises(EnvironmentFailure, match="2 and 1 dimensions"):  # from call to call
        run([["a", "bb"]], lambda t: [[0.0] * len(t[0])], size=1)


def test_in_spark_and_in_an_index(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()

    def model(texts):
        import uuid

        (folder / uuid.uuid4().hex).write_text("\n".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = spark.createDataFrame([(i, f"text {i % 70}" if i % 9 else None) for i in range(300)], "i int, t string").coalesce(1)
        got = {r.i: (r.t, r.v) for r in rows.select("i", "t", em.model_embedder(model)("t").alias("v")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(v == (None if t is None else [float(len(t)), 1.0]) for t, v in got.values())
    sizes = sorted(len(f.read_text().split("\n")) for f in folder.iterdir())
    assert sizes == [6, 32, 32]  # 70 distinct texts
    vec.register_embedder("model", lambda name: em.model_embedder(model))
    index = Index(spark, str(tmp_path / "index"), create=True, parts=2)
    source = spark.createDataFrame([(f"k{i}", "t", f"p{i}", "1", f"words number {i}") for i in range(5)], "key string, title string, path string, fingerprint string, content string")
    index.sync(source, F.col("content"), embedder="model", model="m")
    assert index.manifest["meta"]["dim"] == 2 and index.table("vectors").where("embedding[0] = 14").count() == 5
