"""Results that are appended: resumed after a stop, tried again after failures and changes, never doubled."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.errors import EnvironmentFailure
from lodestone.plans.experiments import Results


@pytest.fixture()
def noted(tmp_path):
    log = tmp_path / "calls"
    log.touch()

    def process(row):
        with open(log, "a") as f:
            f.write(row["ckpt"] + "\n")
        if row["text"] == "bad":
            raise ValueError("bad text")
        return {"words": "many"} if row["text"] == "odd" else {"words": len((row["text"] or "").split())}

    def since():
        lines = sorted(log.read_text().split())
        log.write_text("")
        return lines

    return process, since


def work(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "ckpt string, text string")
    return df.select("ckpt", F.sha2("text", 256).alias("fingerprint"), "text")


def test_the_second_run_does_the_other_half_only(spark, tmp_path, noted):
    process, since = noted
    results = Results(spark, str(tmp_path / "r"), "words int")
    texts = {f"k{i:02}": " ".join("w" * i) for i in range(40)}
    assert results.remaining(work(spark, texts)).count() == 40 and results.latest().count() == 0
    append, n = results._append, []

    def breaking(made):
        n.append(1)
        if len(n) == 3:
            raise KeyboardInterrupt
        append(made)

    results._append = breaking
    with pytest.raises(KeyboardInterrupt):
        results.run(work(spark, texts), process, per_round=10)
    results._append = append
    kept = {r.ckpt for r in results.latest().collect()}
    assert 0 < len(kept) < 40 and kept < set(since())
    counts = results.run(work(spark, texts), process, per_round=10)
    assert counts == {"done": 40 - len(kept), "failed": 0, "left": 0}
    assert set(since()) == set(texts) - kept
    assert results.records().count() == 40  # none is doubled
    assert {r.ckpt: r.result.words for r in results.latest().collect()} == {f"k{i:02}": i for i in range(40)}
    assert results.run(work(spark, texts), process) == {"done": 0, "failed": 0, "left": 0} and since() == []


def test_failures_and_changes_are_tried_again(spark, tmp_path, noted):
    process, since = noted
    results = Results(spark, str(tmp_path / "r"), "words int")
    texts = {"a": "x y", "b": "bad", "c": "odd", "d": None}
    rows = work(spark, texts)
    assert results.run(rows.union(rows), process) == {"done": 2, "failed": 2, "left": 0} and since() == ["a", "b", "c", "d"]
    latest = {r.ckpt: (r.result and r.result.words, r.error) for r in results.latest().collect()}
    assert latest == {"a": (2, None), "b": (None, "ValueError: bad text"), "c": (None, 'the result doesn\'t fit: {"words": "many"}'), "d": (0, None)}
    texts |= {"a": "x y z", "b": "good"}
    assert results.run(work(spark, texts), process) == {"done": 2, "failed": 1, "left": 0}
    assert since() == ["a", "b", "c"]
    latest = {r.ckpt: (r.result and r.result.words, r.error is None) for r in results.latest().collect()}
    assert latest == {"a": (3, True), "b": (1, True), "c": (None, False), "d": (0, True)}
    assert results.run(work(spark, {"a": "x y z", "e": "1", "f": "2"}), process, per_round=1, rounds=0) == {"done": 0, "failed": 0, "left": 2}
    assert since() == []

    def gone(row):
        raise EnvironmentFailure("no model")

    with pytest.raises(Exception, match="no model"):
        results.run(work(spark, {"z": "1"}), gone)
    assert results.latest().where("ckpt = 'z'").count() == 0


def test_broken_lines_are_left_out(spark, tmp_path, noted):
    process, _ = noted
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "old.json").write_text('{"ckpt": "a", "ts": 1.0, "result": {"words": 4}}\n{"ckpt": "b", "ts\n{"ts": 2}\n')
    results = Results(spark, str(tmp_path / "r"), "words int")
    assert [(r.ckpt, r.result.words) for r in results.latest().collect()] == [("a", 4)]
    assert results.run(work(spark, {"a": None, "b": "x"}), process) == {"done": 1, "failed": 0, "left": 0}
