"""Both jobs on copies: growing input, reruns, batches that broke off, repeated documents, settings, command lines."""

from __future__ import annotations

import json
import logging
import os
import re
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import index_feed, retrieval_report
from jobs.common import configured
from lodestone.errors import UsageError
from lodestone.operators.passages import holders

ROOT = Path(__file__).resolve().parents[2]
SCHEMA = "doc_id long, text string, lang string, source string"


def put(spark, folder, name, rows, schema=SCHEMA):
    """One Parquet file of this name, newer than those before."""
    place = Path(folder) / f".{name}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(place))
    (part,) = place.glob("part-*.parquet")
    part.rename(Path(folder) / f"{name}.parquet")
    shutil.rmtree(place)
    at = 1_700_000_000 + 60 * len(list(Path(folder).glob("*.parquet")))
    os.utime(Path(folder) / f"{name}.parquet", (at, at))


def words(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def expected(rows):
    return sorted((d, t, n, len(words(text))) for d, text in rows.items() for t, n in Counter(words(text)).items())


def stored(spark, out):
    return sorted((r.doc_id, r.term, r.tf, r.len) for r in index_feed.current(spark, out).collect())


@pytest.fixture()
def feed(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(spark, folder, "a", [(1, "Red fox, red dog", "en", "s"), (2, "Blue whale", "en", "s"), (None, "nobody", "en", "s"), (3, None, None, None), (4, "", "en", "t")])
    return folder, str(tmp_path / "out"), str(tmp_path / "check")


def test_feed_takes_only_what_is_new(spark, feed, caplog):
    folder, out, check = feed
    caplog.set_level(logging.INFO, "jobs.index_feed")
    assert index_feed.run(spark, str(folder), out, check) == {"batches": 1, "rows": 5, "without_id": 1, "documents": 4, "postings": 5}
    first = {1: "Red fox, red dog", 2: "Blue whale", 3: None, 4: ""}
    assert stored(spark, out) == expected(first)
    assert "read 5 rows (1 without an id); wrote 4 documents and 5 postings" in caplog.text
    assert index_feed.run(spark, str(folder), out, check)["batches"] == 0 and stored(spark, out) == expected(first)
    # one document is new, one comes again with another text, one comes again without a text
    put(spark, folder, "b", [(5, "a green fox", "fr", "u"), (2, "blue blue sea", "de", "s"), (1, None, "en", "s")])
    assert index_feed.run(spark, str(folder), out, check) == {"batches": 1, "rows": 3, "without_id": 0, "documents": 3, "postings": 5}
    assert stored(spark, out) == expected({1: None, 2: "blue blue sea", 3: None, 4: "", 5: "a green fox"})
    got = {r.doc_id: (r.batch, r.lang, r.source, r.n_terms) for r in index_feed.documents(spark, out).collect()}
    assert got == {1: (1, "en", "s", 0), 2: (1, "de", "s", 3), 3: (0, None, None, 0), 4: (0, "en", "t", 0), 5: (1, "fr", "u", 3)}


def test_two_runs_give_what_one_run_gives(spark, feed, tmp_path):
    folder, out, check = feed
    index_feed.run(spark, str(folder), out, check)
    put(spark, folder, "b", [(i, f"word{i % 7} common text {i}", "en", "s") for i in range(2, 40)])
    put(spark, folder, "c", [(i, f"late{i % 5} common", "en", "s") for i in range(30, 50)])
    index_feed.run(spark, str(folder), out, check, index_feed.FeedConfig(files_per_batch=1))
    whole = str(tmp_path / "whole")
    assert index_feed.run(spark, str(folder / "*.parquet"), whole, str(tmp_path / "check2"))["batches"] == 1
    assert stored(spark, out) == stored(spark, whole) and len({r.batch for r in index_feed.documents(spark, out).collect()}) == 3


@pytest.mark.parametrize("lost", ["documents", "both"])
def test_a_batch_that_broke_off_is_taken_again(spark, feed, lost):
    folder, out, check = feed
    index_feed.run(spark, str(folder), out, check)
    put(spark, folder, "b", [(2, "blue sea", "en", "s"), (6, "new text", "en", "s")])
    index_feed.run(spark, str(folder), out, check)
    want = stored(spark, out)
    for name in ("1", ".1.crc"):  # as if the driver had died before the batch was committed
        os.remove(f"{check}/commits/{name}")
    for name in ("documents", "postings"):
        if lost in (name, "both"):
            for place in Path(out, name).rglob("batch=1"):
                shutil.rmtree(place)
    assert index_feed.run(spark, str(folder), out, check)["documents"] == 2
    assert stored(spark, out) == want and index_feed.run(spark, str(folder), out, check)["batches"] == 0


def test_a_failing_batch_loses_nothing(spark, feed, monkeypatch):
    folder, out, check = feed
    index_feed.run(spark, str(folder), out, check)
    before = stored(spark, out)
    put(spark, folder, "b", [(2, "blue sea", "en", "s"), (6, "new text", "en", "s")])
    monkeypatch.setattr(index_feed, "index_terms", lambda c: 1 / 0)  # after the postings, before the documents
    with pytest.raises(Exception, match="division by zero"):
        index_feed.run(spark, str(folder), out, check)
    monkeypatch.undo()
    assert [r for r in stored(spark, out) if r[0] != 2] == [r for r in before if r[0] != 2] and stored(spark, out) == before
    index_feed.run(spark, str(folder), out, check)
    assert stored(spark, out) == expected({1: "Red fox, red dog", 2: "blue sea", 3: None, 4: "", 6: "new text"})


@pytest.mark.parametrize("bound", [0, 500_000])
def test_repeated_ids_within_a_batch(spark, feed, monkeypatch, bound):
    monkeypatch.setattr(index_feed, "BROADCAST_IDS", bound)
    folder, out, check = feed
    put(spark, folder, "b", [(1, "older zebra", "en", "s"), (1, "older ant", "en", "s"), (9, "same", "en", "a"), (9, "same", "en", "b")])
    put(spark, folder, "c", [(1, "newest", "en", "s"), *[(7, f"hot {i % 10}", "en", "s") for i in range(200)]])
    assert index_feed.run(spark, str(folder), out, check)["documents"] == 6
    assert stored(spark, out) == expected({1: "newest", 2: "Blue whale", 7: "hot 9", 9: "same", 3: None, 4: ""})
    assert {r.doc_id: r.source for r in index_feed.documents(spark, out).collect()}[9] == "b"


def test_feed_of_other_columns_and_empty_files(spark, tmp_path):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    with pytest.raises(UsageError, match="no Parquet files"):
        index_feed.run(spark, str(folder), out, check)
    schema = "`my.id` int, `the text` string, batch string, bucket string, text int"
    put(spark, folder, "a", [], schema)
    config = index_feed.FeedConfig("my.id", "the text", ())
    assert index_feed.run(spark, str(folder), out, check, config)["rows"] == 0
    put(spark, folder, "b", [(1, "one two", "x", "y", 3)], schema)
    index_feed.run(spark, str(folder), out, check, config)
    assert stored(spark, out) == [(1, "one", 1, 2), (1, "two", 1, 2)]
    with pytest.raises(UsageError, match="lacks the columns doc_id"):
        index_feed.run(spark, str(folder), out, check)


def test_a_search_reads_the_feed(spark, feed):
    from lodestone.operators.retrieval import bm25, corpus_size

    folder, out, check = feed
    index_feed.run(spark, str(folder), out, check)
    index = index_feed.current(spark, out).withColumnRenamed("doc_id", "chunk_id")
    hits = bm25(index, spark.createDataFrame([(0, "red whale")], "qid long, query string"), 5, *corpus_size(index))
    assert [r.chunk_id for r in hits.orderBy("fts_rank").collect()] == [1, 2]


# ---------------------------------------------------------------- passages and the report


def test_holders_equal_brute_force(spark, monkeypatch):
    from lodestone.operators import passages

    texts = ["the red fox jumps over the lazy dog again", "a red fox jumps over the lazy dogs", "red  fox jumps over", "", None, "fox", "the red fox jumps over the lazy dog again and the red fox jumps over the lazy dog again", "xx jumps over the lazy yy"]
    asked = ["red fox jumps over the lazy dog", "ed fox jumps over the la", "fox", "red fox", "ox jumps over", "", None, " jumps over the lazy ", "no such words are in any text here", "red  fox jumps over", "the red fox jumps over the lazy dog again", "jumps over the lazy"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([*enumerate(asked), (2, "fox")], "qid long, passage string")
    want = sorted((q, d) for q, p in enumerate(asked) for d, t in enumerate(texts) if p and t and p in t)
    for bound, block in ((200_000, 4096), (0, 2)):
        monkeypatch.setattr(passages, "BROADCAST_ANCHORS", bound)
        monkeypatch.setattr(passages, "QUERY_BLOCK", block)
        assert sorted(map(tuple, holders(docs, queries).collect())) == want


def test_long_passages_meet_no_other_texts(spark):
    docs = spark.createDataFrame([(i, f"w{i} v{i} u{i} t{i} s{i} r{i}") for i in range(50)], "doc_id long, text string")
    found = holders(docs, docs.select(F.col("doc_id").alias("qid"), F.col("text").alias("passage")))
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and found.count() == 50


@pytest.fixture()
def library(spark, tmp_path):
    texts = ["stars and galaxies shine in the dark night sky", "flour water and yeast make good bread rise", "a sailing boat needs wind and a steady hand", "stars and bread and boats", None, ""]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "nobody", "en", "s")], SCHEMA).write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(10, "galaxies shine in the dark night"), (11, "water and yeast make good bread"), (12, "nothing of the kind is here at all"), (13, None), (None, "x")], "item_id long, text string").write.parquet(str(tmp_path / "queries"))
    return str(tmp_path / "docs"), str(tmp_path / "queries"), str(tmp_path / "report")


def rows(spark, out):
    return sorted(map(str, retrieval_report.results(spark, out).collect()))


def test_report(spark, library, caplog):
    docs, queries, out = library
    caplog.set_level(logging.INFO, "jobs.retrieval_report")
    counts = retrieval_report.run(spark, docs, queries, out)
    got = retrieval_report.results(spark, out).collect()
    assert counts["documents"] == 6 and counts["queries"] == 4 and counts["results"] == len(got)
    first = {(r.mode, r.qid): r.doc_id for r in got if r["rank"] == 1}
    assert all(first[m, 10] == 0 and first[m, 11] == 1 for m in ("text", "hybrid"))
    assert {(r.mode, r.qid, r.doc_id) for r in got if r.truth} == {(m, q, q - 10) for m in retrieval_report.MODES for q in (10, 11)}
    for r in retrieval_report.summary(spark, out).collect():
        ranks = [g["rank"] for g in got if g.truth and g.mode == r.mode]
        assert (r.queries, r.found, r.first) == (2, sum(x is not None for x in ranks), ranks.count(1))
        assert r.mrr == pytest.approx(sum(1 / x for x in ranks if x) / 2, abs=6e-4)
    assert "read 6 documents" in caplog.text and "wrote" in caplog.text
    before = rows(spark, out)
    assert retrieval_report.run(spark, docs, queries, out) == counts and rows(spark, out) == before


def test_report_of_one_mode_replaces_that_mode_only(spark, library):
    docs, queries, out = library
    retrieval_report.run(spark, docs, queries, out)
    vector = retrieval_report.results(spark, out).where("mode = 'vector'").count()
    retrieval_report.run(spark, docs, queries, out, retrieval_report.ReportConfig(modes=("text",), depth=1, keep=1))
    after = retrieval_report.results(spark, out).groupBy("mode").count().collect()
    assert {r.mode for r in after} == set(retrieval_report.MODES) and {r.mode: r["count"] for r in after}["vector"] == vector
    assert {r["rank"] for r in retrieval_report.results(spark, out).where("mode = 'text'").collect()} <= {1, None}
    for wrong in ({"modes": ("nope",)}, {"modes": ()}, {"keep": 0}, {"keep": 9, "depth": 3}):
        with pytest.raises(UsageError):
            retrieval_report.run(spark, docs, queries, out, retrieval_report.ReportConfig(**wrong))


def test_report_without_documents_or_queries(spark, library, tmp_path):
    docs, queries, out = library
    none = str(tmp_path / "none")
    spark.createDataFrame([], SCHEMA).write.parquet(none)
    assert retrieval_report.run(spark, none, queries, out)["results"] == 0 and retrieval_report.summary(spark, out).count() == 0
    assert retrieval_report.run(spark, docs, none, str(tmp_path / "r2"), retrieval_report.ReportConfig(query_id_column="doc_id"))["queries"] == 0


def test_configuration_files(tmp_path):
    assert configured(index_feed.FeedConfig, str(ROOT / "jobs/index_feed.json")) == index_feed.FeedConfig()
    assert configured(retrieval_report.ReportConfig, str(ROOT / "jobs/retrieval_report.json")) == retrieval_report.ReportConfig()
    (tmp_path / "c.json").write_text(json.dumps({"depht": 3}))
    with pytest.raises(UsageError, match="depht"):
        configured(retrieval_report.ReportConfig, str(tmp_path / "c.json"))


def test_command_lines(spark, feed, library, tmp_path):
    folder, out, check = feed
    docs, queries, report = library
    run = lambda *a: subprocess.run([sys.executable, "-m", *a], cwd=ROOT, capture_output=True, text=True, timeout=300)
    done = run("jobs.index_feed", str(folder), out, check, "--config", "jobs/index_feed.json")
    assert done.returncode == 0 and "wrote 4 documents" in done.stderr, done.stderr
    assert stored(spark, out) == expected({1: "Red fox, red dog", 2: "Blue whale"})
    (tmp_path / "c.json").write_text(json.dumps({"modes": ["text"], "depth": 5, "keep": 2}))
    done = run("jobs.retrieval_report", docs, queries, report, "--config", str(tmp_path / "c.json"))
    assert done.returncode == 0 and "text: 2 of 2 found" in done.stderr, done.stderr
    assert run("jobs.index_feed", str(tmp_path / "nowhere"), out, check).returncode == 1


def test_registered_runs_leave_no_setting_changed(spark):
    from jobs import registered

    before = dict(spark.conf.getAll)
    got = registered.job1_index_feed(spark, "/root/testdata/sf0.001")
    assert got.select("doc_id").distinct().count() == 200 and dict(spark.conf.getAll) == before and not spark.streams.active
