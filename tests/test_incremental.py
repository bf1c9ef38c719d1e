"""Indexes in parts: what a change writes, failures of single files, streams, runs that break off."""

from __future__ import annotations

import os
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.errors import EnvironmentFailure, UsageError
from lodestone.operators.chunking import register_chunker
from lodestone.plans import index as ix
from lodestone.plans.index import Index
from lodestone.sources import files as src
from lodestone.streaming.ingest import ingest

TABLES = ("files", "documents", "chunks", "vectors", "postings", "doc_authors", "doc_tags")


def listing(spark, rows):
    """rows are (path, fingerprint, text, creators); two files of a document share what stands before the slash."""
    given = spark.createDataFrame(rows, "path string, fingerprint string, content string, creators string")
    return given.select(F.substring_index("path", "/", 1).alias("key"), F.concat(F.lit("title of "), F.substring_index("path", "/", 1)).alias("title"), "path", "fingerprint", F.when(F.col("creators").isNotNull(), F.create_map(F.lit("creators"), "creators")).otherwise(F.create_map().cast("map<string,string>")).alias("meta"), "content")


def rows_of(index):
    return {t: sorted(map(str, index.table(t).collect())) for t in TABLES}


def written(folder):
    return {str(f): f.stat().st_size for f in Path(folder).rglob("*.parquet")}


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """An index of 300 files, two of each document, with what it was made of; tests take copies."""
    folder = tmp_path_factory.mktemp("base") / "index"
    rows = [(f"d{i // 2}/f{i}", "1", f"common words and number n{i}", f"King, A{i // 2}; Lee, B" if i % 3 else None) for i in range(300)]
    Index(spark, str(folder), create=True, parts=32).sync(listing(spark, rows), F.col("content"))
    return folder, rows


@pytest.fixture()
def made(base, tmp_path):
    shutil.copytree(base[0], tmp_path / "index")
    return str(tmp_path / "index"), list(base[1])


def test_a_change_writes_its_parts_only_and_reads_as_a_rebuild(spark, made, tmp_path):
    path, rows = made
    before = written(path)
    index = Index(spark, path)
    rows[7] = (rows[7][0], "2", "a changed text", "New, Author")
    assert index.sync(listing(spark, rows), F.col("content")) == {"new": 0, "changed": 1, "retry": 0, "unchanged": 299, "removed": 0}
    assert index.report == {"ok": 1, "chunks": 1}
    new = {f: n for f, n in written(path).items() if f not in before}
    assert sum(new.values()) < sum(before.values()) / 16 and {Path(f).parent.name for f in new if "chunks" in f} == {f"part={p}" for p in {int(Path(f).parent.name[5:]) for f in new if "/files/" in f}}
    fresh = Index(spark, str(tmp_path / "fresh"), create=True, parts=5)
    fresh.sync(listing(spark, rows), F.col("content"))
    assert rows_of(Index(spark, path)) == rows_of(fresh) and index.tables().size == fresh.tables().size


def test_removals_renamed_titles_and_new_files(spark, made, tmp_path):
    path, rows = made
    index = Index(spark, path)
    one = index.table("documents").where("key = 'd40'").select("document_id")
    index.set_facets(one.withColumn("doc_type", F.lit("note")), one.withColumn("tag", F.lit("sky")))
    rows = [r for r in rows if not r[0].startswith("d3/") and r[0] != "d5/f10"] + [("d900/x", "1", "something new", None)]
    named = listing(spark, rows).withColumn("title", F.when(F.col("key") == "d9", "another title").otherwise(F.col("title")))
    counts = index.sync(named, F.col("content"), tags=lambda d: d.where("key = 'd900'").select("document_id", F.lit("fresh").alias("tag")))
    assert (counts["new"], counts["removed"], counts["unchanged"]) == (1, 3, 297)
    fresh = Index(spark, str(tmp_path / "fresh"), create=True, parts=3)
    fresh.sync(named, F.col("content"))
    got, want = rows_of(index), rows_of(fresh)
    assert {t: got[t] for t in ("files", "chunks", "vectors", "postings", "doc_authors")} == {t: want[t] for t in ("files", "chunks", "vectors", "postings", "doc_authors")}
    documents = {r.key: (r.title, r.doc_type) for r in index.table("documents").collect()}
    assert "d3" not in documents and documents["d9"][0] == "another title" and documents["d40"][1] == "note" and len(documents) == 150
    assert {r.tag for r in index.table("doc_tags").collect()} == {"sky", "fresh"}
    index.remove(["d900/x", "d5/f11"])
    assert index.table("documents").where("key in ('d900', 'd5')").count() == 0 and {r.tag for r in index.table("doc_tags").collect()} == {"sky"}
    assert index.tables().size[0] == index.table("chunks").count() == 296


def test_a_run_that_breaks_off_leaves_the_index_before(spark, made, monkeypatch):
    path, rows = made
    index = Index(spark, path)
    want = rows_of(index)
    rows[7] = (rows[7][0], "2", "a changed text", None)
    monkeypatch.setattr(ix.Index, "_last", lambda self: 99)  # all tables are written, the manifest isn't
    with pytest.raises(UsageError, match="another run"):
        index.sync(listing(spark, rows), F.col("content"))
    monkeypatch.undo()
    assert index.manifest == Index(spark, path).manifest and rows_of(index) == want
    orphans = set(written(path)) - {f for f in written(path) if any(p in f for m in [index.manifest] for t in m["parts"].values() for p in t.values())}
    assert orphans and index.vacuum(hours=1) == 0 and index.vacuum(hours=-1) > 0 and not orphans & set(written(path))
    assert rows_of(Index(spark, path)) == want
    for n in range(3):
        rows[7] = (rows[7][0], f"v{n}", f"text {n}", None)
        index.sync(listing(spark, rows), F.col("content"))
    now, size = rows_of(index), len(written(path))
    assert index.vacuum(keep=1, hours=-1) > 0 and len(written(path)) < size and rows_of(Index(spark, path)) == now
    assert len(list(Path(path).glob("manifest-*.json"))) == 1 and index.vacuum(keep=1, hours=-1) == 0


def test_an_older_index_is_taken_over(spark, made, tmp_path):
    """Before, tables were stored as a whole."""
    path, rows = made
    index = Index(spark, path)
    old = Index(spark, str(tmp_path / "old"), create=True, parts=4)
    old.manifest["meta"] = {k: v for k, v in index.manifest["meta"].items()}
    old.commit({t: index.table(t).drop("summary") for t in TABLES if t != "postings"} | {"postings": index.table("postings")})
    old = Index(spark, str(tmp_path / "old"))
    assert rows_of(old) == rows_of(index)
    rows[7] = (rows[7][0], "2", "a changed text", "King, A3; Lee, B")
    for each in (old, index):
        each.sync(listing(spark, rows), F.col("content"))
    assert rows_of(Index(spark, str(tmp_path / "old"))) == rows_of(index) and not set(TABLES) & set(old.manifest["tables"])


@pytest.fixture()
def pdf():
    def read(blob):
        if blob.startswith(b"broken"):
            raise ValueError("not a PDF")
        return blob.decode()

    return read


def test_one_bad_file_among_many(spark, tmp_path, pdf):
    files = [(f"f{i}.pdf", "1", b"broken" if i == 7 else b" " if i == 8 else f"page {i}".encode()) for i in range(100)]
    source = lambda f: spark.createDataFrame([(p, p, p, v, "application/pdf", bytearray(c)) for p, v, c in f], "key string, title string, path string, fingerprint string, content_type string, content binary")
    read = lambda **k: src.extract_text(F.col("content"), F.col("path"), F.col("content_type"), pdf, **k)
    index = Index(spark, str(tmp_path / "index"), create=True, parts=4)
    with pytest.raises(Exception, match="not a PDF"):
        index.sync(source(files), read())
    assert index.sync(source(files), read(errors=True))["new"] == 100
    assert index.report == {"ok": 98, "error": 1, "no_text": 1, "chunks": 98}
    assert {(r.path, r.status) for r in ix.skipped(index.table("files")).collect()} == {("f7.pdf", "error"), ("f8.pdf", "no_text")}
    by_status = {r.status: r["count"] for r in index.table("files").groupBy("status").count().collect()}
    assert by_status == {k: n for k, n in index.report.items() if k != "chunks"} and index.table("chunks").count() == 98
    again = index.sync(source(files), read(errors=True))  # a file that failed is left alone until it changes
    assert again["unchanged"] == 100 and index.report == {"chunks": 0}
    files[7] = ("f7.pdf", "2", b"mended")
    index.sync(source(files), read(errors=True))
    assert index.report == {"ok": 1, "chunks": 1} and index.table("files").where("status = 'error'").count() == 0


def test_a_sidecar_stands_in_for_a_failing_file(spark, pdf):
    row = spark.createDataFrame([("a.pdf", "application/pdf", bytearray(b"broken"), "read before"), ("b.pdf", "application/pdf", bytearray(b"broken"), None), ("c.txt", None, bytearray(b"ok"), None)], "path string, content_type string, content binary, sidecar string")
    out = src.extract_text(F.col("content"), F.col("path"), F.col("content_type"), pdf, F.col("sidecar"), errors=True)
    assert [tuple(r.x) for r in row.orderBy("path").select(out.alias("x")).collect()] == [("read before", None), (None, "ValueError: not a PDF"), ("ok", None)]


def test_malformed_utf8_is_replaced_as_by_python(spark):
    blobs = [b"plain", b"a\xffb", b"\xc3", b"\xe2\x82", b"x\xf0\x9f\x98y", b"\xed\xa0\x80", "é🙂".encode(), b"\xc0\xafz"]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "i int, content binary")
    got = [r.t for r in rows.orderBy("i").select(src.extract_text(F.col("content"), F.lit("a.txt"), F.lit("text/plain")).alias("t")).collect()]
    assert got == [b.decode("utf-8", "replace") for b in blobs]


def test_a_failing_chunker_leaves_the_file_pending(spark, tmp_path):
    state = tmp_path / "up"

    def outline(text):
        if "hard" in text and not state.exists():
            raise RuntimeError("no answer")
        if "gone" in text:
            raise EnvironmentFailure("the model is unreachable")
        return [{"title": "T", "ideas": [{"first_words": text[:10]}]}]

    rows = [("a/1", "1", "an easy text of some words", None), ("b/2", "1", "a hard text of some words", None)]
    index = Index(spark, str(tmp_path / "index"), create=True, parts=4)
    settings = {"chunker": "outline", "chunk_settings": {"outline": outline}}
    index.sync(listing(spark, rows), F.col("content"), **settings)
    assert index.report == {"ok": 1, "llm_pending": 1, "chunks": 1}
    assert "skipped: b/2 (llm_pending)" in index.status()
    state.write_text("")
    assert index.sync(listing(spark, rows), F.col("content"), **settings)["retry"] == 1
    assert index.report == {"ok": 1, "chunks": 1} and ix.skipped(index.table("files")).count() == 0
    with pytest.raises(Exception, match="unreachable"):
        index.sync(listing(spark, [*rows, ("c/3", "1", "a gone text", None)]), F.col("content"), **settings)


def test_a_chunker_that_gives_nothing_is_no_text(spark, tmp_path):
    register_chunker("none", lambda: lambda text, title: F.array().cast("array<string>"))
    index = Index(spark, str(tmp_path / "index"), create=True, parts=2)
    index.sync(listing(spark, [("a/1", "1", "text", None)]), F.col("content"), chunker="none")
    assert index.report == {"no_text": 1, "chunks": 0}


# ---------------------------------------------------------------- streams


def put(folder, name, text):
    (folder / name).write_text(text)


def take(spark, folder, index, checkpoint, **k):
    text = src.extract_text(F.col("content"), F.col("path"), F.col("content_type"), errors=True)
    ingest(index, src.directory_arrivals(spark, str(folder), 2), text, "arrivals", checkpoint, **k).awaitTermination()


def test_stream_of_files(spark, tmp_path):
    folder, path, check = tmp_path / "in", str(tmp_path / "index"), str(tmp_path / "check")
    (folder / "sub").mkdir(parents=True)
    for i in range(3):
        put(folder, f"a{i}.txt", f"first lot number {i}")
    put(folder / "sub", "b.md", " ")
    put(folder, "c.docx", "x")
    take(spark, folder, Index(spark, path, create=True, parts=4), check)
    index = Index(spark, path)
    last = index.manifest["streams"]["arrivals"]
    assert last >= 1 and index.table("files").count() == 4 and index.table("files").where("status = 'ok'").count() == 3
    take(spark, folder, index, check)
    assert Index(spark, path).number == index.number  # nothing new, no commit
    put(folder, "d.txt", "a later file")
    take(spark, folder, index, check)
    whole = Index(spark, str(tmp_path / "whole"), create=True)
    text = src.extract_text(F.col("content"), F.col("path"), F.col("content_type"))
    whole.sync(src.scan_directory(spark, str(folder)), text)
    assert rows_of(Index(spark, path)) == rows_of(whole) and index.manifest["streams"]["arrivals"] > last
    os.remove(folder / "a0.txt")  # a sync after it finds only what a stream can't
    assert index.sync(src.scan_directory(spark, str(folder)), text) == {"new": 0, "changed": 0, "retry": 0, "unchanged": 4, "removed": 1}


def test_a_stop_between_commit_and_checkpoint_repeats_nothing(spark, tmp_path, monkeypatch):
    folder, path, check = tmp_path / "in", str(tmp_path / "index"), str(tmp_path / "check")
    folder.mkdir()
    put(folder, "a.txt", "one text")
    take(spark, folder, Index(spark, path, create=True, parts=4), check)
    put(folder, "b.txt", "another text")
    take(spark, folder, Index(spark, path), check)
    index = Index(spark, path)
    number, want = index.number, rows_of(index)
    for name in ("1", ".1.crc"):  # the stream doesn't know that its batch was committed
        os.remove(f"{check}/commits/{name}")
    take(spark, folder, index, check)
    assert Index(spark, path).number == number and rows_of(Index(spark, path)) == want
    put(folder, "c.txt", "a third text")
    monkeypatch.setattr(ix.Index, "commit", lambda *a, **k: 1 / 0)  # stopped before the commit
    with pytest.raises(Exception, match="division by zero"):
        take(spark, folder, index, check)
    monkeypatch.undo()
    assert rows_of(Index(spark, path)) == want
    take(spark, folder, index, check)
    assert [r.path for r in Index(spark, path).table("files").orderBy("path").collect()] == ["a.txt", "b.txt", "c.txt"]


def test_command_line_takes_arrivals(spark, tmp_path, monkeypatch, capsys):
    from lodestone import cli

    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "a.txt", "bread and yeast")
    put(folder, "b.txt", " ")
    run = lambda *a: cli.run([*a, "--db", str(tmp_path / "db")])
    assert run("index", str(folder), "--arrivals") == 0
    assert "processed: 1 chunks, 1 no_text, 1 ok" in (said := capsys.readouterr().err) and "skipped: b.txt (no_text)" in said
    put(folder, "c.txt", "stars and yeast")
    assert run("index", str(folder), "--arrivals") == 0 and run("index", str(folder)) == 0
    assert "3 unchanged" in capsys.readouterr().err
    assert run("search", str(folder), "yeast") == 0
    assert {line.split("\t")[1] for line in capsys.readouterr().out.splitlines()} == {"a.txt", "c.txt"}
