"""Texts of scanned files: recognised once for each content, found again after renames, kept when a fill breaks off."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.plans.index import Index
from lodestone.sources import files as src
from lodestone.sources.ocr import OcrStore, ocr_missing


@pytest.fixture()
def calls(tmp_path):
    """Two plug-ins that note what they read, in a file, as they run in other processes; and the notes since last time."""
    log = tmp_path / "calls.log"
    log.touch()

    def note(kind, blob):
        with open(log, "a") as f:
            f.write(f"{kind} {blob.decode()}\n")

    def pdf(blob):
        note("pdf", blob)
        return None if blob.startswith(b"scan") else blob.decode()

    def ocr(blob):
        note("ocr", blob)
        if b"bad" in blob:
            raise ValueError(blob)
        return " " if b"blank" in blob else f"recognised {blob.decode()}"

    def since():
        lines = sorted(log.read_text().splitlines())
        log.write_text("")
        return lines

    return pdf, ocr, since


def source(spark, files):
    """files is path: content."""
    rows = spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "path string, content binary")
    kind = F.when(F.col("path").endswith(".pdf"), "application/pdf").otherwise("text/plain")
    return rows.select(F.col("path").alias("key"), F.col("path").alias("title"), "path", F.sha2("content", 256).alias("fingerprint"), kind.alias("content_type"), "content")


FILES = {"a.pdf": b"scan one", "copy.pdf": b"scan one", "bad.pdf": b"scan bad", "blank.pdf": b"scan blank", "text.pdf": b"layer", "note.txt": b"a note"}


def test_scanned_files(spark, tmp_path, calls):
    pdf, ocr, since = calls
    index, store = Index(spark, str(tmp_path / "index"), create=True, parts=3), OcrStore(spark, str(tmp_path / "ocr"))
    text = src.extract_text(F.col("content"), F.col("path"), F.col("content_type"), pdf, F.col("sidecar"), errors=True)
    sync = lambda files: index.sync(source(spark, files), text, ocr=store)
    assert sync(FILES)["new"] == 6 and index.report["no_text"] == 4
    since()

    assert ocr_missing(index, source(spark, FILES), store, ocr) == {"done": 3, "failed": 1}
    assert since() == ["ocr scan bad", "ocr scan blank", "ocr scan one"]  # equal contents are read once
    states = sync(FILES)  # a text that came makes work of its files; a blank one doesn't
    assert (states["retry"], states["unchanged"]) == (2, 4) and since() == []
    of = lambda: {r.path: r.text for r in index.table("files").join(index.table("chunks"), "file_id").collect()}
    assert of() == {"a.pdf": "recognised scan one", "copy.pdf": "recognised scan one", "text.pdf": "layer", "note.txt": "a note"}
    assert sync(FILES)["retry"] == 0

    moved = {("new.pdf" if p == "a.pdf" else p): c for p, c in FILES.items() if p != "copy.pdf"}
    states = sync(moved)  # neither read nor recognised again
    assert (states["new"], states["removed"]) == (1, 2) and since() == [] and of()["new.pdf"] == "recognised scan one"
    del moved["blank.pdf"]
    assert ocr_missing(index, source(spark, moved), store, ocr) == {"done": 0, "failed": 2}  # one failed again, one is gone
    assert since() == ["ocr scan bad"]


def test_a_fill_that_breaks_off_goes_on(spark, tmp_path, calls, monkeypatch):
    _, ocr, since = calls
    store = OcrStore(spark, str(tmp_path / "ocr"))
    files = source(spark, {f"f{i}.pdf": f"scan {i}".encode() for i in range(12)})
    append, rounds = store._append, []

    def stop(name, rows):
        rounds.append(name)
        if rounds.count("texts") == 2:
            raise KeyboardInterrupt
        append(name, rows)

    monkeypatch.setattr(store, "_append", stop)
    with pytest.raises(KeyboardInterrupt):
        store.fill(files, ocr, per_round=4)
    first = since()
    assert 0 < len(first) < 12
    assert OcrStore(spark, store.path).fill(files, ocr, per_round=4) == {"done": 12, "failed": 0}
    assert not set(first) & set(rest := since()) and len(first) + len(rest) == 12
    assert store.texts().count() == store.recognised().count() == 12


def test_edges(spark, tmp_path, calls):
    """An empty store and table, null contents, repeated rows, a clashing column."""
    _, ocr, since = calls
    store = OcrStore(spark, str(tmp_path / "ocr"))
    none = source(spark, {}).where("false")
    assert store.fill(none, ocr) == {"done": 0, "failed": 0} and store.recognised().count() == 0 and store.attach(none).count() == 0
    rows = spark.createDataFrame([("x.pdf", None, 1), ("y.pdf", bytearray(b"y"), 2), ("y.pdf", bytearray(b"y"), 2), (None, bytearray(b"z"), 3)], "path string, content binary, sha int")
    assert store.fill(rows, ocr) == {"done": 3, "failed": 1} and since() == ["ocr y", "ocr z"]
    got = store.attach(rows.withColumn("content_type", F.lit("application/pdf"))).select("path", "sidecar", "sha").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("x.pdf", None, 1), ("y.pdf", "recognised y", 2), ("y.pdf", "recognised y", 2), (None, "recognised z", 3)], key=str)
