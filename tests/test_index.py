from __future__ import annotations

import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestone.errors import EnvironmentFailure, UsageError
from lodestone.functions.vectors import hashed_words
from lodestone.operators.documents import search
from lodestone.output import lines
from lodestone.plans.index import Index
from lodestone.providers import adjudicator, parse_query, propose_ranking
from lodestone.sources import files as src
from lodestone.sources import library as lib
from lodestone.streaming.live import answer, file_arrivals, live


def text():
    return src.extract_text(F.col("content"), F.col("path"), F.col("content_type"))


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / "stars.txt").write_text("A telescope gathers light.\n\nStars and galaxies shine.")
    (root / "sub" / "bread one.md").write_text("Flour, water and yeast make bread.")
    (root / "blank.txt").write_text(" \n ")
    (root / "skip.docx").write_text("x")
    (root / ".hidden" / "no.txt").write_text("hidden")
    return root


def test_scan(spark, folder):
    got = {r.key: r for r in src.scan_directory(spark, str(folder)).collect()}
    assert set(got) == {"stars.txt", "sub/bread one.md", "blank.txt"}
    assert got["sub/bread one.md"].title == "bread one.md" and got["stars.txt"].fingerprint.endswith(f":{os.path.getsize(folder / 'stars.txt')}")
    texts = {r.key: r.t for r in src.scan_directory(spark, str(folder)).select("key", text().alias("t")).collect()}
    assert texts["blank.txt"] is None and texts["stars.txt"].startswith("A telescope")
    with pytest.raises(UsageError):
        src.make_source(spark, str(folder), "nope")


def test_pdf_plugins(spark):
    rows = spark.createDataFrame([("a.pdf", "application/pdf", bytearray(b"one")), ("b.bin", "application/pdf", bytearray(b"")), ("c.xyz", "text/plain", bytearray(b"x"))], "path string, content_type string, content binary")
    read = src.extract_text(F.col("content"), F.col("path"), F.col("content_type"), lambda b: b.decode().upper())
    assert [r.t for r in rows.orderBy("path").select(read.alias("t")).collect()] == ["ONE", None, None]
    done = src.run_ocr(rows, lambda b: b.decode() if b else 1 / 0).orderBy("path").collect()
    assert [r.ok for r in done] == [True, False, True]


def test_sync_search_status(spark, folder, tmp_path):
    index = Index(spark, str(tmp_path / "index"), create=True)
    scan = lambda: src.scan_directory(spark, str(folder))
    assert index.sync(scan(), text())["new"] == 3
    assert index.sync(scan(), text()) == {"new": 0, "changed": 0, "retry": 0, "unchanged": 3, "removed": 0}
    asked = spark.createDataFrame([(0, "bread yeast")], "qid long, query string")
    find = lambda: search(Index(spark, str(tmp_path / "index")).tables(), asked, hashed_words).orderBy("rank").collect()
    assert find()[0].key == "sub/bread one.md"
    assert "skipped: blank.txt (no_text)" in index.status()
    (folder / "sub" / "bread one.md").unlink()
    (folder / "stars.txt").write_text("Yeast in bread under the stars, a changed file")
    assert index.sync(scan(), text()) | {"unchanged": 0} == {"new": 0, "changed": 1, "retry": 0, "unchanged": 0, "removed": 1}
    assert [r.key for r in find()] == ["stars.txt"]
    index.remove(["stars.txt"])
    assert find() == [] and index.table("documents").count() == 1
    with pytest.raises(UsageError):
        index.sync(scan(), text(), chunker="outline", chunk_settings={"outline": lambda t: None})
    with pytest.raises(UsageError):
        Index(spark, str(tmp_path / "absent"))


def test_limit_resumes_and_facets(spark, folder, tmp_path):
    index = Index(spark, str(tmp_path / "index"), create=True)
    scan = src.scan_directory(spark, str(folder))
    index.sync(scan, text(), limit=1)
    assert index.table("files").count() == 1
    index.sync(scan, text())
    assert index.table("files").count() == 3
    one = index.table("documents").where("key = 'stars.txt'").select("document_id")
    index.set_facets(one.withColumn("doc_type", F.lit("note")), one.withColumn("tag", F.lit("sky")), one.withColumn("author", F.lit("King, Ada")).withColumn("seq", F.lit(0)))
    asked = spark.createDataFrame([(0, "light")], "qid long, query string")
    got = search(index.tables(), asked, hashed_words, tags=[["sky"]], types=["note"]).first()
    assert got.key == "stars.txt" and got.authors == ["King, Ada"] and got.doc_type == "note"


def test_output_lines(spark, folder, tmp_path):
    index = Index(spark, str(tmp_path / "index"), create=True)
    index.sync(src.scan_directory(spark, str(folder)), text())
    found = search(index.tables(), spark.createDataFrame([(0, "stars")], "qid long, query string"), hashed_words)
    row = lines(found).first().line.split("\t")
    assert len(row) == 3 and row[1:] == ["stars.txt", "stars.txt"] and len(row[0].split(".")[1]) == 4
    value = json.loads(lines(found, as_json=True).first().line)
    assert value["title"] == "stars.txt" and "tags" not in value and "duplicate_keys" not in value


def test_library(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "zotero.sqlite")
    for name, columns in lib.TABLES.items():
        db.execute(f"CREATE TABLE {name} ({', '.join(columns.split(', '))})".replace(" long", " INTEGER").replace(" string", " TEXT"))
    put = lambda t, *rows: db.executemany(f"INSERT INTO {t} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    put("itemTypes", (1, "book"), (2, "attachment"), (3, "note"))
    put("items", (1, 1, "AAA"), (2, 2, "PDF1"), (3, 2, "PDF2"), (4, 2, "PDF3"), (5, 3, "NOTE"), (6, 1, "DEL"), (7, 2, "LINK"))
    put("fields", (1, "title"), (2, "date"), (3, "DOI"), (4, "abstractNote"))
    put("itemDataValues", (1, "A Book"), (2, "May 1999"), (3, "About it"))
    put("itemData", (1, 1, 1), (1, 2, 2), (1, 4, 3))
    put("creators", (1, "Ada", "King", 0), (2, None, "Institute", 1))
    put("itemCreators", (1, 1, 0), (1, 2, 1), (1, 1, 2))
    put("itemAttachments", (2, 1, 0, "application/pdf", "storage:one.pdf"), (3, None, 1, "application/pdf", "storage:alone.pdf"), (4, 1, 0, "application/pdf", "storage:missing.pdf"), (7, 1, 2, "application/pdf", "storage:linked.pdf"))
    put("deletedItems", (6,))
    db.commit()
    for key, name in (("PDF1", "one.pdf"), ("PDF2", "alone.pdf")):
        (tmp_path / "storage" / key).mkdir(parents=True)
        (tmp_path / "storage" / key / name).write_bytes(b"%PDF")
    got = {r.path: r for r in src.make_source(spark, str(tmp_path)).collect()}
    assert set(got) == {"storage/PDF1/one.pdf", "storage/PDF2/alone.pdf"}
    book = got["storage/PDF1/one.pdf"]
    assert book.title == "A Book" and book.meta == {"type": "book", "creators": "King, Ada; Institute", "year": "1999"}
    assert got["storage/PDF2/alone.pdf"].title == "alone.pdf"
    assert lib.abstracts(lib.open_tables(spark, str(tmp_path))).first().abstract == "About it"
    with pytest.raises(EnvironmentFailure):
        lib.open_tables(spark, str(tmp_path / "nowhere"))


def test_live(spark, tmp_path):
    lines_in = spark.createDataFrame([(1, "old"), (3, "newest"), (2, "middle")], "n long, query string")
    echo = lambda q: q.select("qid", F.lit(1).alias("rank"), F.concat(F.lit("found "), "query").alias("line"))
    assert answer(lines_in, echo, ["n"]) == ["found newest", ""]
    assert answer(lines_in.withColumn("query", F.lit(" ")), echo, ["n"]) == [""] and answer(lines_in.limit(0), echo, ["n"]) == []
    assert answer(lines_in, lambda q: 1 / 0, ["n"])[0].startswith("error:")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"n": 1, "query": "a"}\n{"n": 2, "query": "b"}\n')
    out: list[str] = []
    live(file_arrivals(spark, str(tmp_path / "in"), "n long, query string"), echo, out.extend, ["n"], checkpoint=str(tmp_path / "ck"), once=True).awaitTermination(60)
    assert out == ["found b", ""]


def test_providers():
    said = iter(["no json", json.dumps({"semantic_query": "growth", "tags": [{"name": "MOCVD", "weight": 2}, {"name": "x", "weight": 0}], "doc_types": [{"name": "misc", "weight": 1}], "year_from": 1999})])
    got = parse_query(lambda _: next(said), "q")
    assert got["semantic_query"] == "growth" and got["year_from"] == 1999 and got["facets"] == [{"terms": ["mocvd"], "weight": 1.0, "kind": "tag"}]
    assert parse_query(lambda _: None, "q")["semantic_query"] == "q"
    assert propose_ranking(lambda _: '{"ranking": [1, "x", 0]}', "q", ["a", "b"]) == [1, 0] and propose_ranking(lambda _: "", "q", []) is None
    assert adjudicator(lambda _: '{"choice": "b"}')("tag", "t", ["a", "b"]) == "b" and adjudicator(lambda _: '{"choice": "NEW"}')("tag", "t", ["a"]) is None


def test_stored_postings_manifest_and_dimension(spark, folder, tmp_path):
    from lodestone.functions import vectors as vec
    from lodestone.operators.retrieval import corpus_size, postings

    index = Index(spark, str(tmp_path / "index"), create=True)
    index.sync(src.scan_directory(spark, str(folder)), text())
    made = postings(index.table("chunks"))
    stored = index.tables().postings.drop("bucket")
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, made.select(*stored.columns).collect()))
    assert index.tables().size == corpus_size(made) == (2, 14)
    assert os.path.exists(tmp_path / "index" / "manifest-000000000001.json")
    other = Index(spark, str(tmp_path / "index"))
    index.remove(["blank.txt"])
    with pytest.raises(UsageError):
        other.remove(["stars.txt"])
    assert Index(spark, str(tmp_path / "index")).number == 2
    vec.register_embedder("short", lambda model: lambda t: F.array(F.length(t).cast("double")))
    index.manifest["meta"]["embedder"] = "short"
    (folder / "more.txt").write_text("one more")
    with pytest.raises(UsageError):
        index.sync(src.scan_directory(spark, str(folder)), text())
    assert Index(spark, str(tmp_path / "index")).number == 2


def test_limit_removes_once_all_is_done(spark, folder, tmp_path):
    index = Index(spark, str(tmp_path / "index"), create=True)
    index.sync(src.scan_directory(spark, str(folder)), text(), limit=3)
    (folder / "blank.txt").unlink()
    (folder / "stars.txt").write_text("changed text")
    (folder / "new.txt").write_text("a new text")
    index.sync(src.scan_directory(spark, str(folder)), text(), limit=1)
    assert index.table("files").where("path like '%blank.txt'").count() == 1
    index.sync(src.scan_directory(spark, str(folder)), text(), limit=1)
    assert index.table("files").where("path like '%blank.txt'").count() == 0


def test_stored_catalog_and_facets(spark, folder, tmp_path):
    from lodestone.cli import facet_groups
    from lodestone.operators import catalog as cat

    index = Index(spark, str(tmp_path / "index"), create=True)
    index.sync(src.scan_directory(spark, str(folder)), text())
    c = cat.Catalog.empty(spark)
    c.entities = spark.createDataFrame([("tag", "sky", 1), ("author", "King, Ada B.", 3)], cat.ENTITIES)
    c.aliases = spark.createDataFrame([("tag", "heaven", "sky"), ("author", "King, A.", "King, Ada B.")], cat.ALIASES)
    index.set_catalog(c)
    got = facet_groups(spark, Index(spark, str(tmp_path / "index")).catalog(), ["Heaven", "new"], ["Ada King", "Kinng, Ada B.", "Nobody, X"], "Note")
    assert got == ([["sky", "heaven"], ["new"]], [["King, Ada B.", "King, A."]] * 2 + [["Nobody, X"]], ["note"])


def test_years_weights_and_authors_of_a_parsed_query():
    said = json.dumps({"semantic_query": "q", "authors": [{"name": "Müller, J.", "weight": "0.5"}, {"name": "x", "weight": None}], "year_from": "1999", "year_to": 0})
    got = parse_query(lambda _: said, "q")
    assert got["facets"] == [{"terms": ["Müller, J."], "weight": 0.5, "kind": "author"}] and (got["year_from"], got["year_to"]) == (1999, None)
