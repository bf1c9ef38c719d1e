"""What a scripted model adds while documents are indexed."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestone.errors import EnvironmentFailure
from lodestone.operators.catalog import Catalog
from lodestone.plans.enrich import PAGES, Enricher, page_batches
from lodestone.operators.retrieval import postings
from lodestone.plans.index import Index, kind_counts
from lodestone.plans.materialize import cut


def source(spark, files):
    """files is path: (document, text); a PDF's content is its text."""
    rows = [(d, p, t, bytearray((t or "").encode()), {"type": "Journal"}) for p, (d, t) in files.items()]
    df = spark.createDataFrame(rows, "key string, path string, text string, content binary, meta map<string,string>")
    return df.select("key", F.col("key").alias("title"), "path", F.sha2("content", 256).alias("fingerprint"), "content", "text", "meta")


@pytest.fixture()
def render():
    def pages(content):
        """As many pages as the text says behind its first word."""
        for i in range(int(content.decode().split()[1])):
            yield b"%d" % (i + 1)

    return pages


@pytest.fixture()
def model(tmp_path):
    log = tmp_path / "calls"
    log.touch()

    def call(prompt, images, temperature, schema):
        fields = set(schema["properties"])
        what = "figures" if "figures" in fields else "tags" if "tags" in fields else "type" if "doc_type" in fields else "views"
        with open(log, "a") as f:
            f.write(f"{what} {prompt}\n".replace("\n", "|") + "\n")
        if "BROKEN" in prompt and what == "views":
            raise ValueError("broken")
        if what == "figures":  # page numbers within the call
            return json.dumps({"figures": [{"page": len(images), "description": f" saw {images[0].decode()} to {images[-1].decode()} "}, {"page": 1, "description": " "}]})
        if what == "tags":
            return json.dumps({"tags": ["Solar Cells", "solar cells", "PV", ""]})
        if what == "type":
            return json.dumps({"doc_type": schema["properties"]["doc_type"].get("enum", ["Misc"])[0]} if "odd" in prompt else {"doc_type": " Thesis "})
        return "no json" if "SILENT" in prompt else json.dumps({"notable": "n", "main_ideas": " ideas ", "methods": "", "why_cite": "w"})

    return call, lambda: log.read_text().splitlines()


def state(index):
    docs = {r.key: (r.summary, r.doc_type) for r in index.table("documents").collect()}
    tags = {(r.key, r.tag) for r in index.table("doc_tags").join(index.table("documents"), "document_id").collect()}
    files = {r.path: r.status for r in index.table("files").collect()}
    return docs, tags, files


def texts(index, path, kind):
    of = index.table("files").where(F.col("path") == path).join(index.table("chunks"), "file_id").where(F.col("kind") == kind)
    return [r.text for r in of.orderBy("seq").collect()]


def test_sync_with_a_model(spark, tmp_path, model, render):
    call, calls = model
    index = Index(spark, str(tmp_path / "index"), create=True, parts=3)
    c = Catalog.empty(spark)
    c.entities = spark.createDataFrame([("tag", "photovoltaics", 7), ("author", "Doe, J", 2)], c.entities.schema)
    c.aliases = spark.createDataFrame([("tag", "pv", "photovoltaics")], c.aliases.schema)
    index.set_catalog(c)
    files = {
        "a.pdf": ("a", "pages 18 of a"), "a2.txt": ("a", "second file of a"), "b.txt": ("b", "BROKEN text"), "c.txt": ("c", "SILENT text"),
        "d.txt": ("d", None), "odd.txt": ("odd", "an odd text"), "bad.pdf": ("bad", "cannot be drawn"),
    }
    enrich = Enricher(call, render)
    sync = lambda: index.sync(source(spark, files), F.col("text"), enrich=enrich)
    assert sync()["new"] == 7
    docs, tags, states = state(index)
    assert states == {"a.pdf": "ok", "a2.txt": "ok", "b.txt": "llm_pending", "c.txt": "ok", "d.txt": "no_text", "odd.txt": "ok", "bad.pdf": "ok"}
    assert docs == {"a": ("ideas", "thesis"), "b": (None, None), "c": (None, None), "d": (None, None), "odd": ("ideas", None), "bad": ("ideas", "thesis")}
    assert tags == {(d, t) for d in ("a", "odd", "bad") for t in ("solar cells", "photovoltaics")}
    assert texts(index, "a.pdf", "figure") == ["[a] [figure p.8] saw 1 to 8", "[a] [figure p.16] saw 9 to 16", "[a] [figure p.18] saw 17 to 18"]
    assert texts(index, "a.pdf", "view") == ["[a] [notable] n", "[a] [main_ideas] ideas", "[a] [why_cite] w"]
    assert texts(index, "a2.txt", "view") == [] and texts(index, "b.txt", "body") == [] and texts(index, "c.txt", "body") == ["SILENT text"]
    assert {r.kind: r.n for r in kind_counts(index.table("chunks")).collect()} == {"body": 5, "figure": 3, "view": 9}
    usage = {(r.kind, r["name"]): r.usage for r in index.table("entities").collect()}
    assert usage == {("tag", "photovoltaics"): 10, ("author", "Doe, J"): 2, ("tag", "solar cells"): 3, ("doctype", "thesis"): 2}
    assert any("HINT: Journal" in x for x in calls()) and any("VOCABULARY:|photovoltaics|" in x for x in calls())
    assert sum(x.startswith("views") and "SILENT" in x for x in calls()) == 2  # asked again, at another temperature

    n = len(calls())
    files["b.txt"] = ("b", "mended text")
    files["odd.txt"] = ("odd", "an odd text, changed")
    assert {k: v for k, v in sync().items() if v} == {"changed": 2, "unchanged": 5}
    docs, tags, states = state(index)
    assert docs["b"] == ("ideas", "thesis") and states["b.txt"] == "ok" and ("b", "photovoltaics") in tags
    assert docs["odd"] == ("ideas", "thesis")  # a generic type, then the choice from the vocabulary there is now
    assert not any("second file" in x for x in calls()[n:]) and docs["a"] == ("ideas", "thesis")


def test_a_pending_file_is_tried_again_and_a_missing_model_ends_the_run(spark, tmp_path, model):
    call, _ = model
    index = Index(spark, str(tmp_path / "index"), create=True, parts=2)
    files = source(spark, {"b.txt": ("b", "BROKEN text")})
    index.sync(files, F.col("text"), enrich=Enricher(call))
    assert index.report["llm_pending"] == 1 and index.table("chunks").count() == 0

    def gone(*_):
        raise EnvironmentFailure("no model")

    before = index.number
    with pytest.raises(Exception, match="no model"):
        index.sync(files, F.col("text"), enrich=Enricher(gone))
    assert index.number == before and index.table("files").count() == 1
    assert index.sync(files, F.col("text"), enrich=Enricher(lambda *a: call(a[0].replace("BROKEN", ""), *a[1:])))["retry"] == 1
    assert state(index)[2] == {"b.txt": "ok"} and index.table("chunks").count() == 4


def test_no_more_pages_than_asked_are_drawn():
    import pandas as pd

    drawn = []

    def many(content):
        for i in range(1000):
            drawn.append(i)
            yield b"page"

    got = list(page_batches(iter([pd.DataFrame({"file_id": [1], "title": ["t"], "content": [b""]})]), many))
    assert [(int(g["start"][0]), len(g["images"][0])) for g in got] == [(s, 8) for s in range(0, PAGES, 8)] and len(drawn) == PAGES


def test_texts_are_not_copied(spark, tmp_path, model, monkeypatch):
    """What an enricher stores on its way has no texts, and of two files of a document only the first is asked about."""
    from lodestone.plans import enrich, index as ix

    stored, dealt = [], []
    monkeypatch.setattr(enrich, "cut", lambda df, *a, **k: stored.append(set(df.columns)) or cut(df, *a, **k))
    monkeypatch.setattr(ix, "postings", lambda chunks: dealt.append(chunks._jdf.queryExecution().analyzed().toString()) or postings(chunks))
    rows = spark.createDataFrame([("d", "t", "b.txt", "1", "second " * 20), ("d", "t", "a.txt", "1", "first " * 20), ("e", "t", "c.txt", "1", "third " * 20)], "key string, title string, path string, fingerprint string, text string")
    index = Index(spark, str(tmp_path / "i"), create=True, parts=4)
    index.sync(rows, F.col("text"), enrich=Enricher(model[0]))
    assert stored and not any("text" in columns for columns in stored)
    assert all("Repartition" in plan for plan in dealt)  # chunks are shuffled, not their words
    views = index.table("chunks").where("kind = 'view'").join(index.table("files"), "file_id")
    assert {r.path for r in views.select("path").distinct().collect()} == {"a.txt", "c.txt"}
    assert index.table("postings").where("term = 'second'").count() == 1
