"""An index as parts of Parquet tables with a JSON manifest.

Tables of files and of documents are divided into parts by a hash of the file or document.  A sync compares a source
listing with the known files, processes what is new, changed or pending in one distributed job, and writes anew only
the parts that hold something of it, each as a folder of its own; a manifest of the next number, put in place last by
one rename, lists the folders of all parts.  So one changed file of many costs one part of each table, a read is a
plain scan of the listed folders, readers of an older manifest keep a consistent index, and a run that breaks off
leaves the one before.  vacuum() deletes folders that no kept manifest lists.

A file whose extraction fails is marked `error` and the run goes on; one whose chunker gives up is marked
`llm_pending` and tried again by the next run.

Postings are stored in order of a hash of the term, and the manifest has the corpus sizes that BM25 needs, so a search
reads the row groups of its words alone.
"""

from __future__ import annotations

import copy
import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.errors import UsageError
from lodestone.functions.vectors import get_embedder
from lodestone.operators.catalog import ALIASES, ENTITIES, MERGES, VECTORS, Catalog
from lodestone.operators.chunking import get_chunker
from lodestone.operators.documents import IndexTables
from lodestone.operators.retrieval import bucket_of, postings
from lodestone.plans.materialize import cut, release

if TYPE_CHECKING:
    from lodestone.plans.enrich import Enricher
    from lodestone.sources.ocr import OcrStore

SCHEMA_VERSION = 3
#: Parts of each table, fixed when an index is made.
PARTS = 128
#: Chunks whose words a task sorts.
TASK_CHUNKS = 20_000
FILE_TABLES, DOCUMENT_TABLES = ("files", "chunks", "vectors", "postings"), ("documents", "doc_tags", "doc_authors")
SCHEMAS = {
    "documents": "document_id long, key string, title string, meta map<string,string>, doc_type string, summary string",
    "files": "file_id long, document_id long, path string, fingerprint string, status string",
    "chunks": "chunk_id long, file_id long, seq int, text string, kind string",
    "vectors": "chunk_id long, embedding array<double>",
    "doc_tags": "document_id long, tag string",
    "doc_authors": "document_id long, author string, seq int",
    "postings": "bucket int, term string, chunk_id long, tf long, len int",
    "entities": ENTITIES,
    "aliases": ALIASES,
    "term_vectors": VECTORS,
    "merges": MERGES,
}


def index_name(directory: str) -> Column:
    """`<name>-<eight digits of the path's SHA-256>`, the identity of a directory's index."""
    name = directory.rstrip("/").rsplit("/", 1)[-1]
    return F.concat(F.lit(name + "-"), F.substring(F.sha2(F.lit(directory).cast("binary"), 256), 1, 8))


def stable_id(*parts: Column | str) -> Column:
    """An id that depends on its parts alone, so a file keeps its chunks' ids from snapshot to snapshot."""
    return F.abs(F.xxhash64(*parts))


def part_of(key: Column | str, parts: int) -> Column:
    """The part of a file or document."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def diff(current: DataFrame, known: DataFrame, recognised: DataFrame | None = None) -> DataFrame:
    """(path, state): new, changed, retry, unchanged or removed, of (path, fingerprint) against (path, fingerprint, status).

    A file without text is tried again if it is one of recognised (path).
    """
    c = current.select("path", F.col("fingerprint").alias("now"), F.lit(True).alias("here"))
    k = known.select("path", F.col("fingerprint").alias("then"), "status", F.lit(True).alias("there"))
    again = F.col("status") == "llm_pending"
    if recognised is not None:
        k = k.join(recognised.select("path", F.lit(True).alias("found")), "path", "left")
        again = again | (F.col("status") == "no_text") & F.col("found").isNotNull()
    state = (
        F.when(F.col("here").isNull(), "removed")
        .when(F.col("there").isNull(), "new")
        .when(~F.col("now").eqNullSafe(F.col("then")), "changed")
        .when(again, "retry")
        .otherwise("unchanged")
    )
    return c.join(k, "path", "full_outer").select("path", state.alias("state"))


def prune(documents: DataFrame, files: DataFrame) -> DataFrame:
    """The documents that still have a file."""
    return documents.join(files.select("document_id").distinct(), "document_id", "left_semi")


def skipped(files: DataFrame) -> DataFrame:
    return files.where("status <> 'ok'").select("path", "status").orderBy("path")


class Index:
    """The index at a path (any file system that Spark reaches).  `parts` counts for a new index only."""

    def __init__(self, spark: SparkSession, path: str, create: bool = False, parts: int = PARTS):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.number = self._last()
        #: What the last sync or add did: files by status, and chunks.
        self.report: dict[str, int] = {}
        if not self.number:
            if not create:
                raise UsageError(f"no index at {self.path}; index the directory first")
            self.manifest: dict = {"tables": {}, "meta": {}}
        else:
            self.manifest = self._manifest(self.number)
        for name, empty in (("parts", {}), ("corpus", {}), ("streams", {}), ("n_parts", parts)):
            self.manifest.setdefault(name, empty)

    def _manifest(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{self._name(number)}", wholetext=True).first()[0])

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    @staticmethod
    def _name(number: int) -> str:
        return f"manifest-{number:012d}.json"

    def _numbers(self) -> list[int]:
        return sorted(int(s.getPath().getName()[9:-5]) for s in self._fs.globStatus(self._p("manifest-*.json")) or [])

    def _last(self) -> int:
        """The number of the current manifest; 0 if there is none."""
        return max(self._numbers(), default=0)

    def table(self, name: str, parts: list[int] | None = None) -> DataFrame:
        """A table of the current manifest, of some parts if asked; columns that an older one lacks are null (kind: body)."""
        schema = SCHEMAS[name]
        whole, placed = self.manifest["tables"].get(name), self.manifest["parts"].get(name, {})
        places = [whole] if whole else [p for k, p in placed.items() if parts is None or int(k) in parts]
        if not places:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read if whole and name != "postings" else self.spark.read.schema(schema)
        stored = reader.parquet(*[f"{self.path}/{p}" for p in places])
        columns = []
        for field in schema.split(", "):
            column, kind = field.split(" ", 1)
            value = F.col(column) if column in stored.columns else F.lit(None)
            columns.append((F.coalesce(value, F.lit("body")) if column == "kind" else value).cast(kind).alias(column))
        return stored.select(*columns)

    def tables(self) -> IndexTables:
        t = {n: self.table(n) for n in SCHEMAS}
        size = self.manifest["meta"].get("corpus_size")
        return IndexTables(t["documents"], t["files"], t["chunks"], t["vectors"], t["doc_tags"], t["doc_authors"], t["postings"] if size else None, tuple(size) if size else None)

    def catalog(self) -> Catalog:
        """The stored entity catalog."""
        return Catalog(self.table("entities"), self.table("aliases"), self.table("term_vectors"), self.table("merges"))

    def set_catalog(self, c: Catalog) -> None:
        self.commit({"entities": c.entities, "aliases": c.aliases, "term_vectors": c.vectors, "merges": c.merges})

    def setting(self, key: str, asked: str | None, default: str | None) -> str:
        """The recorded setting; recorded now if it is not yet.  A different wish later is an error."""
        known = self.manifest["meta"].get(key)
        if known is None:
            chosen = asked or default
            if chosen is None:
                raise UsageError(f"the first run needs {key}")
            self.manifest["meta"][key] = chosen
            return chosen
        if asked is not None and asked != known:
            raise UsageError(f"the index was made with {key} {known!r}, not {asked!r}")
        return known

    def commit(self, tables: dict[str, DataFrame], parts: dict[str, list[int]] | None = None) -> None:
        """Writes tables into a new folder, then the manifest that names them; an error if another run committed meanwhile.

        Of a table named in `parts` (with a column `part`) the rows are those of these parts, and the others stay.
        """
        folder, changed = f"snapshot-{uuid.uuid4().hex[:12]}", parts or {}
        for name, df in tables.items():
            place = f"{folder}/{name}"
            if name not in changed:
                df.write.parquet(f"{self.path}/{place}")
                self.manifest["tables"][name] = place
                continue
            order = ["part", "bucket", "term"] if name == "postings" else ["part"]
            dealt = df if name == "postings" else df.hint("rebalance", "part")  # postings were, as chunks
            dealt.sortWithinPartitions(*order).write.partitionBy("part").parquet(f"{self.path}/{place}", compression="zstd")
            written = {s.getPath().getName()[5:] for s in self._fs.globStatus(self._p(f"{place}/part=*")) or []}
            placed = {k: p for k, p in self.manifest["parts"].get(name, {}).items() if int(k) not in set(changed[name])}
            self.manifest["parts"][name] = placed | {k: f"{place}/part={k}" for k in sorted(written, key=int)}
            self.manifest["tables"].pop(name, None)
            if name == "postings":
                sizes = {}
                if written:
                    made = self.spark.read.parquet(f"{self.path}/{place}").groupBy("part").agg(F.sum(F.col("tf") / F.col("len")).alias("chunks"), F.sum("tf").alias("words"))
                    sizes = {str(r["part"]): [round(r["chunks"]), r["words"]] for r in made.collect()}  # a row for each part
                self.manifest["corpus"] = {k: v for k, v in self.manifest["corpus"].items() if int(k) not in set(changed[name])} | sizes
                self.manifest["meta"]["corpus_size"] = [sum(v[i] for v in self.manifest["corpus"].values()) for i in (0, 1)]
        self.manifest["meta"]["last_indexed"] = datetime.now(UTC).isoformat(timespec="seconds")
        self.manifest["schema_version"] = SCHEMA_VERSION
        written_as, place = self._p(f"{folder}.tmp"), self._p(self._name(self.number + 1))
        out = self._fs.create(written_as, True)
        out.write(bytearray(json.dumps(self.manifest, indent=1).encode()))
        out.close()
        if self._last() != self.number or not self._fs.rename(written_as, place):
            raise UsageError(f"another run changed the index at {self.path}")
        self.number += 1

    def sync(
        self,
        source: DataFrame,
        text: Column,
        chunker: str | None = None,
        embedder: str | None = None,
        model: str | None = None,
        limit: int | None = None,
        chunk_settings: dict | None = None,
        tags: Callable[[DataFrame], DataFrame] | None = None,
        ocr: OcrStore | None = None,
        enrich: Enricher | None = None,
    ) -> dict[str, int]:
        """Brings the index up to date with source (key, title, path, fingerprint[, meta, content ...]) and returns counts of files by what they needed.

        `text` extracts a row's text (null: no_text), or a struct (text, error): a row with an error is marked `error`
        and left alone until the file changes.  `report` then counts the processed files by status, and the chunks.
        With a limit only so many new or changed files are processed, by path; while more are left nothing is removed,
        and the next run resumes.  tags(documents) may give (document_id, tag) of the documents that are new or
        changed.  An embedder whose vectors have another dimension than the stored ones is an error, and the index
        stays as it was.  With a store of recognised texts, files of the source (with path, content_type and content)
        have a column `sidecar` for `text` to use, and files without text whose text is now stored are taken again.  An
        enricher adds chunks of kinds `figure` and `view`, summaries, tags and types, and what it learns to the catalog;
        a file on which one of its calls fails is `llm_pending` and has no chunks until a later run.
        """
        rows = self._with_meta(source)
        states = cut(diff(rows.select("path", "fingerprint"), self.table("files"), ocr.recognised() if ocr else None), "index-states")
        todo = states.where("state in ('new', 'changed', 'retry')")
        if limit is not None:
            todo = todo.orderBy("path").limit(limit)
        counts = {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
        finished = limit is None or sum(counts.get(s, 0) for s in ("new", "changed", "retry")) <= limit
        gone = states.where("state = 'removed'").select("path") if finished else states.where("false").select("path")
        work = rows.join(todo.select("path"), "path", "left_semi")
        with self._restored():
            self._update(rows, ocr.attach(work) if ocr else work, gone, text, chunker, embedder, model, chunk_settings, tags, enrich)
        release(states)
        return {s: counts.get(s, 0) for s in ("new", "changed", "retry", "unchanged", "removed")}

    def add(self, batch: DataFrame, text: Column, stream: str, number: int, **settings) -> bool:
        """Takes the files of one micro-batch, as sync() takes new and changed ones; removes nothing.

        The number of the stream's batch is committed with its rows, so a batch that comes again is not taken twice:
        the answer is whether it was taken.  Of a path that stands in the batch more than once one row counts.
        """
        if number <= self.manifest["streams"].get(stream, -1):
            return False
        rows = self._with_meta(batch).dropDuplicates(["path"])
        with self._restored():
            self.manifest["streams"][stream] = number
            self._update(rows, rows, rows.select("path").where("false"), text, **settings)
        return True

    @contextmanager
    def _restored(self) -> Iterator[None]:
        """If what is done within fails, the manifest at hand is as it was."""
        before = copy.deepcopy(self.manifest)
        try:
            yield
        except BaseException:
            self.manifest = before
            raise

    @staticmethod
    def _with_meta(source: DataFrame) -> DataFrame:
        return source if "meta" in source.columns else source.withColumn("meta", F.create_map().cast("map<string,string>"))

    def _update(self, listing: DataFrame, work: DataFrame, gone: DataFrame, text: Column, chunker: str | None = None, embedder: str | None = None, model: str | None = None, chunk_settings: dict | None = None, tags: Callable[[DataFrame], DataFrame] | None = None, enrich: Enricher | None = None) -> None:
        """Processes the files of work, forgets those of gone, and takes titles and meta of changed documents from the listing."""
        chunk = get_chunker(self.setting("chunker", chunker, "paragraph"), **(chunk_settings or {}))
        embed = get_embedder(self.setting("embedder", embedder, "hashed-words"), self.setting("model", model, "hashed-words-32"))
        n = self.manifest["n_parts"]
        read = work.withColumn("__text", text)
        both = isinstance(read.schema["__text"].dataType, StructType)
        is_pdf = (F.col("content_type") == "application/pdf") | F.lower("path").endswith(".pdf") if "content_type" in work.columns else F.lower("path").endswith(".pdf")
        read = read.select("key", "path", "fingerprint", "title", F.col("meta")["type"].alias("hint"), (F.col("__text.text") if both else F.col("__text")).alias("text"), (F.col("__text.error") if both else F.lit(None).cast("string")).alias("error"))
        pieces = F.when(F.col("text").isNotNull() & F.col("error").isNull(), chunk(F.col("text"), F.col("title")))
        status = F.when(F.col("error").isNotNull(), "error").when(F.col("text").isNull(), "no_text").when(F.col("pieces").isNull(), "llm_pending").when(F.size("pieces") == 0, "no_text").otherwise("ok")
        made = read.select(stable_id("key").alias("document_id"), stable_id("path").alias("file_id"), "path", "fingerprint", "title", "hint", "text", "error", pieces.alias("pieces"))
        made = made.withColumn("status", status).withColumn("n_pieces", F.size("pieces")).drop("error", *([] if enrich else ["title", "hint", "text"]))
        made = cut(made, "index-texts", compression="zstd")
        texts, found = [made], None
        if enrich:
            scans = work.where(is_pdf).select("path", (F.col("content") if "content" in work.columns else F.lit(None).cast("binary")).alias("content"))
            ready = made.where("status = 'ok'").select("file_id", "document_id", "path", "title", "text", "hint")
            found = enrich.run(ready, scans, self.catalog())
            extra = cut(found.files, "index-extra")
            held = cut(extra.where("pending").select("file_id"), "index-held")
            texts += [extra, held]
            ready = made.drop("text", "pieces").join(extra.select("file_id", "pending", "extra"), "file_id", "left")
            ready = ready.withColumn("status", F.when(F.col("pending"), F.lit("llm_pending")).otherwise(F.col("status")))
        new_files = (ready if found else made).select("file_id", "document_id", "path", "fingerprint", "status")
        split = made.where("status = 'ok'").select("file_id", F.posexplode("pieces").alias("seq", "text"))
        split = split.withColumn("kind", F.lit("body"))
        if found:
            split = split.join(held, "file_id", "left_anti")
            more = ready.where("status = 'ok'").select("file_id", F.col("n_pieces").alias("n"), F.posexplode("extra").alias("i", "x"))
            split = split.unionByName(more.select("file_id", (F.col("n") + F.col("i")).alias("seq"), "x.text", "x.kind"))
        new_chunks = split.select(stable_id("file_id", "seq").alias("chunk_id"), "file_id", "seq", "text", "kind")
        new_chunks = cut(new_chunks.withColumn("embedding", embed(F.col("text"))), "index-chunks", compression="zstd")
        dims = {r["d"]: r["n"] for r in new_chunks.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).limit(2).collect()}
        if len({*dims, *([self.manifest["meta"]["dim"]] if "dim" in self.manifest["meta"] else [])}) > 1:
            release(*texts, new_chunks)
            raise UsageError("the embedder changed its dimension; index into a new directory")
        if dims:
            self.manifest["meta"]["dim"] = next(iter(dims))
        self.report = {r["status"]: r["n"] for r in new_files.groupBy("status").agg(F.count("*").alias("n")).collect()} | {"chunks": sum(dims.values())}

        parted, parts = self._files(new_files.select("path").unionByName(gone), new_files, new_chunks, self.report["chunks"])
        # Documents to look at: of processed and of forgotten files, and those whose title or meta is another now.
        known = self.table("documents")
        plain = lambda m: F.array_sort(F.map_entries(m))  # noqa: E731  maps can't be compared
        listed = listing.select(stable_id("key").alias("document_id"), "key", "title", "meta").dropDuplicates(["document_id"])
        other = listed.join(known.select("document_id", F.col("title").alias("__t"), F.col("meta").alias("__m")), "document_id").where(~F.col("title").eqNullSafe(F.col("__t")) | ~plain(F.col("meta")).eqNullSafe(plain(F.col("__m"))))
        lost = self.table("files").join(new_files.select("path").unionByName(gone), "path", "left_semi").select("document_id")
        affected = cut(new_files.select("document_id").unionByName(other.select("document_id")).unionByName(lost).distinct(), "index-documents")
        touched = self._touched(affected.select(part_of("document_id", n)), DOCUMENT_TABLES)
        stored = self.table("documents", touched)
        fresh = listed.join(affected, "document_id", "left_semi").join(stored.select("document_id", "doc_type", "summary"), "document_id", "left")
        if found:
            told = extra.where("not pending").select("document_id", F.col("doc_type").alias("__type"), F.col("summary").alias("__summary"))
            fresh = fresh.join(told, "document_id", "left")
            fresh = fresh.withColumns({"doc_type": F.coalesce("__type", "doc_type"), "summary": F.coalesce("__summary", "summary")}).drop("__type", "__summary")
        kept = stored.join(fresh.select("document_id"), "document_id", "left_anti")
        documents = prune(fresh.unionByName(kept), self._other_files(parts["files"]).unionByName(parted["files"].select("document_id")))
        documents = cut(documents.withColumn("part", part_of("document_id", n)), "index-changed")
        names = F.filter(F.transform(F.split(F.coalesce(F.col("meta")["creators"], F.lit("")), ";"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
        mine = documents.join(fresh.select("document_id"), "document_id", "left_semi")
        named = mine.select("document_id", F.posexplode(F.array_distinct(names)).alias("seq", "author")).select("document_id", "author", "seq")
        tagged = tags(mine.drop("part")).select("document_id", "tag").distinct() if tags else None
        if found:
            tagged = found.tags if tagged is None else tagged.unionByName(found.tags).distinct()
        for name, rows in (("doc_authors", named), ("doc_tags", tagged)):
            old = self.table(name, touched)
            if rows is not None:
                old = old.join(rows.select("document_id").distinct(), "document_id", "left_anti").unionByName(rows.select(*old.columns))
            parted[name] = old.join(documents.select("document_id", "part"), "document_id")
        parted["documents"] = documents
        if found:
            c = found.catalog
            parted |= {"entities": c.entities, "aliases": c.aliases, "term_vectors": c.vectors, "merges": c.merges}
        self.commit(parted, parts | dict.fromkeys(DOCUMENT_TABLES, touched))
        release(*texts, new_chunks, affected, documents, *(found.tables if found else []))

    def _touched(self, found: DataFrame, tables: tuple[str, ...]) -> list[int]:
        """The parts found; all of them if the index still has these tables as a whole."""
        if any(self.manifest["tables"].get(t) for t in tables):
            return list(range(self.manifest["n_parts"]))
        return sorted(r[0] for r in found.distinct().collect())  # n_parts rows at most

    def _other_files(self, touched: list[int]) -> DataFrame:
        """(document_id) of the files outside of these parts."""
        rest = [p for p in range(self.manifest["n_parts"]) if p not in set(touched)]
        return (self.table("files", rest) if rest and not self.manifest["tables"].get("files") else self.table("files").where("false")).select("document_id")

    def _files(self, replaced: DataFrame, new_files: DataFrame | None = None, new_chunks: DataFrame | None = None, n_chunks: int = 0) -> tuple[dict[str, DataFrame], dict[str, list[int]]]:
        """(rows with their part, parts) of the tables of files: of the parts of the replaced paths, with new rows in place of old ones.

        Postings come dealt by their part: new ones are made of chunks that were dealt, as a text is smaller than its words.
        """
        n = self.manifest["n_parts"]
        touched = self._touched(replaced.select(part_of(stable_id("path"), n)), FILE_TABLES)
        files = self.table("files", touched).join(replaced, "path", "left_anti")
        files = files.select(*[f.split()[0] for f in SCHEMAS["files"].split(", ")])
        chunks = self.table("chunks", touched).join(files.select("file_id"), "file_id", "left_semi").withColumn("part", part_of("file_id", n))
        places = chunks.select("chunk_id", "part")
        vectors, words = (self.table(t, touched).join(places, "chunk_id") for t in ("vectors", "postings"))
        words = words.hint("rebalance", "part")
        files = files.withColumn("part", part_of("file_id", n))
        if new_files is not None and new_chunks is not None:
            mine = new_chunks.withColumn("part", part_of("file_id", n))
            files = files.unionByName(new_files.withColumn("part", part_of("file_id", n)))
            chunks = chunks.unionByName(mine.drop("embedding"))
            vectors = vectors.unionByName(mine.select("chunk_id", "embedding", "part"))
            tasks = max(1, -(-n_chunks // TASK_CHUNKS))
            pieces = -(-tasks // max(1, len(touched)))
            if 2 * tasks > len(touched):
                tasks = pieces * max(1, len(touched))
            task = F.pmod(F.col("part") * pieces + F.pmod(F.col("chunk_id"), F.lit(pieces)), F.lit(tasks)).cast("int")
            words = words.unionByName(self._postings(mine.select("chunk_id", "text", "part").repartitionById(tasks, task)))
        return {"files": files, "chunks": chunks, "vectors": vectors, "postings": words}, dict.fromkeys(FILE_TABLES, touched)

    @staticmethod
    def _postings(chunks: DataFrame) -> DataFrame:
        # a chunk's part goes with its id through the count of words
        made = postings(chunks.select(F.struct("chunk_id", "part").alias("chunk_id"), "text"))
        return made.select(bucket_of(F.col("term")).alias("bucket"), "term", F.col("chunk_id.chunk_id").alias("chunk_id"), "tf", F.col("len").cast("int").alias("len"), F.col("chunk_id.part").alias("part"))

    def remove(self, paths: list[str]) -> None:
        """Forgets files, their chunks and vectors, and documents that are left without any."""
        gone = self.spark.createDataFrame([(p,) for p in paths], "path string")
        parted, parts = self._files(gone)
        affected = self.table("files").join(gone, "path", "left_semi").select("document_id")
        touched = self._touched(affected.select(part_of("document_id", self.manifest["n_parts"])), DOCUMENT_TABLES)
        documents = prune(self.table("documents", touched), self._other_files(parts["files"]).unionByName(parted["files"].select("document_id")))
        documents = cut(documents.withColumn("part", part_of("document_id", self.manifest["n_parts"])), "index-changed")
        of_kept = {t: self.table(t, touched).join(documents.select("document_id", "part"), "document_id") for t in ("doc_tags", "doc_authors")}
        self.commit(parted | {"documents": documents} | of_kept, parts | dict.fromkeys(DOCUMENT_TABLES, touched))
        release(documents)

    def set_facets(self, doc_types: DataFrame | None = None, doc_tags: DataFrame | None = None, doc_authors: DataFrame | None = None) -> None:
        """Replaces the type (document_id, doc_type), tags or authors of the documents named."""
        n = self.manifest["n_parts"]
        changed: dict[str, DataFrame] = {}
        parts: dict[str, list[int]] = {}
        for name, rows in (("documents", doc_types), ("doc_tags", doc_tags), ("doc_authors", doc_authors)):
            if rows is None:
                continue
            parts[name] = self._touched(rows.select(part_of("document_id", n)), (name,))
            old = self.table(name, parts[name])
            if name == "documents":
                new = old.join(rows.select("document_id", F.col("doc_type").alias("__t")), "document_id", "left")
                new = new.withColumn("doc_type", F.coalesce("__t", "doc_type")).drop("__t")
            else:
                column = "tag" if name == "doc_tags" else "author"
                first = rows.groupBy("document_id", column).agg(*([F.min("seq").cast("int").alias("seq")] if column == "author" else [F.count("*").alias("n")]))
                new = old.join(rows.select("document_id").distinct(), "document_id", "left_anti").unionByName(first.select(*old.columns))
            changed[name] = new.withColumn("part", part_of("document_id", n))
        self.commit(changed, parts)

    def vacuum(self, keep: int = 2, hours: float = 24.0) -> int:
        """Deletes the folders that none of the last `keep` manifests lists, and the older manifests; returns the number of folders.

        Folders younger than `hours` stay: a run that isn't done yet may have written them.
        """
        numbers = self._numbers()
        listed = {p for k in numbers[-max(1, keep) :] for m in [self._manifest(k)] for p in [*m["tables"].values(), *(x for t in m.get("parts", {}).values() for x in t.values())]}
        oldest, deleted = (time.time() - hours * 3600) * 1000, 0
        for table in self._fs.globStatus(self._p("snapshot-*/*")) or []:
            place = "/".join(table.getPath().toString().split("/")[-2:])
            if place in listed or table.getModificationTime() > oldest:
                continue
            within = [s.getPath() for s in self._fs.globStatus(self._p(f"{place}/part=*")) or []]
            unlisted = [p for p in within if f"{place}/{p.getName()}" not in listed]
            for path in [table.getPath()] if len(unlisted) == len(within) else unlisted:
                self._fs.delete(path, True)
                deleted += 1
        for k in numbers[: -max(1, keep)]:
            self._fs.delete(self._p(self._name(k)), False)
        return deleted

    def status(self) -> str:
        """Settings, counts, chunks by kind and skipped files, as text."""
        lines = [f"{k}: {v}" for k, v in sorted(self.manifest["meta"].items())]
        lines += [f"{n}: {self.table(n).count()}" for n in ("documents", "files", "chunks")]
        lines += [f"  {r['kind']}: {r['n']}" for r in kind_counts(self.table("chunks")).collect()]
        lines += [f"skipped: {r['path']} ({r['status']})" for r in skipped(self.table("files")).collect()]
        return "\n".join(lines)


def kind_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.coalesce("kind", F.lit("body")).alias("kind")).agg(F.count("*").alias("n")).orderBy("kind")

